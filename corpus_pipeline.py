"""A training corpus from documents in five stages, each over all rows its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes it as Parquet in the shared folder and hands the next stage what it reads back.

All stages take nulls in any column, empty and very long texts, repeated rows,
empty tables (the result is empty) and further columns of any name, which all
but the last stage carry along.  The functions below say what nulls come to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from radloom.llm import bpe, language, line_templates, mixing, near_copies, simhash
from radloom.llm.common import stored
from radloom.session import tune

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Documents whose best language is less likely than this are rejected.
LEAST_SCORE = 0.5
LINES = line_templates.TemplateRule(long_docs=2)
#: Whole texts go to Python in batches of so many rows; memory that larger ones take stays with the executor through later stages.
BATCH_ROWS = 1_000


def tuned(spark: SparkSession) -> SparkSession:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts among them) and those of no clear language.

    ``lang`` is left as it is; a null one is merely not learned from.
    """
    tuned(spark)
    found = language.identify(docs, language.train(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of every document but the one of the smallest id that has them.

    A line of 100 characters or more (besides spaces and fields, so any usual one of over 50 words) recurs from two documents, a shorter one from three.
    Documents stay, maybe with an empty text; a null text stays null.  ``n_chars`` follows the text.
    """
    tuned(spark)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return line_templates.drop_lines(docs, rule=LINES).select(*[
        new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near duplicates, the one of the smallest id.

    SimHash fingerprints of runs of five words and their links within 4 bits give groups, MinHash keys give the pairs that lie
    farther apart.  Near are texts whose runs of five words have a Jaccard similarity of 0.8 or more, verified on the whole texts.
    Texts without words, null ones too, are one group; ids may be null or repeated.
    """
    tuned(spark)
    return near_copies.one_of_each(docs, shingle=5, least=0.8, groups=simhash.near_duplicates(docs, distance=4, blocks=6, shingle=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats a document as often as the mix takes it, up to twice, and leaves out those it does not take.

    A null source is a source of its own, the last in order; rows of one id are taken alike.
    """
    tuned(spark)
    plan = mixing.plan_mix(stored(mixing.sized(docs)))
    taken = mixing.apply_mix(docs, plan)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return taken.where("copies > 0").select("row", copies).select("row.*")


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they give its text back; a null text is an empty one, without ids."""
    tuned(spark)
    coded = bpe.round_trip(docs, bpe.load(TOKENIZER))
    return coded.select(
        "row.doc_id", "row.lang", "row.source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_and_decode),
]

#: Fingerprints, learned models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
