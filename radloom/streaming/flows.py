"""Flows that run per message elsewhere, here per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from radloom.functions.joins import unique_side
from radloom.operators import identity, screening
from radloom.operators.load import dedupe_batch, split_corrupt
from radloom.operators.rejectors import Rejector, apply_rejectors
from radloom.operators.validate import rebuild_messages
from radloom.session import pin
from radloom.sources.documents import find
from radloom.streaming.microbatch import quarantine, write_batch


def swap_stream(stream: DataFrame, mapping: DataFrame, tags: str = "tags") -> DataFrame:
    """Patient identifiers swapped in flight; the map is read per batch."""
    return identity.swap_patient_id(stream, mapping, tags=tags)


def reject_stream(stream: DataFrame, chain: list[Rejector]) -> DataFrame:
    return apply_rejectors(stream, chain)


def screen_stream(stream: DataFrame, classifier: screening.Classifier) -> DataFrame:
    return screening.verdict(classifier.classify(stream))


def split_load(checked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows of a checked batch: together the batch, and no row in both.

    Bad are the rows with a reason, those without a key and those that share a
    key with a bad row.
    """
    marked = pin(checked.withColumn("bad", F.coalesce("bad", F.when(F.col(key).isNull(), F.lit("no key")))))
    bad = marked.where(F.col("bad").isNotNull())
    fine = marked.where(F.col("bad").isNull())
    shared = fine.join(unique_side(bad, key), key, "left_semi").withColumn("bad", F.lit("shares its key with a bad row"))
    return split_corrupt(fine.drop("bad"), bad, key), bad.unionByName(shared.select(*bad.columns))


def load_handler(check: Callable[[DataFrame], DataFrame], key: str, good_path: str, bad_path: str,
                 dataset: str = "DicomDataset") -> Callable[[DataFrame, int], None]:
    """Batch load: repeated tag sets once, corrupt rows set aside, rest written.

    Rows without a key are corrupt.  A batch that is repeated replaces what it wrote.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_load(check(dedupe_batch(batch, dataset)), key)
        quarantine(bad, bad_path, batch_id)
        write_batch(good, good_path, batch_id)
    return handle


def reprocess_handler(query: str | None, good_path: str, bad_path: str, counts_path: str) -> Callable[[DataFrame, int], None]:
    """Stored documents matching a query back to messages, with counts."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        messages = rebuild_messages(find(batch, query))
        write_batch(messages.where(F.col("bad").isNull()).drop("bad"), good_path, batch_id)
        quarantine(messages.where(F.col("bad").isNotNull()), bad_path, batch_id)
        counts = messages.agg(F.count_if(F.col("bad").isNull()).alias("sent"), F.count_if(F.col("bad").isNotNull()).alias("failed"))
        write_batch(counts, counts_path, batch_id)
    return handle
