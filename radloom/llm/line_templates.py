"""Line dedup by a log-template tree: recurring line templates across documents are dropped.

A line is parsed to a fixed depth: its number of tokens, then its first ``depth``
tokens, lead to a leaf.  Tokens with a digit are variable fields from the start
(``<*>``).  In a leaf that lines of several documents reach, a position is
constant where one token takes at least ``dominance`` of the lines and variable
otherwise.  A line that agrees with the constants in at least ``similarity`` of the
positions behind the leading tokens belongs to the leaf's template; a line
outside it is its own template.

A template met in at least ``min_docs`` documents recurs, one of a long line on its
own in ``long_docs`` where that is given.  The document with the
smallest key keeps its lines, the others lose theirs, so every passage stays once.
Built-in functions only; nothing is gathered per template but counts and minima.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import join_side
from radloom.llm.common import bind, packed, stored

FIELD = "<*>"


@dataclass(frozen=True)
class TemplateRule:
    """``min_tokens``: shorter lines are never dropped.

    With ``long_docs``, lines of ``long_chars`` characters or more besides spaces and fields recur from
    that many documents, and go however few tokens they have; in a line of one token only the digits are fields.
    """

    min_docs: int = 3
    min_tokens: int = 2
    depth: int = 3
    dominance: float = 0.5
    similarity: float = 0.7
    long_docs: int | None = None
    long_chars: int = 100


def _masked(line: Column, rule: TemplateRule) -> Column:
    # The plain searches spare most lines the two replacements.
    odd = F.contains(line, F.lit("  "))
    for space in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(space))
    flat = F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))
    fields = F.regexp_replace(flat, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
    if rule.long_docs is not None:
        fields = F.when(F.contains(flat, F.lit(" ")), fields).otherwise(F.regexp_replace(flat, "[0-9]+", FIELD))
    return F.when(line.rlike("[0-9]"), fields).otherwise(flat)


def _long(rule: TemplateRule) -> Column:
    if rule.long_docs is None:
        return F.lit(False)
    return F.length(F.replace(F.replace("masked", F.lit(FIELD), F.lit("")), F.lit(" "), F.lit(""))) >= rule.long_chars


def _lines(df: DataFrame, key: str, text: str, rule: TemplateRule) -> DataFrame:
    """key, doc, pos, masked, n, long, template and leaf of every line long enough; ``doc`` tells texts of one key apart."""
    # The text is hashed before its lines are dealt out, once.
    hashed = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("doc"), F.col(text).alias("text"))
    lines = hashed.select("key", "doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # As outputs of generators the masked line and its length are computed once; a filter on them would else repeat the work.
    masked = lines.select("key", "doc", "pos", F.explode(F.array(_masked(F.col("line"), rule))).alias("masked"))
    counted = masked.select("*", F.explode(F.array(F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)).alias("n"))
    return counted.withColumn("long", _long(rule)).where((F.col("masked") != "") & ((F.col("n") >= rule.min_tokens) | F.col("long"))).withColumns({
        "template": F.xxhash64("masked"), "leaf": F.xxhash64("n", F.substring_index("masked", " ", rule.depth))})


def _documents_by(lines: DataFrame, *group: str) -> DataFrame:
    """Documents per group and the first of them; a document counts once."""
    return (lines.groupBy(*group, "key", "doc").agg(F.lit(1).alias("one"))
            .groupBy(*group).agg(F.count("*").alias("docs"), F.min(F.struct(F.col("key").isNull().alias("absent"), "key", "doc")).alias("first")))


def _general(df: DataFrame, lines: DataFrame, key: str, text: str, rule: TemplateRule) -> DataFrame:
    """``template`` and ``leaf`` of the lines that belong to their leaf's template."""
    deep = lines.where(F.col("n") > rule.depth)
    leaves = (deep.groupBy("leaf", "key", "doc").agg(F.min("template").alias("lo"), F.max("template").alias("hi"))
              .groupBy("leaf").agg(F.count("*").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
              .where((F.col("docs") >= rule.min_docs) & (F.col("lo") != F.col("hi"))).select(F.col("leaf").alias("of")))
    members = stored(
        _lines(df, key, text, rule).where(F.col("n") > rule.depth).join(join_side(leaves, "of"), F.col("leaf") == F.col("of"))
        .groupBy("leaf", "template", "masked", "n").count())
    tokens = members.select("leaf", "n", "count", F.posexplode(F.split("masked", " ")).alias("at", "token")).where(F.col("at") >= rule.depth)
    top = (tokens.groupBy("leaf", "n", "at", "token").agg(F.sum("count").alias("lines"))
           .groupBy("leaf", "n", "at").agg(F.sum("lines").alias("total"), F.max(F.struct("lines", "token")).alias("top")))
    constants = (top.where((F.col("top.lines") >= rule.dominance * F.col("total")) & (F.col("top.token") != FIELD))
                 .groupBy("leaf", "n").agg(F.collect_list(F.struct("at", F.col("top.token").alias("token"))).alias("constants"))
                 .where(F.size("constants") >= rule.similarity * (F.col("n") - rule.depth)).select(F.col("leaf").alias("of"), "constants"))
    met = bind(F.split("masked", " "), lambda tokens: F.size(F.filter("constants", lambda c: F.get(tokens, c["at"]) == c["token"])))
    return (members.join(join_side(constants, "of"), F.col("leaf") == F.col("of"))
            .where(met >= rule.similarity * (F.col("n") - rule.depth)).select("template", "leaf"))


def dropped_lines(df: DataFrame, key: str = "doc_id", text: str = "text", rule: TemplateRule | None = None) -> DataFrame:
    """key, doc (hash of the text) and ``drops``, the sorted 0-based places of the lines that go; documents that lose none are absent."""
    rule = rule or TemplateRule()
    lines = stored(_lines(df, key, text, rule).select("key", "doc", "pos", "n", "long", "template", "leaf"))
    general = stored(_general(df, lines, key, text, rule))
    enough = F.when(F.col("long"), rule.min_docs if rule.long_docs is None else rule.long_docs).otherwise(rule.min_docs)
    exact = _documents_by(lines, "template", "long").where(F.col("docs") >= enough).select("template", "first")
    in_leaf = lines.select("key", "doc", F.col("template").alias("t")).join(join_side(general, "template"), F.col("t") == F.col("template"))
    leaves = _documents_by(in_leaf, "leaf").where(F.col("docs") >= rule.min_docs).select(F.col("leaf").alias("of"), "first")
    by_leaf = general.join(join_side(leaves, "of"), F.col("leaf") == F.col("of")).select("template", "first", F.lit(0).alias("order"))
    # A line that belongs to its leaf's template and to one of its own goes by the leaf's.
    recurring = stored(by_leaf.union(exact.withColumn("order", F.lit(1))).groupBy("template").agg(F.min_by("first", "order").alias("first")))
    side = join_side(recurring.withColumnRenamed("template", "t"), "t")
    gone = lines.join(side, F.col("template") == F.col("t")).where(
        ~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("doc") == F.col("first.doc"))))
    # Repeated rows share key and text, hence their places.
    return gone.groupBy("key", "doc").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def drop_lines(df: DataFrame, key: str = "doc_id", text: str = "text", rule: TemplateRule | None = None) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``drops`` and ``kept``, the text without the lines that recur.

    Whole texts are read.  A null text stays null and has no lines; an empty one
    is one empty line, which is never dropped.  Rows that repeat key and text are one document:
    they keep or lose lines alike.  Other columns are only carried inside ``row``.
    """
    drops = dropped_lines(df, key, text, rule)
    side = join_side(drops.select(F.col("key").alias("k"), F.col("doc").alias("d"), "drops"), "k", "d")
    rows = packed(df, key=F.col(key), doc=F.xxhash64(text))
    joined = rows.join(side, F.col("key").eqNullSafe(F.col("k")) & (F.col("doc") == F.col("d")), "left")
    lines = F.split(F.col("row")[text], "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("row")[text]).otherwise(F.array_join(
        bind(lines, lambda all_lines: F.transform(stay, lambda i: F.get(all_lines, i))), "\n"))
    return joined.select("row", F.when(F.col("row")[text].isNull(), F.lit(0)).otherwise(F.size(lines)).alias("n_lines"),
                         F.coalesce("drops", F.array().cast("array<int>")).alias("drops"), kept.alias("kept"))
