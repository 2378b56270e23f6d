"""Document store: query documents in, Column predicates out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.ordering import with_position


class QueryError(ValueError):
    """The query text is not a usable query document."""


_COMPARE = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(*v),
    "$regex": lambda c, v: c.rlike(v),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def predicate(find: dict) -> Column:
    """Translate a ``find`` document; an empty one accepts every row."""
    terms = []
    for name, wanted in find.items():
        if name in ("$and", "$or"):
            parts = [predicate(p) for p in wanted]
            joined = parts[0]
            for part in parts[1:]:
                joined = joined & part if name == "$and" else joined | part
            terms.append(joined)
        elif isinstance(wanted, dict) and wanted:
            unknown = [op for op in wanted if op not in _COMPARE]
            if unknown:
                raise QueryError(f"unsupported operator {unknown[0]}")
            terms.extend(_COMPARE[op](F.col(name), value) for op, value in wanted.items())
        else:
            terms.append(F.col(name).isNull() if wanted is None else F.col(name) == F.lit(wanted))
    result = F.lit(True)
    for term in terms:
        result = result & term
    return result


def _number(query: dict, name: str) -> int | None:
    if name not in query:
        return None
    value = query[name]
    if isinstance(value, bool) or not isinstance(value, int):
        raise QueryError(f"could not read {name} as a whole number")
    if value < 0:
        raise QueryError(f"{name} must not be negative")
    return value


def find(df: DataFrame, query: str | None) -> DataFrame:
    """Rows of a store matching ``{find, sort?, skip?, limit?}``.

    No query means every row; a limit of 0 means no limit.
    """
    if query is None or not query.strip():
        return df
    try:
        document = json.loads(query)
    except json.JSONDecodeError as problem:
        raise QueryError("could not read the query as JSON") from problem
    if not isinstance(document, dict) or "find" not in document:
        raise QueryError('the query has no "find" node')
    for node in ("find", "sort"):
        if node in document and not isinstance(document[node], dict):
            raise QueryError(f"{node} is not a document")
    found = df.where(predicate(document["find"]))
    skip, limit = _number(document, "skip"), _number(document, "limit")
    order = [F.col(c).desc_nulls_last() if way < 0 else F.col(c).asc_nulls_first() for c, way in document.get("sort", {}).items()]
    if skip or limit:
        # Rows that the sort leaves tied, or all without a sort, go by their content: the same rows on every run.
        order.append(F.xxhash64(*found.columns))
    if skip and not limit:
        # All rows but the first few: numbered in place, as an offset would bring every row into one task.
        return with_position(found, *order, name="_pos").where(F.col("_pos") >= skip).orderBy("_pos").drop("_pos")
    if order:
        found = found.orderBy(*order)
    if skip:
        found = found.offset(skip)
    return found.limit(limit) if limit else found
