"""From a changed identifier map to updated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from radloom.functions.ordering import with_position
from radloom.operators import updates


def propagate(current: DataFrame, archive: DataFrame, surrogates: DataFrame | None, since: Column,
              tables: dict[str, DataFrame], column: str) -> dict[str, DataFrame]:
    """Every table holding the column, after all mapping updates in order."""
    found = updates.detect_updates(current, archive, surrogates, since)
    ordered = with_position(found, "swap", "step", name="seq")
    resolved = updates.resolve_chain(ordered.select("seq", "have", "want"))
    return {name: updates.apply_chain(df, column, resolved) for name, df in tables.items() if column in df.columns}
