"""Compare registered queries with their SQL: ``check.py FOLDER [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from radloom import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(None if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows),
                  key=lambda r: tuple((v is None, v or "") for v in r))


def compare(spark_frame, oracle_frame) -> str | None:
    """What differs, or None."""
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(oracle_frame.columns)}"
    a, b = normal(spark_frame), normal(oracle_frame)
    if a == b:
        return None
    extra, lacking = set(a) - set(b), set(b) - set(a)
    return f"rows {len(a)} vs {len(b)}; only spark {sorted(extra, key=str)[:2]}; only sql {sorted(lacking, key=str)[:2]}"


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def main() -> int:
    import workload

    folder, names = sys.argv[1], sys.argv[2:] or list(workload.QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            got = workload.QUERIES[name](spark, folder).toPandas()
            if name not in workload.ORACLE:
                outcome = f"rows only: {len(got)}"
            else:
                diff = compare(got, con.execute(workload.ORACLE[name]).df())
                outcome = diff or f"ok {len(got)}"
                bad += diff is not None
        except Exception as problem:  # noqa: BLE001
            outcome, bad = f"FAILED {type(problem).__name__}: {str(problem)[:350]}", bad + 1
        print(f"{name:24s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
