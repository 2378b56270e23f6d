"""Holding back micro-batches until there is enough to do, or the oldest row has waited long enough.

Arriving rows are written to a backlog folder first; a release hands all of it to the next handler at once.  What a
release takes is written down before the handler sees it and crossed off after the handler returns, so a run that
breaks off between the two hands over the same rows under the same number again, and nothing is lost or handed over in two numbers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from radloom.sources.commits import create, hadoop_path, names

Handler = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class HoldBack:
    """``at_least`` rows are released at once; fewer wait until the oldest has been here ``at_most`` seconds.

    ``clock`` gives seconds, for tests.
    """

    path: str
    at_least: int
    at_most: float
    clock: Callable[[], float] = time.time

    def handler(self, handle: Handler) -> Handler:
        """A batch handler that keeps rows back in front of ``handle``, whose batch numbers are those of its releases."""
        def arrive(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            self._finish(spark, handle)
            self._keep(batch, batch_id)
            self.release_due(spark, handle)
        return arrive

    def release_due(self, spark: SparkSession, handle: Handler) -> bool:
        """Release the backlog if it is large or old enough; for a timer too, when no batch arrives."""
        self._finish(spark, handle)
        waiting = self.waiting(spark)
        rows = sum(w["rows"] for w in waiting.values())
        if not rows or (rows < self.at_least and self.clock() - min(w["since"] for w in waiting.values() if w["rows"]) < self.at_most):
            return False
        number = max([self._number(n) for n in names(spark, f"{self.path}/releases")], default=-1) + 1
        create(spark, f"{self.path}/releases/{number:012d}.json", json.dumps({"batches": sorted(waiting)}))
        self._finish(spark, handle)
        return True

    def waiting(self, spark: SparkSession) -> dict[str, dict]:
        """Rows and time of arrival of every batch held back."""
        taken = {b for n in names(spark, f"{self.path}/releases") if n.endswith(".json") for b in self._read(spark, f"releases/{n}")["batches"]}
        return {n[:-5]: self._read(spark, f"arrived/{n}") for n in names(spark, f"{self.path}/arrived") if n.endswith(".json") and n[:-5] not in taken}

    def _keep(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch down; one that is repeated replaces itself, and one that was counted already is left alone."""
        spark, name = batch.sparkSession, f"batch={batch_id:012d}"
        if f"{name}.json" in names(spark, f"{self.path}/arrived"):
            return
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/rows/{name}")
        create(spark, f"{self.path}/arrived/{name}.json", json.dumps({"rows": seen.get["rows"], "since": self.clock()}))

    def _finish(self, spark: SparkSession, handle: Handler) -> None:
        """Hand over releases that were written down but not crossed off, the earliest first."""
        listed = set(names(spark, f"{self.path}/releases"))
        for name in sorted(n for n in listed if n.endswith(".json")):
            if name.replace(".json", ".done") not in listed:
                folders = [f"{self.path}/rows/{b}" for b in self._read(spark, f"releases/{name}")["batches"]]
                handle(spark.read.parquet(*folders), self._number(name))
                create(spark, f"{self.path}/releases/{name.replace('.json', '.done')}", "")

    def tidy(self, spark: SparkSession) -> int:
        """Delete the rows of releases that are crossed off; returns how many batches went.  The small records stay."""
        gone = 0
        listed = set(names(spark, f"{self.path}/releases"))
        present = set(names(spark, f"{self.path}/rows"))
        for name in listed:
            if name.endswith(".json") and name.replace(".json", ".done") in listed:
                for b in self._read(spark, f"releases/{name}")["batches"]:
                    if b in present:
                        fs, folder = hadoop_path(spark, f"{self.path}/rows/{b}")
                        gone += bool(fs.delete(folder, True))
        return gone

    @staticmethod
    def _number(name: str) -> int:
        return int(name.partition(".")[0])

    def _read(self, spark: SparkSession, name: str) -> dict:
        fs, file = hadoop_path(spark, f"{self.path}/{name}")
        stream = fs.open(file)
        try:
            return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()


def with_ticks(stream: DataFrame, column: str = "_tick") -> DataFrame:
    """The stream with one marked empty row a second, so that batches keep coming while nothing arrives; see :func:`without_ticks`."""
    ticks = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(True).alias(column))
    return stream.withColumn(column, F.lit(False)).unionByName(ticks, allowMissingColumns=True)


def without_ticks(handle: Handler, column: str = "_tick") -> Handler:
    """A handler of a ticking stream that sees its real rows only."""
    return lambda batch, batch_id: handle(batch.where(~F.col(column)).drop(column), batch_id)
