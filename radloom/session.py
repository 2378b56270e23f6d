"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package counts on.  Join sides are never
# hinted as broadcast because of a guess about the data: Spark broadcasts a side
# only when its estimated or measured size is below autoBroadcastJoinThreshold,
# and falls back to sort-merge with skew splitting beyond it.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "radloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session carrying the settings of this package."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    A folder of our own is only made in local mode, where driver and executors
    are one process; on a cluster a machine-local folder would be lost with its
    executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="radloom-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later reads see one fixed result."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its measured size then decides how it is joined."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
