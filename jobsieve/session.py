"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "jobsieve", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`.

    A local folder is taken only where that setting is empty and Spark runs in one
    process; on a cluster the executors could not reach it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="jobsieve-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; nothing is ever overwritten there."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows and their partitioning survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Deals the rows over `jobsieve.spread` partitions where the session sets it; unset, the table is left as it is.

    A file of one row group is one task however costly its rows are. Whoever runs on few such files (a benchmark, a
    test) asks for this; large tables come in as many splits as Spark makes of them. `narrow` rows, of which costly text
    is made later, are dealt out in any case, over the shuffle partitions: moving them is cheap next to one slow task.
    """
    conf = df.sparkSession.conf
    parts = int(conf.get("jobsieve.spread", conf.get("spark.sql.shuffle.partitions") if narrow else "0"))
    return df.repartition(parts) if parts else df
