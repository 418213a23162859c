"""Spark session helpers.

The library never creates a cluster session on its own; `get_spark` is for tests, tools and the bench.
On a cluster the caller owns the session and `checkpoint_dir` reads `spark.checkpoint.dir` from it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no broadcast from static estimates; AQE broadcasts a join side only after measuring it at runtime
    # (shuffle statistics) and keeps the sort-merge join otherwise. Explicit broadcast() is used only for
    # tables of fixed size (nation, region, label tables).
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "termlens",
              driver_memory: str = "8g") -> SparkSession:
    master = master or os.environ.get("TERMLENS_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared `spark.checkpoint.dir`; only when unset (tests, local runs) pick a scratch folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="termlens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and read it back (lineage cut, columns pruned later)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/termlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
