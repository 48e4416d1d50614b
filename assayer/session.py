"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(master: str | None = None, app: str = "assayer", **conf: str) -> SparkSession:
    """A session with adaptive execution; the cluster's own settings win where set."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` isn't set, a session on one machine gets a local folder; on a cluster
    that is an error, since executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir names no shared folder for {master}")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, purpose: str = "lookup") -> DataFrame:
    """A lookup table written once, so that Spark knows its size when it plans the join.

    Nothing comes to the driver and the plan has one form: Spark broadcasts the table if it is below
    ``spark.sql.autoBroadcastJoinThreshold``, else shuffles, and splits skewed keys.
    """
    return materialize(df, purpose)


def default_blocks(spark: SparkSession) -> int:
    """How many ordered blocks a ranked group is cut into."""
    return max(1, min(8192, int(spark.conf.get("spark.sql.shuffle.partitions"))))
