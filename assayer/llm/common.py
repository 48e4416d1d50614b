"""What several operators of this folder share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the cluster's shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def seeded(seed: int, *cols) -> F.Column:
    """64-bit hash of the columns that depends on a seed and on nothing else."""
    return F.xxhash64(F.lit(seed), *cols)


@functools.cache
def _archive() -> str:
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="assayer-"), "assayer.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, in case it isn't installed there; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_archive())
        _shipped.add(app)
