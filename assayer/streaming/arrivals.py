"""Newly arrived files: validate, route, score once, append."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.filters import upload_verdict

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arrival_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of files landing in a folder."""
    return (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
            .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder))


def table_stream(spark: SparkSession, path: str, schema: StructType | str,
                 files_per_batch: int = 100, name_filter: str = "*") -> DataFrame:
    """Stream of rows from Parquet files landing in a folder; ``path`` may also be a single file.

    The last character stands as a pattern, since a stream takes a file by a pattern only.
    """
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", name_filter).parquet(re.sub(r"(\w)/*$", r"[\1]", path)))


def score_arrivals(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str,
                   checkpoint: str) -> StreamingQuery:
    """Score everything that has arrived since the last run and append it.

    The checkpoint remembers finished files, so a rerun scores only new ones.
    """
    return (scorer(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def validate_arrivals(stream: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Split a stream of (path, length, magic, ...) into an accepted and a rejected table.

    Each batch writes into its own folder, so a batch that is run again replaces itself.
    """
    judged = stream.withColumn("reason", upload_verdict(F.col("path"), F.col("length"), F.col("magic")))

    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for keep, folder in ((F.col("reason") == "ok", accepted), (F.col("reason") != "ok", rejected)):
            batch.filter(keep).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        batch.unpersist()

    return (judged.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
