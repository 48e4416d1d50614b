"""Sinks: manifests, metric tables, scores, logs, reports."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.integrity import balanced
from ..session import default_blocks
from .listing import can_open, opened

SUMMARY_LEADING = ("protocol", "technique", "technique_name", "condition", "seed", "status")
GENERATOR_LEADING = ("protocol", "technique", "condition", "seed", "generator")


def write_manifest(entries: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Partitioned by split, so that reading one split prunes the others; CSV stays flat."""
    if fmt == "csv":
        entries.select("path", "label", "generator", "split").write.mode("overwrite").option("header", True).csv(path)
    else:
        entries.write.mode("overwrite").partitionBy("split").format(fmt).save(path)
    return path


def union_results(frames: Sequence[DataFrame], leading: Sequence[str] = SUMMARY_LEADING) -> DataFrame:
    """Union of rows with different columns; identifying columns first, the rest by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    first = [c for c in leading if c in out.columns]
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def write_files(df: DataFrame, root: str, folders: Sequence[str], text: str, spread_by: str) -> str:
    """Each row as a text file of its own, one line, in ``key=value`` folders below ``root``; a null text is an empty file.

    Tasks write the files in place, each in folders of its own, so nothing is renamed or listed by the driver. Names count the files
    of a folder: a task that is run again replaces what it wrote. Where executors can't reach the path, Spark's own writer does it.
    """
    folders = list(folders)
    rows = df.repartition(default_blocks(df.sparkSession), spread_by).select(*folders, text)
    if not can_open(root):
        rows.write.option("maxRecordsPerFile", 1).partitionBy(*folders).text(root)
        return root

    def escaped(value) -> str:      # as Spark escapes the names of its own folders
        if value in (None, ""):
            return "__HIVE_DEFAULT_PARTITION__"
        return re.sub(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", str(value))

    def write(batches):
        place, inside = opened(root)
        numbers, task = Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for *values, line in zip(*(batch.column(c).to_pylist() for c in (*folders, text))):
                folder = "/".join((inside.rstrip("/"), *(f"{k}={escaped(v)}" for k, v in zip(folders, values)), f"{task:05d}"))
                if folder not in numbers:
                    place.create_dir(folder, recursive=True)
                with place.open_output_stream(f"{folder}/{numbers[folder]}.txt") as out:
                    if line is not None:
                        out.write(line.encode() + b"\n")
                numbers[folder] += 1
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    opened(root)[0].create_dir(opened(root)[1], recursive=True)
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return root


def write_scores(scores: DataFrame, path: str,
                 by: Sequence[str] = ("protocol", "technique", "condition")) -> str:
    """Raw scores, one folder per protocol, technique and condition.

    Folders are rebalanced by their size: Spark cuts a hot technique into as many tasks and files as its data needs.
    """
    (scores.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path))
    return path


def run_log(results: DataFrame) -> DataFrame:
    """Number of results and the failures, as one JSON document.

    One row per (protocol, technique, condition): the list is bounded by the run's size.
    """
    failure = F.when(F.col("error").isNotNull(), F.struct("protocol", "technique", "condition", "error"))
    return results.agg(
        F.count("*").alias("n_results"),
        F.to_json(F.array_sort(F.collect_list(failure))).alias("failures"),
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("timestamp"))


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Add rows to an existing table."""
    return write_table(df, path, fmt, "append")


def corpus_counts(entries: DataFrame) -> DataFrame:
    """Files of each generator and source."""
    return entries.groupBy("label", "generator", "source").agg(F.count("*").alias("n"))


def corpus_info(entries: DataFrame) -> DataFrame:
    """Totals of ``corpus_counts`` and the balance flag."""
    per = corpus_counts(entries)
    return per.groupBy().agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("total_fake"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("total_real"),
        F.count_distinct(F.when(F.col("label") == 1, F.col("generator"))).alias("n_generators"),
        F.count_distinct(F.when(F.col("label") == 0, F.col("source"))).alias("n_sources"),
    ).withColumn("balanced", balanced(F.col("total_real"), F.col("total_fake")))
