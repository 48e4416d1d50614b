"""Folders listed and first lines read on executors; the driver holds neither names nor statuses of files."""

from __future__ import annotations

import csv
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import default_blocks, materialize

LISTED = "path string, modificationTime timestamp, length bigint, folder boolean, hidden boolean"
BATCH = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path; a path without scheme is local."""
    if re.match(r"^file:/+", path) or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def can_open(path: str) -> bool:
    """Whether executors can reach the path without Spark's own readers."""
    return re.match(r"^(file:/|(hdfs|s3|gs|gcs|abfs|abfss)://)", path) is not None or "://" not in path


def _children(path: str):
    place, inside = opened(path)
    start = path.rstrip("/")
    for info in place.get_file_info(fs.FileSelector(inside)):
        yield (f"{start}/{info.base_name}", info.mtime, info.size, info.type == fs.FileType.Directory, info.base_name[:1] in "_.")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, folder, hidden) of everything below ``root``, level by level.

    The folders of a level are a table; tasks list some each. Hidden folders are listed as such and not entered. The driver
    learns only whether there is a next level.
    """
    place, inside = opened(root)
    if place.get_file_info(inside).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder at {root}")
    root = root if "://" in root else "file:" + re.sub(r"^file:/*", "/", root)

    def each(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                for row in _children(path):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield packed(rows)
                        rows = []
            yield packed(rows)

    kinds = (pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.bool_(), pa.bool_())

    def packed(rows):
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in LISTED.split(", ")])

    folders, out = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = materialize(folders.repartition(default_blocks(spark), "path").mapInArrow(each, LISTED), "listing")
        out = level if out is None else out.unionByName(level)
        folders = level.filter("folder and not hidden").select("path")
        if folders.isEmpty():
            return out


def first_lines(files: DataFrame) -> DataFrame:
    """(file, columns): the cells of the first line of each ``path``, quotes resolved; nothing else of a file is read."""

    def each(batches):
        for batch in batches:
            names, cells = [], []
            for name, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist()):
                place, inside = opened(path)
                with place.open_input_stream(inside) as stream:
                    head = b""
                    while b"\n" not in head and (more := stream.read(1 << 16)):
                        head += more
                line = head.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r")
                names.append(name)
                cells.append(next(csv.reader([line]), []))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cells, pa.list_(pa.string()))], ["file", "columns"])

    return files.select("file", "path").mapInArrow(each, "file string, columns array<string>")
