"""Sources: corpus trees, manifests, score files, component tables, listings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.errors import AnalysisException

from ..constants import (
    COMPONENTS, FAILURE_LOG_MARK, LABEL_FAKE, LABEL_REAL, LEGACY_SCORE_COLUMNS, NAME_COLUMNS,
    PATH_COLUMNS, PUBLISHED, REAL, SCORE_COLUMNS,
)
from ..functions.numeric import blank_to_null
from ..functions.paths import basename, posix_path, stem
from ..operators.filters import keep_last
from ..operators.ranking import row_numbers
from ..session import default_blocks, materialize, small_table
from .listing import can_open, first_lines, list_tree

# ``real/<source>/`` and ``fake/<generator>/``, plain or as ``key=value`` folders.
_TREE = r"/(?:[A-Za-z_]+=)?(real|fake)/(?:[A-Za-z_]+=)?([^/]+)/"


def from_tree(path: Column) -> dict[str, Column]:
    """Label, generator and source derived from a corpus path."""
    top = F.regexp_extract(path, _TREE, 1)
    folder = F.regexp_extract(path, _TREE, 2)
    return {
        "label": F.when(top == "real", LABEL_REAL).when(top == "fake", LABEL_FAKE),
        "generator": F.when(top == "real", F.lit(REAL)).otherwise(folder),
        "source": folder,
    }


def list_corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per file under ``real/`` and ``fake/``, listed level by level on executors; ``hidden`` ones are named like Spark's own files."""
    files = list_tree(spark, root).filter("not folder")
    return files.withColumns(from_tree(F.col("path"))).filter("label is not null").drop("folder").withColumn("sample_id", F.col("path")).withColumnRenamed("length", "size")


def scan_corpus(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """One row per file under ``real/`` and ``fake/``. Bytes are read only on request.

    With content, ``content_hash`` is its md5 and ``magic`` the hex of its first 12 bytes. Files whose names begin with ``_`` or
    a dot are left out; :func:`list_corpus` counts them. Without content, files are listed by executors where they can reach them.
    """
    if not with_content and can_open(root):
        try:
            return list_corpus(spark, root).filter("not hidden").drop("hidden")
        except FileNotFoundError as error:
            raise FileNotFoundError(f"corpus not found: {root}") from error
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "[!_.]*").load(root))
    except AnalysisException as error:
        raise FileNotFoundError(f"corpus not found: {root}") from error
    tree = files.withColumns(from_tree(F.col("path"))).filter("label is not null")
    if with_content:
        tree = tree.withColumns({
            "content_hash": F.md5("content"), "magic": F.hex(F.substring("content", 1, 12))})
    return tree.drop("content").withColumn("sample_id", F.col("path")).withColumnRenamed("length", "size")


def read_manifest(spark: SparkSession, path: str, split: str | None = None,
                  fmt: str = "csv") -> DataFrame:
    """Manifest rows, optionally of one split (a partition filter for a partitioned manifest)."""
    try:
        if fmt == "csv":
            # Columns are found by name, whatever their order in the file.
            df = spark.read.option("header", True).csv(path).select(
                "path", F.col("label").cast("int").alias("label"), "generator", "split")
        else:
            df = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no manifest at {path}; run the prepare job first") from error
    if split is None:
        return df
    part = df.filter(F.col("split") == split)
    if part.isEmpty():
        raise ValueError(f"split '{split}' is empty in {path}")
    return part


def entry_columns(entries: DataFrame) -> DataFrame:
    return entries.select("path", "label", "generator")


def work_list(manifest: DataFrame, split: str | None = None, limit: int | None = None,
              suffix: str = "png", order: str = "path") -> DataFrame:
    """Rows to process: class name, posix origin, output name; limited in ``order``."""
    rows = manifest if split is None else manifest.filter(F.col("split") == split)
    origin = posix_path(F.col("path"))
    rows = rows.select(
        *[c for c in manifest.columns if c in ("sample_id", "label", "generator")],
        origin.alias("origin"), F.coalesce("split", F.lit("all")).alias("division"),
        F.when(F.col("label") == LABEL_REAL, F.lit("real")).otherwise(F.lit("gen")).alias("class_name"),
        F.concat(stem(origin), F.lit(f".{suffix}")).alias("name"), F.col(order).alias("_o"))
    if limit is not None:
        rows = rows.orderBy("_o").limit(limit)
    return rows.drop("_o")


def name_collisions(work: DataFrame) -> DataFrame:
    """Output places claimed by more than one origin; must be empty before writing."""
    return work.groupBy("division", "class_name", "name").agg(
        F.count("*").alias("n"), F.min("origin").alias("first"), F.max("origin").alias("last")
    ).filter("n > 1")


def resolve(columns: Sequence[str], accepted: Sequence[str]) -> str | None:
    """First accepted column name that is present."""
    return next((c for c in accepted if c in columns), None)


_PART = r"/part-[^/]*$"         # a file that is one part of a result, whose name is its folder's


def in_file_order(raw: DataFrame) -> DataFrame:
    """The rows of text files with ``_f``, ``_b`` and ``_o``, which sort as the rows stand: by file, place of the block read, row.

    Parts of one folder come by their number, other files by path.
    """
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1)
    file = F.concat_ws("/", F.regexp_replace(path, _PART, ""), F.lpad(number, 20, "0"), path)
    return raw.select(*raw.columns, file.alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_o"))


def with_position(ordered: DataFrame, out: str = "position") -> DataFrame:
    """Dense 0-based numbers over all files, from the counts of the blocks that were read; rows are neither sorted nor shuffled.

    Written once, so that the numbers within a block stay true. A block's rows have consecutive numbers ``_o``.
    """
    kept = materialize(ordered, "ordered")
    before = W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)     # one row for each block of a file
    blocks = small_table(kept.groupBy("_f", "_b").agg(F.count("*").alias("_c"), F.min("_o").alias("_first")).select(
        "_f", "_b", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start")))
    return (kept.join(blocks, ["_f", "_b"]).withColumn(out, F.col("_start") + F.col("_o") - F.col("_first"))
            .drop("_f", "_b", "_o", "_first", "_start"))


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(name, score) from the first score file by name; the last row of a name wins.

    A file that is a part of a result stands for all parts of it. Without a path column the rows are
    (position, score), numbered in the order of parts and rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    first = files.select(F.min("path").alias("p")).first()["p"]
    if first is None:
        raise FileNotFoundError(f"no score file in {folder}")
    whole = spark.read.option("header", True)
    if re.search(_PART, first):
        raw = whole.option("pathGlobFilter", "part-*.csv").csv(folder)
    else:
        raw = whole.csv(first)
    score, path = resolve(raw.columns, SCORE_COLUMNS), resolve(raw.columns, PATH_COLUMNS)
    if score is None:
        raise ValueError(f"no score column among {raw.columns}")
    value = blank_to_null(F.col(score)).alias("score")
    ordered = in_file_order(raw)
    if path is None:
        return with_position(ordered.select(value, "_f", "_b", "_o"))
    named = ordered.select(basename(F.col(path)).alias("name"), value, "_f", "_b", "_o")
    return keep_last(named, ["name"], ["_f", "_b", "_o"]).drop("_f", "_b", "_o")


def by_position(entries: DataFrame, scores: DataFrame, order: str) -> DataFrame:
    """Positional alignment for a score file without paths; lengths must be equal."""
    n, m = entries.count(), scores.count()
    if n != m:
        raise ValueError(f"{m} scores for {n} entries and no path column")
    left = row_numbers(entries, order)
    return left.join(scores.withColumnRenamed("position", "row_number"), "row_number").drop("row_number")


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(name, split, label, components): three columns, or a single legacy column
    that is ``object_shadow``. A blank cell stays missing."""
    raw = spark.read.option("header", True).csv(path)
    present = [c for c in COMPONENTS if c in raw.columns]
    legacy = None if present else resolve(raw.columns, LEGACY_SCORE_COLUMNS)
    cell = lambda c: (
        blank_to_null(F.col(c)) if c in present
        else blank_to_null(F.col(legacy)) if legacy and c == "object_shadow"
        else F.lit(None).cast("double"))
    return raw.select(F.col(resolve(raw.columns, NAME_COLUMNS)).alias("name"), "split", F.col("label").cast("int").alias("label"),
                      *[cell(c).alias(c) for c in COMPONENTS])


_FILE_KEY = {"name": "_metadata.file_name", "path": "_metadata.file_path"}


def _headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, columns) of every file; where only Spark can open them, from a pass over the text."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("file"), "path")
    if can_open(pattern):
        return first_lines(files.repartition(default_blocks(spark), "path"))
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                            F.monotonically_increasing_id().alias("o"), "value")
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "o").alias("line"))
    return first.select("file", F.transform(F.split("line", ","), lambda c: F.regexp_replace(c, '^"|"$', "")).alias("columns"))


def read_component_files(spark: SparkSession, pattern: str, column: str,
                         skip: str = FAILURE_LOG_MARK, by: str = "name") -> DataFrame:
    """(name, split, label, score) over many files; for a repeated name the last file wins,
    files being ordered by ``name`` or, for folders of parts, by ``path``.

    Files whose name contains ``skip`` and files without the column are left out. The first line of each file is read on executors and tells
    where its columns stand; then all files are one scan, whatever their layouts, joined to these places by file. No
    file name comes to the driver.
    """
    have = lambda c: F.array_position("columns", c).cast("int")
    name = F.coalesce(*[F.when(have(c) > 0, have(c)) for c in NAME_COLUMNS])
    places = small_table(
        _headers(spark, pattern).filter(~F.element_at(F.split("file", "/"), -1).contains(skip))
        .filter((have(column) > 0) & name.isNotNull() & (have("split") > 0) & (have("label") > 0))
        .select("file", F.size("columns").alias("width"), name.alias("n"), have("split").alias("s"), have("label").alias("l"), have(column).alias("v")))
    widest = places.agg(F.max("width")).first()[0]
    if widest is None:
        raise FileNotFoundError(f"no file with column {column} at {pattern}")
    cells = [f"c{i}" for i in range(widest)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", True).option("enforceSchema", True).csv(pattern)
    rows = raw.select(F.array(*cells).alias("cells"), F.col("_metadata.file_path").alias("file"), F.col(_FILE_KEY[by]).alias("_f"),
                      F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_o")).join(places, "file")
    cell = lambda at: F.element_at("cells", F.col(at))
    out = rows.select(cell("n").alias("name"), cell("s").alias("split"), cell("l").cast("int").alias("label"), blank_to_null(cell("v")).alias("score"), "_f", "_b", "_o")
    return keep_last(out, ["name"], ["_f", "_b", "_o"]).drop("_f", "_b", "_o")


def read_stored_scores(spark: SparkSession, path: str, expected: DataFrame,
                       by: Sequence[str] = ("technique",)) -> DataFrame:
    """Stored score vectors whose length equals the expected set; others are skipped."""
    scores = spark.read.parquet(path)
    n = expected.agg(F.count("*").alias("n")).scalar()
    full = scores.groupBy(*by).agg(F.count("*").alias("n_scores")).filter(F.col("n_scores") == n)
    whole = small_table(full.select(*by))
    return scores.join(whole, list(by), "left_semi")


def latest_result(spark: SparkSession, pattern: str, schema: str, technique: str,
                  by: str = "name") -> DataFrame:
    """Rows of one technique from the newest result by name (or by path).

    A result is a file, or a folder of parts, all of which count.
    """
    result = F.regexp_replace(F.col("_metadata.file_path"), _PART, "")
    rows = spark.read.schema(schema).option("header", True).csv(pattern).withColumn(
        "_f", result if by == "path" else F.element_at(F.split(result, "/"), -1))
    newest = rows.agg(F.max("_f").alias("_f")).scalar()
    return rows.filter((F.col("_f") == newest) & (F.col("technique") == technique)).drop("_f")


def read_score_map(json_text: DataFrame, column: str = "value") -> DataFrame:
    """(name, score) from JSON objects ``{path: score}``."""
    return json_text.select(F.explode(F.from_json(column, "map<string,double>")).alias("path", "score")).select(
        basename(F.col("path")).alias("name"), "score")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ragged geometry: (path, lines) with four coordinates per line."""
    return spark.read.schema("path string, lines array<array<float>>").parquet(path)


def pairs_present(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items present on both sides."""
    return first.join(second, list(key), "inner")


def pairs_dropped(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many items of the first side lack a partner."""
    return first.join(second, list(key), "left_anti").agg(F.count("*").alias("n_dropped"))


def published_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED, "generator string, published_auc double, native_side int")
