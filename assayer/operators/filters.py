"""Row predicates, normalisations and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import (
    ARCHIVE_PREFIX, EMPTY_CONTENT_LEVEL, GENERATOR_MAP, IMAGE_SUFFIXES, LABEL_REAL,
    MAX_UPLOAD_BYTES, STATUS_FAILED, STATUS_OK, TECHNIQUE_NAMES, UPLOAD_SUFFIXES,
)
from ..functions.numeric import sigmoid
from ..functions.paths import segment, suffix


def filter_generators(entries: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep all reals and the named generators."""
    return entries.filter((F.col("label") == LABEL_REAL) | F.col("generator").isin(*names))


def drop_excluded(manifest: DataFrame) -> DataFrame:
    return manifest.filter("split <> 'excluded'")


def normalise_scores(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Sigmoid a whole score vector when any of its finite values lies outside [0, 1].

    The range test is one small aggregate joined back, not a window over a vector.
    """
    by = list(by)
    finite = F.when(F.abs(F.col(score)) < float("inf"), F.col(score))     # neither NaN nor infinite
    ranges = scores.groupBy(*by).agg(
        (F.min(finite) < 0).alias("_low"), (F.max(finite) > 1).alias("_high"))
    ranges = ranges.select(*by, F.coalesce(F.col("_low") | F.col("_high"), F.lit(False)).alias("_logit"))
    from ..session import small_table
    return scores.join(small_table(ranges), by).withColumn(
        score, F.when(F.col("_logit"), sigmoid(F.col(score))).otherwise(F.col(score))).drop("_logit")


def validate_scores(scores: DataFrame, by: Sequence[str], expected: DataFrame | None = None,
                    score: str = "score") -> DataFrame:
    """One status row per technique: missing, non-finite and out-of-range counts."""
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    checks = scores.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(~finite).alias("n_not_finite"),
        F.count_if(finite & ((s < 0) | (s > 1))).alias("n_out_of_range"))
    if expected is not None:
        checks = checks.withColumn("n_expected", expected.agg(F.count("*").alias("c")).scalar())
    else:
        checks = checks.withColumn("n_expected", F.col("n"))
    error = (
        F.when(F.col("n") != F.col("n_expected"), F.lit("wrong length"))
        .when(F.col("n_not_finite") > 0, F.lit("not finite"))
        .when(F.col("n_out_of_range") > 0, F.lit("out of range")))
    return checks.withColumn("error", F.coalesce(error, F.lit(""))).withColumn(
        "status", F.when(error.isNull(), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_FAILED)))


# Leading bytes of the allowed formats, then of known others.
def allowed_image(magic: Column) -> Column:
    return magic.startswith("89504E470D0A1A0A") | magic.startswith("FFD8FF") | (
        magic.startswith("52494646") & (F.substring(magic, 17, 8) == "57454250"))


def other_image(magic: Column) -> Column:
    return (magic.startswith("424D") | magic.startswith("47494638")
            | magic.startswith("49492A00") | magic.startswith("4D4D002A"))


def known_image(magic: Column) -> Column:
    return allowed_image(magic) | other_image(magic)


def upload_verdict(path: Column, length: Column, magic: Column) -> Column:
    """Reason an upload is rejected, or ``ok``. ``magic`` is the hex of its first 12 bytes.

    The order is: present, found, size, suffix, recognisable content, allowed content.
    """
    allowed, other = allowed_image(magic), other_image(magic)
    return (
        F.when(path.isNull() | (path == ""), F.lit("no file"))
        .when(length.isNull(), F.lit("not found"))
        .when(length > MAX_UPLOAD_BYTES, F.lit("too large"))
        .when(~suffix(path).isin(*UPLOAD_SUFFIXES), F.lit("suffix not allowed"))
        .when(allowed, F.lit("ok"))
        .when(other, F.lit("content not allowed"))
        .otherwise(F.lit("corrupt or unknown")))


def archive_members(listing: DataFrame, name: str = "member",
                    names: Mapping[str, str] = GENERATOR_MAP) -> DataFrame:
    """Image members of an archive listing with their generator; unknown folders are dropped."""
    first = segment(F.col(name), 1)
    folder = F.when(first == ARCHIVE_PREFIX, segment(F.col(name), 2)).otherwise(first)
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return (
        listing.filter(suffix(F.col(name)).isin(*IMAGE_SUFFIXES) & ~F.col(name).endswith("/")
                       & (F.size(F.split(name, "/")) >= 2))
        .withColumn("generator", F.try_element_at(lookup, folder))
        .filter("generator is not null")
    )


def empty_pair(first_max: Column, second_max: Column, rule: str = "either",
               level: float = EMPTY_CONTENT_LEVEL) -> Column:
    """Whether a pair of maps counts as empty, from their maxima (0..255).

    ``either``: a map has no pixel above ``level``; ``either_zero``: a map is all
    zero; ``both_zero``: both are all zero.
    """
    if rule == "either":
        return (first_max <= level) | (second_max <= level)
    if rule == "either_zero":
        return (first_max == 0) | (second_max == 0)
    if rule == "both_zero":
        return (first_max == 0) & (second_max == 0)
    raise ValueError(f"unknown rule: {rule}")


def display_name(technique: Column, names: Mapping[str, str] = TECHNIQUE_NAMES) -> Column:
    """Display name, the technique itself when it has none."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, technique), technique)


def status_columns(results: DataFrame) -> DataFrame:
    """Display name, status, empty text for an absent error or seed."""
    return results.select(
        "*", display_name(F.col("technique")).alias("technique_name"),
        F.when(F.col("error").isNull(), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_FAILED)).alias("status"),
    ).withColumns({"error": F.coalesce("error", F.lit("")),
                   "seed": F.coalesce(F.col("seed").cast("string"), F.lit(""))})


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``, as a partial-aggregating max instead of a sort."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(ranked.alias("_r")).select(*key, "_r.*").select(*df.columns)


def technique_order(column: Column, order: Sequence[str]) -> Column:
    """Ordinal of a technique in the fixed report order."""
    return F.array_position(F.array(*[F.lit(t) for t in order]), column)
