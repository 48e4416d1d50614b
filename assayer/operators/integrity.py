"""Corpus integrity: counts, duplicates, leakage, balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    BENCHMARK_GENERATORS, IMBALANCE_RATIO, LABEL_FAKE, LABEL_REAL, REAL, TRAINING_GENERATORS,
)
from ..functions.numeric import ratio
from ..session import materialize
from .filters import known_image
from .ranking import hot_key_join


def wrong_size(width: Column, height: Column, expected: int) -> Column:
    """Size differs from the expected side; an expected side of 0 disables the check."""
    if expected == 0:
        return F.lit(False)
    return (width != expected) | (height != expected)


def duplicate_groups(entries: DataFrame, hash_col: str = "content_hash",
                     id_col: str = "sample_id") -> DataFrame:
    """One row per content that occurs in two or more files: size and first id."""
    return (
        entries.filter(F.col(hash_col).isNotNull()).groupBy(hash_col)
        .agg(F.count("*").alias("n_copies"), F.min(id_col).alias("first_id"))
        .filter("n_copies > 1")
    )


def duplicate_members(entries: DataFrame, hash_col: str = "content_hash",
                      id_col: str = "sample_id") -> DataFrame:
    """Every copy with its group, one row each; a group is never gathered in one task."""
    groups = materialize(duplicate_groups(entries, hash_col, id_col).withColumn("_w", F.col("n_copies")), "duplicates")
    total = entries.agg(F.count("*").alias("_total"))
    rows = entries.filter(F.col(hash_col).isNotNull()).select(id_col, hash_col)
    return hot_key_join(rows, groups, [hash_col], "_w", total, id_col).filter("n_copies is not null")


def leakage(manifest: DataFrame, key: str = "content_hash", id_col: str = "sample_id") -> DataFrame:
    """Contents (or paths) that occur in more than one split."""
    return (
        manifest.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count("*").alias("n_rows"))
        .filter(F.size("splits") > 1)
        .withColumn("splits", F.array_join("splits", ","))
    )


def counts_by(entries: DataFrame, column: str) -> DataFrame:
    return entries.groupBy(column).agg(F.count("*").alias("n"))


def unreadable(entries: DataFrame, hash_col: str = "content_hash") -> Column:
    """No content, or content that begins like no known image format."""
    bad = F.col(hash_col).isNull()
    return bad | ~F.coalesce(known_image(F.col("magic")), F.lit(False)) if "magic" in entries.columns else bad


def integrity_report(entries: DataFrame, width: str | None = None, height: str | None = None,
                     expected: int = 0, check_duplicates: bool = True,
                     hash_col: str = "content_hash", corrupted: Column | None = None) -> DataFrame:
    """One row of totals; ``ok`` when nothing is corrupted, wrong-sized or duplicated.

    Unless ``corrupted`` says otherwise, content is unreadable if its hash is NULL or, where entries have ``magic``
    (the hex of the first bytes), if these are no image format's. Offending files stay in the manifest;
    ``problem_files`` lists them.
    """
    bad = unreadable(entries, hash_col) if corrupted is None else corrupted
    size_bad = wrong_size(F.col(width), F.col(height), expected) if width else F.lit(False)
    totals = entries.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("label") == LABEL_REAL).alias("n_real"),
        F.count_if(F.col("label") == LABEL_FAKE).alias("n_fake"),
        F.count_if(bad).alias("n_corrupted"), F.count_if(size_bad).alias("n_wrong_size"))
    if check_duplicates:
        dup = duplicate_groups(entries, hash_col)
        totals = totals.withColumn(
            "n_duplicate_groups", dup.agg(F.count("*").alias("g")).scalar())
    else:
        totals = totals.withColumn("n_duplicate_groups", F.lit(0).cast("bigint"))
    return totals.withColumn("ok", (F.col("n_corrupted") == 0) & (F.col("n_wrong_size") == 0)
                             & (F.col("n_duplicate_groups") == 0))


def problem_files(entries: DataFrame, corrupted: Column, size_bad: Column) -> DataFrame:
    """One row per offending file with its problem."""
    return entries.withColumn(
        "problem", F.when(corrupted, F.lit("corrupted")).when(size_bad, F.lit("wrong_size"))
    ).filter("problem is not null")


def unexpected_generators(entries: DataFrame, known: Sequence[str] = BENCHMARK_GENERATORS + TRAINING_GENERATORS) -> DataFrame:
    """Generators outside the known list, with their counts."""
    return counts_by(entries.filter(
        (F.col("label") == LABEL_FAKE) & ~F.col("generator").isin(*known)), "generator")


def imbalance(entries: DataFrame, warn_ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """Spread between the largest and smallest generator."""
    per = counts_by(entries.filter(F.col("generator") != REAL), "generator")
    return per.agg(F.min("n").alias("smallest"), F.max("n").alias("largest")).withColumn(
        "spread", ratio(F.col("largest"), F.col("smallest"))
    ).withColumn("imbalanced", F.col("spread") > warn_ratio)


def balanced(n_real: Column, n_fake: Column) -> Column:
    """As many reals as fakes, within one percent of the reals or one file."""
    return F.abs(n_real - n_fake) <= F.greatest(F.lit(1.0), 0.01 * n_real)


def class_balance(entries: DataFrame) -> DataFrame:
    """Fake-to-real ratio, its warning above 1.5, and the 1:1-within-1% flag."""
    return entries.agg(
        F.count_if(F.col("label") == LABEL_FAKE).alias("n_fake"),
        F.count_if(F.col("label") == LABEL_REAL).alias("n_real"),
    ).withColumn("fake_to_real", ratio(F.col("n_fake"), F.col("n_real"))).withColumns({
        "warn": F.col("fake_to_real") > IMBALANCE_RATIO,
        "balanced": balanced(F.col("n_real"), F.col("n_fake")),
    })


def most_common(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller value."""
    return counts_by(df, column).orderBy(F.desc("n"), column).limit(k)
