"""Deterministic splits and exact-size samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import (
    BENCHMARK_GENERATORS, CV_FOLDS, DIFFUSION_GENERATORS, FUSION_CALIBRATION_GENERATORS,
    FUSION_REAL_PERCENT, HELD_OUT_GENERATORS, LABEL_FAKE, LABEL_REAL, SEED, SPLIT_PERCENT,
    TRAINING_GENERATORS,
)
from ..functions.hashing import hex_number, seeded_md5
from .ranking import seeded_parts


def allocation(n: Column, percent: Mapping[str, int] = SPLIT_PERCENT) -> dict[str, Column]:
    """Largest-remainder counts per split, as columns of the group size ``n``.

    Remainder ties go to the earlier split. A group with at least as many rows as
    splits leaves no split empty: empty ones take one row each from the largest.
    """
    names = list(percent)
    shares = [n.cast("bigint") * F.lit(percent[s]) for s in names]
    floors = [F.floor(x / 100).cast("bigint") for x in shares]
    rests = [F.pmod(x, F.lit(100)) for x in shares]
    left = n - sum(floors[1:], floors[0])
    counts = []
    for i, rest in enumerate(rests):
        ahead = sum(((other > rest) if j > i else (other >= rest)).cast("int")
                    for j, other in enumerate(rests) if j != i)
        counts.append(floors[i] + (ahead < left).cast("bigint"))
    filled = F.array(*counts)
    # Each pass moves one row from the first largest split to the first empty one.
    def refill(acc: Column, _step: Column) -> Column:
        hole = F.array_position(acc, F.lit(0).cast("bigint"))
        top = F.array_position(acc, F.array_max(acc))
        moved = F.transform(acc, lambda c, i: F.when(i + 1 == hole, F.lit(1).cast("bigint"))
                            .when(i + 1 == top, c - 1).otherwise(c))
        return F.when((hole > 0) & (F.aggregate(acc, F.lit(0).cast("bigint"), lambda a, c: a + c)
                                    >= len(names)), moved).otherwise(acc)
    fixed = F.aggregate(F.sequence(F.lit(1), F.lit(len(names))), filled, refill)
    return {s: F.element_at(fixed, i + 1) for i, s in enumerate(names)}


def _running(columns: list[Column]) -> list[Column]:
    out = [columns[0]]
    for c in columns[1:]:
        out.append(out[-1] + c)
    return out


def assign_splits(
    manifest: DataFrame, seed=SEED, percent: Mapping[str, int] = SPLIT_PERCENT,
    stratum: str = "generator", id_col: str = "sample_id",
) -> DataFrame:
    """Stratified train/val/test split with exact counts per stratum, set by the seed."""
    names = list(percent)
    def cuts(n: Column) -> list[Column]:
        counts = allocation(n, percent)
        return _running([counts[s] for s in names[:-1]])
    parts = seeded_parts(manifest.drop("split"), [stratum], id_col, seed, cuts, "_part")
    return parts.withColumn(
        "split", F.element_at(F.array(*[F.lit(s) for s in names]), F.col("_part") + 1)).drop("_part")


def ood_split(manifest: DataFrame) -> DataFrame:
    """Benchmark generators go to test; training generators stay in train or val."""
    gen, split = F.col("generator"), F.col("split")
    train_only = F.when(split == "test", F.lit("train")).otherwise(split)
    return manifest.withColumn("split", (
        F.when(F.col("label") == LABEL_REAL, split)
        .when(gen.isin(*BENCHMARK_GENERATORS), F.lit("test"))
        .when(gen.isin(*TRAINING_GENERATORS), train_only)
        .otherwise(F.lit("excluded"))))


def ood_split_by_family(manifest: DataFrame) -> DataFrame:
    """Diffusion and training generators to train or val, held-out families to test."""
    gen, split = F.col("generator"), F.col("split")
    train_only = F.when(split == "test", F.lit("train")).otherwise(split)
    return manifest.withColumn("split", (
        F.when(F.col("label") == LABEL_REAL, split)
        .when(gen.isin(*HELD_OUT_GENERATORS), F.lit("test"))
        .when(gen.isin(*DIFFUSION_GENERATORS, *TRAINING_GENERATORS), train_only)
        .otherwise(F.lit("excluded"))))


def reserve_fusion_calibration(
    manifest: DataFrame, seed=SEED, generators: Sequence[str] = FUSION_CALIBRATION_GENERATORS,
    percent: int = FUSION_REAL_PERCENT, id_col: str = "sample_id",
) -> DataFrame:
    """Move the calibration generators and ``percent`` of the test reals to ``fusion``.

    The share is rounded down, but two or more test reals give at least one, so that
    calibration has both classes.
    """
    pool = (F.col("label") == LABEL_REAL) & (F.col("split") == "test")
    parts = seeded_parts(
        manifest.withColumn("_pool", pool), ["_pool"], id_col, f"fusion{seed}",
        lambda n: [F.when(n >= 2, F.greatest(F.floor(n * percent / 100), F.lit(1))).otherwise(F.lit(0))], "_part")
    taken = (F.col("_pool") & (F.col("_part") == 0)) | (
        (F.col("label") == LABEL_FAKE) & F.col("generator").isin(*generators))
    return parts.withColumn("split", F.when(taken, F.lit("fusion")).otherwise(F.col("split"))
                            ).drop("_pool", "_part")


def balanced_sample(df: DataFrame, limit: int, seed=SEED, label: str = "label",
                    id_col: str = "sample_id") -> DataFrame:
    """Exactly ``min(limit // 2, class size)`` rows per label, without replacement."""
    return seeded_parts(df, [label], id_col, seed, lambda n: [F.lit(limit // 2)], "_part"
                        ).filter("_part = 0").drop("_part")


def exact_sample(df: DataFrame, n: int, seed=SEED, id_col: str = "sample_id") -> DataFrame:
    """Exactly ``n`` rows, or all of them when there are fewer."""
    return seeded_parts(df, [], id_col, seed, lambda _: [F.lit(n)], "_part").filter("_part = 0").drop("_part")


def stratified_folds(df: DataFrame, folds: int = CV_FOLDS, seed=SEED, label: str = "label",
                     id_col: str = "sample_id", out: str = "fold") -> DataFrame:
    """Fold numbers whose sizes differ by at most one inside each label."""
    cuts = lambda n: [F.floor(n * k / folds) for k in range(1, folds)]
    return seeded_parts(df, [label], id_col, seed, cuts, out)


def first_per_group(df: DataFrame, group: str, order: str, n: int,
                    name: str = "new_name", suffix: Column | None = None, digits: int = 5) -> DataFrame:
    """First ``n`` rows of each group by name, renamed ``<group>_<index>``.

    The rank filter lets the planner cut every input partition to ``n`` rows per
    group before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(group).orderBy(order))
    kept = df.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    label = F.concat(F.col(group), F.lit("_"), F.lpad((F.col("_rank") - 1).cast("string"), digits, "0"))
    return kept.withColumn(name, label if suffix is None else F.concat(label, suffix)).drop("_rank")


def list_ordered(listing: DataFrame, present: DataFrame, key: str, position: str, limit: int,
                 index: str = "present") -> DataFrame:
    """First ``limit`` listed items that are present, in list order.

    ``index='present'`` numbers the kept items; ``index='list'`` keeps their place in the list.
    """
    kept = listing.join(present.select(key), key, "left_semi").orderBy(position).limit(limit)
    if index == "list":
        return kept.withColumn("item_index", F.col(position))
    # The window sees at most ``limit`` rows.
    return kept.withColumn("item_index", F.row_number().over(W.orderBy(position)) - 1)


def fixed_size_resample(df: DataFrame, items: str, size: int, seed=SEED, id_col: str = "sample_id",
                        out: str | None = None) -> DataFrame:
    """Exactly ``size`` items per row.

    A shorter array keeps its items and is topped up with draws with replacement;
    a longer one is replaced by ``size`` draws, also with replacement.
    """
    arr = F.col(items)
    n = F.size(arr)
    def draw(k: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), k.cast("string")))
        return F.element_at(arr, (F.pmod(hex_number(h), n) + 1).cast("int"))
    def draws(count: Column) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), draw)).otherwise(
            F.slice(arr, 1, 0))
    filled = F.when(n == 0, arr).when(n > size, draws(F.lit(size))).otherwise(
        F.concat(arr, draws(F.lit(size) - n)))
    return df.withColumn(out or items, filled)


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count("*").alias("n"))


def difficulty_subsets(items: DataFrame, unconfident: DataFrame, misclassified: DataFrame,
                       key: str = "path") -> DataFrame:
    """Long table (subset, key): easy, unconfident, misclassified, prequalified.

    Hard lists keep only present items; easy is everything else; prequalified is
    both hard lists one after the other, duplicates kept.
    """
    present = items.select(key)
    un = unconfident.select(key).join(present, key, "left_semi")
    mis = misclassified.select(key).join(present, key, "left_semi")
    hard = un.union(mis)
    tag = lambda d, s: d.select(F.lit(s).alias("subset"), key)
    return (
        tag(present.join(hard.distinct(), key, "left_anti"), "easy")
        .unionAll(tag(un, "unconfident")).unionAll(tag(mis, "misclassified"))
        .unionAll(tag(hard, "prequalified"))
    )
