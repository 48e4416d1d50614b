"""Order statistics without ever sorting a whole group in one task.

A group may hold a third of all rows, so every ranked group is cut into ordered
blocks. Rows are ranked inside (group, block); the offsets between blocks are a
prefix sum over at most ``n_blocks`` rows per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import seeded_md5
from ..session import default_blocks, materialize, small_table

HASH_DIGITS = 3  # 4096 hash blocks per group


# --- blocks of equal row counts over a numeric column ----------------------

def quantiles(df: DataFrame, value: str, n_blocks: int) -> DataFrame:
    """One row with the ``n_blocks - 1`` inner quantiles of ``value``; NULL without rows.

    Sketches of the input tasks are merged in two levels, so the last task sees few.
    """
    probs = F.array(*[F.lit(i / n_blocks) for i in range(1, n_blocks)])
    size = max(200, min(65535, 4 * n_blocks))
    some = df.filter(F.col(value).isNotNull()).select(
        F.pmod(F.spark_partition_id(), F.lit(64)).alias("_t"), F.col(value).cast("double").alias("_v"))
    parts = some.groupBy("_t").agg(F.kll_sketch_agg_double("_v", size).alias("_k"))
    merged = parts.agg(F.kll_merge_agg_double("_k", size).alias("_k"))
    return merged.select(F.when(
        F.kll_sketch_get_n_double("_k") > 0, F.kll_sketch_get_quantile_double("_k", probs)).alias("_q"))


def block_of(value: Column, splits: Column, n_splits: int) -> Column:
    """Number of split points below ``value``, by binary search."""
    if n_splits == 0:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(n_splits.bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(
            (pos + step <= F.lit(n_splits)) & (F.try_element_at(splits, pos + step) < value),
            pos + step,
        ).otherwise(pos),
    )
    # Never NULL, so a join on it adds no filter below the histogram and its shuffle is reused.
    return F.coalesce(found, F.lit(0))


def with_block(df: DataFrame, source: DataFrame, value: str, n_blocks: int | None = None,
               out: str = "_blk") -> DataFrame:
    """Add the block id of ``value``, split points being a scalar subquery over ``source``.

    For plans that read the block once. Quantiles are taken over all rows of
    ``source``, so no (group, block) holds more than about ``rows / n_blocks`` rows.
    """
    n = n_blocks or default_blocks(df.sparkSession)
    if n == 1:
        return df.withColumn(out, F.lit(0))
    pointed = df.withColumn("_q", quantiles(source, value, n).scalar())
    return pointed.withColumn(out, block_of(F.col(value), F.col("_q"), n - 1)).drop("_q")


def fixed_points(df: DataFrame, value: str, n_blocks: int | None = None) -> list[float]:
    """Split points taken once, with repeats: a value listed twice holds a whole block's share of rows."""
    n = n_blocks or default_blocks(df.sparkSession)
    points = quantiles(df, value, n).first()["_q"] if n > 1 else None
    return sorted(float(p) for p in points or [])


def fixed_block(df: DataFrame, value: str, n_blocks: int | None = None) -> Column:
    """Block id with split points fixed as literals.

    For plans that read the block on two sides of a join: the points are taken
    once, so both sides agree even when a stage is run again.
    """
    points = sorted(set(fixed_points(df, value, n_blocks)))
    if not points:
        return F.lit(0)
    return block_of(F.col(value), F.array(*[F.lit(p) for p in points]), len(points))


def row_points(df: DataFrame, value: str, n_blocks: int | None = None) -> tuple[list[float], Column]:
    """(distinct split points, is_single) for ranking rows that are not reduced to a histogram.

    A value that repeats among the split points is frequent and gets an odd block
    of its own, which needs no ordering; even blocks hold no frequent value.
    """
    points = fixed_points(df, value, n_blocks)
    unique = sorted(set(points))
    hot = sorted({p for p in unique if points.count(p) > 1})
    return unique, F.coalesce(F.col(value).isin(*hot), F.lit(False)) if hot else F.lit(False)


def row_blocks(df: DataFrame, value: str, n_blocks: int | None = None) -> tuple[Column, Column]:
    """(block, is_single) as expressions, with the points of :func:`row_points`."""
    points, single = row_points(df, value, n_blocks)
    return block_of(F.col(value), F.array(*[F.lit(p) for p in points]), len(points)) * 2 + single.cast("int"), single


def with_row_block(df: DataFrame, value: str, points: Sequence[float], single: Column, out: str = "_blk") -> DataFrame:
    """Add the block of :func:`row_blocks`, one projection for each step of the binary search.

    Projections are compiled and the lambda of :func:`block_of` isn't, which tells where every row is looked up.
    """
    depth = len(points).bit_length()
    # NaN is below no value, so no step leads past the last point.
    splits = F.array(*[F.lit(p) for p in points], *[F.lit(math.nan)] * ((1 << depth) - 1 - len(points)))
    df = df.withColumn(out, F.lit(0))
    for step in (1 << k for k in reversed(range(depth))):
        df = df.withColumn(out, F.col(out) + F.when(F.get(splits, F.col(out) + (step - 1)) < F.col(value), step).otherwise(0))
    return df.withColumn(out, F.col(out) * 2 + single.cast("int"))


def row_numbers(df: DataFrame, order: str, out: str = "row_number") -> DataFrame:
    """Dense 0-based numbers in the order of a column, from a range-partitioned sort.

    The sorted rows are written once so that partition offsets stay true.
    """
    ordered = materialize(df.orderBy(order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    # One row per sorted partition, so this window is small.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_c")).select(
        "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    starts = small_table(starts)
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return (ordered.withColumn("_part", part).join(starts, "_part")
            .withColumn(out, F.col("_start") + local).drop("_part", "_start", "_m"))


# --- exact seeded ranks -----------------------------------------------------

def _hashed(df: DataFrame, id_col: str, seed) -> DataFrame:
    h = df.withColumn("_h", seeded_md5(seed, id_col))
    return h.withColumn("_blk", F.substring("_h", 1, HASH_DIGITS))


def _block_starts(hashed: DataFrame, keys: Sequence[str]) -> DataFrame:
    by_block = W.partitionBy(*keys).orderBy("_blk")
    return (
        hashed.groupBy(*keys, "_blk").agg(F.count("*").alias("_cnt"))
        .withColumn("_start", F.coalesce(
            F.sum("_cnt").over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )


def seeded_rank(df: DataFrame, keys: Sequence[str], id_col: str, seed) -> DataFrame:
    """Add ``seeded_rank`` (1-based) of every row in its group, by (md5, id)."""
    hashed = _hashed(df, id_col, seed)
    local = F.row_number().over(W.partitionBy(*keys, "_blk").orderBy("_h", id_col))
    starts = _block_starts(hashed, keys).drop("_cnt")
    return (
        hashed.withColumn("_local", local)
        .join(starts, [*keys, "_blk"])
        .withColumn("seeded_rank", F.col("_start") + F.col("_local"))
        .drop("_h", "_blk", "_local", "_start")
    )


def seeded_parts(
    df: DataFrame, keys: Sequence[str], id_col: str, seed, cuts_of, out: str = "part",
) -> DataFrame:
    """Cut every group at exact seeded ranks; add the 0-based part number ``out``.

    ``cuts_of(n)`` maps the group size column to cut columns; a row of rank r falls in
    part ``#{c : r > c}``. The rows are neither shuffled nor sorted: hash blocks are
    counted, the one block around each cut (about 1/4096 of the rows) is ranked
    to find the (md5, id) at the cut, and every row compares itself to those.
    """
    cols = [*df.columns, out]
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    keys = list(keys)
    hashed = _hashed(df, id_col, seed)
    slim = hashed.select(*keys, F.col(id_col).alias("_id"), "_h", "_blk")
    starts = _block_starts(slim, keys).withColumn("_n", F.sum("_cnt").over(W.partitionBy(*keys)))
    cuts = F.array(*[c.cast("bigint") for c in cuts_of(F.col("_n"))])
    inside = (F.col("_cut") > F.col("_start")) & (F.col("_cut") <= F.col("_start") + F.col("_cnt"))
    places = small_table(
        starts.select(*keys, "_blk", "_cnt", "_start", F.posexplode(cuts).alias("_i", "_cut"))
        .filter(inside | ((F.col("_cut") <= 0) & (F.col("_start") == 0)))
        .select(*keys, "_blk", "_i", F.greatest(F.lit(0).cast("bigint"), F.col("_cut") - F.col("_start")).alias("_rest")))
    local = F.row_number().over(W.partitionBy(*keys, "_blk").orderBy("_h", "_id"))
    edge = slim.join(places.select(*keys, "_blk").distinct(), [*keys, "_blk"], "left_semi").withColumn("_local", local)
    at_cut = edge.join(places.filter("_rest > 0"), [*keys, "_blk"]).filter("_local = _rest")
    id_type = df.schema[id_col].dataType.simpleString()
    # A cut at or below zero puts the whole group above it: no md5 is below the empty text.
    from_start = places.filter("_rest = 0").select(
        *keys, "_i", F.lit("").alias("_h"), F.lit(None).cast(id_type).alias("_id"))
    bounds = small_table(
        at_cut.select(*keys, "_i", "_h", "_id").unionByName(from_start)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_h", "_id"))).alias("_bounds")))
    none = F.array().cast(f"array<struct<_i:int,_h:string,_id:{id_type}>>")
    above = lambda b: (F.col("_h") > b["_h"]) | ((F.col("_h") == b["_h"]) & (F.col(id_col) > b["_id"]))
    return (
        hashed.join(bounds, keys, "left")
        .withColumn(out, F.size(F.filter(F.coalesce("_bounds", none), above)))
        .select(*cols)
    )


# --- joins that tolerate hot keys -------------------------------------------

def hot_key_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str, total: DataFrame,
    spread_by: str, share: int | None = None,
) -> DataFrame:
    """Left join where a few keys of ``rows`` may be very frequent.

    ``lookup`` has one row per key and ``weight`` = how many rows carry it;
    ``total`` is one row with ``_total``. Keys above ``1/share`` of all rows number at
    most ``share`` and are broadcast; their rows are spread over the shuffle of
    the remaining keys, each of which is a fraction of a mean partition.
    """
    on = list(on)
    share = share or max(256, 4 * default_blocks(rows.sparkSession))
    values = [c for c in lookup.columns if c not in on and c != weight]
    limit = total.select(F.ceil(F.col("_total") / share).cast("bigint")).scalar()
    hot = small_table(
        lookup.filter(F.col(weight) >= limit).drop(weight)
        .withColumnsRenamed({v: f"_hot_{v}" for v in values}).withColumn("_is_hot", F.lit(True)))
    cold = lookup.drop(weight).withColumn("_salt", F.lit(0))
    salted = rows.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_is_hot"), F.lit(1) + F.pmod(F.hash(spread_by), F.lit(4096)))
        .otherwise(F.lit(0)))
    joined = salted.join(cold, [*on, "_salt"], "left")
    for v in values:
        joined = joined.withColumn(v, F.coalesce(F.col(f"_hot_{v}"), F.col(v)))
    return joined.drop("_is_hot", "_salt", *[f"_hot_{v}" for v in values])
