"""Signal statistics as group-by jobs over value tables and pixel blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..constants import (
    AC_POSITIONS, BENFORD_BASES, BENFORD_FREQUENCIES, BENFORD_QUALITIES, CONDITIONS,
    COOCCURRENCE_SCALE, DIVERGENCES, LUMA_TABLE, MASK_THRESHOLD, SEED,
)
from ..functions.benford import REGISTRY, benford_share, clipped, first_digit
from ..functions.hashing import gaussian
from ..functions.numeric import ratio


# --- first digits -----------------------------------------------------------

def benford_law(spark, bases: Sequence[int] = BENFORD_BASES) -> DataFrame:
    """(base, digit, share) of the generalised law; a small fixed table."""
    if min(bases) < 3:
        raise ValueError("the base must be at least 3")
    return (
        spark.createDataFrame([(int(b),) for b in bases], "base int")
        .select("base", F.explode(F.sequence(F.lit(1), F.col("base") - 1)).alias("digit"))
        .withColumn("share", benford_share(F.col("digit"), F.col("base")))
    )


def digit_counts(df: DataFrame, keys: Sequence[str], value: str, bases: Sequence[int],
                 count: str | None = None) -> DataFrame:
    """(keys, base, digit, n) of non-zero values.

    Continuous values go straight to at most 126 cells per key and input task.
    ``count`` names a column that says how often a row counts.
    A group with only zeros keeps one row with a NULL digit and n = 0.
    """
    values = df.select(*keys, value, (F.col(count) if count else F.lit(1).cast("bigint")).alias("_c"))
    return (
        values.withColumn("base", F.explode(F.array(*[F.lit(int(b)) for b in bases])))
        .withColumn("digit", first_digit(F.col(value), F.col("base")))
        .groupBy(*keys, "base", "digit")
        .agg(F.sum(F.when(F.col("digit").isNotNull(), F.col("_c")).otherwise(0)).alias("n"))
    )


def digit_distribution(df: DataFrame, keys: Sequence[str], value: str, bases: Sequence[int]) -> DataFrame:
    """Share of every digit 1..base-1 per group; uniform when the group has no non-zero value."""
    keys = list(keys)
    counts = digit_counts(df, keys, value, bases)
    groups = counts.groupBy(*keys, "base").agg(
        F.sum("n").alias("_total"),
        F.map_from_entries(F.collect_list(F.when(F.col("digit").isNotNull(), F.struct("digit", "n")))
                           ).alias("_by_digit"))
    rows = groups.withColumn("digit", F.explode(F.sequence(F.lit(1), F.col("base") - 1)))
    n = F.coalesce(F.try_element_at("_by_digit", F.col("digit")), F.lit(0).cast("bigint"))
    uniform = F.lit(1.0) / (F.col("base") - 1)
    return rows.select(*keys, "base", "digit", n.alias("n"),
                       F.when(F.col("_total") == 0, uniform).otherwise(ratio(n, F.col("_total"))).alias("share"))


def benford_divergences(df: DataFrame, keys: Sequence[str], value: str,
                        bases: Sequence[int] = BENFORD_BASES,
                        names: Sequence[str] = DIVERGENCES, count: str | None = None) -> DataFrame:
    """(keys, base, one column per divergence) between observed digits and the law.

    Only digits that occur are summed; the rest enter through a constant per base.
    """
    keys = list(keys)
    # In the order of digits, so that sums don't depend on partitions.
    cells = F.sort_array(F.filter(F.collect_list(F.struct("digit", "n")), lambda c: c["digit"].isNotNull()))
    groups = digit_counts(df, keys, value, bases, count).groupBy(*keys, "base").agg(
        F.sum("n").alias("_total"), cells.alias("_cells"))
    base = F.col("base")
    out = []
    for name in names:
        d = REGISTRY[name]
        unseen, uniform = F.lit(None).cast("double"), F.lit(None).cast("double")
        for b in bases:
            unseen = F.when(base == b, F.lit(d.unseen(b))).otherwise(unseen)
            flat = sum(d.number(1.0 / (b - 1), np.log(1 + 1 / k) / np.log(b)) for k in range(1, b))
            uniform = F.when(base == b, F.lit(float(flat))).otherwise(uniform)
        seen = F.aggregate("_cells", unseen, _gain(d, base, F.col("_total")))
        value_ = d.close(F.when(F.col("_total") == 0, uniform).otherwise(seen))
        out.append(F.coalesce(F.nanvl(value_, F.lit(0.0)), F.lit(0.0)).alias(name))
    return groups.select(*keys, "base", *out)


def _gain(d, base: Column, total: Column):
    """Step that swaps the unseen term of one digit for its observed term."""
    def step(acc: Column, cell: Column) -> Column:
        p = clipped(cell["n"].cast("double") / total)
        q = clipped(benford_share(cell["digit"].cast("double"), base))
        return acc + d.term(p, q) - d.term(clipped(F.lit(0.0)), q)
    return step


# --- block DCT --------------------------------------------------------------

def dct_basis() -> np.ndarray:
    """64 x 64 orthonormal 2-D DCT-II basis, raster order on both sides."""
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.sqrt(2.0 / 8.0) * np.cos(np.pi * (2 * n + 1) * k / 16.0)
    one[0] = np.sqrt(1.0 / 8.0)
    return np.kron(one, one)


def quality_table(quality: int) -> list[int]:
    """Luminance quantisation table at a JPEG quality."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (t * scale + 50) // 100)) for t in LUMA_TABLE]


def block_dct(blocks: DataFrame, pixels: str = "pixels", positions: Sequence[int] = tuple(range(64)),
              out: str = "coef") -> DataFrame:
    """Level-shifted 2-D DCT of 64-pixel blocks, as one matrix product per Arrow batch.

    Coefficients are rounded to nine decimals so that exact halves stay exact.
    """
    basis = dct_basis()[list(positions)].T.copy()

    @F.pandas_udf(ArrayType(DoubleType()))
    def transform(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if len(s) == 0:
                yield pd.Series([], dtype=object)
                continue
            m = np.vstack(s.to_numpy()).astype(np.float64) - 128.0
            yield pd.Series(list(np.round(m @ basis, 9) + 0.0))

    return blocks.withColumn(out, transform(F.col(pixels)))


def quantised_dct(blocks: DataFrame, quality: int, pixels: str = "pixels") -> DataFrame:
    """Quantised coefficients of every block, raster order, rounded half to even."""
    q = F.array(*[F.lit(float(v)) for v in quality_table(quality)])
    return block_dct(blocks, pixels).withColumn(
        "quantised", F.zip_with("coef", q, lambda c, t: F.rint(c / t).cast("int"))).drop("coef")


def split_planes(planes: DataFrame, pixels: str = "pixels", height: int = 8, width: int = 8) -> DataFrame:
    """Cut raster planes into 8x8 blocks; ragged borders are dropped."""
    if height < 8 or width < 8:
        raise ValueError("plane smaller than one 8x8 block")
    across = width // 8
    start = lambda b: F.floor(b / across).cast("int") * 8 * width + b % across * 8 + 1
    block = lambda b: F.concat(*[F.slice(pixels, start(b) + y * width, F.lit(8)) for y in range(8)])
    return planes.select(
        *[c for c in planes.columns if c != pixels],
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(height // 8 * across - 1)), block)).alias("block_no", pixels))


def benford_features(blocks: DataFrame, sample: str = "sample", pixels: str = "pixels",
                     qualities: Sequence[int] = BENFORD_QUALITIES,
                     bases: Sequence[int] = BENFORD_BASES, n_freq: int = BENFORD_FREQUENCIES) -> DataFrame:
    """(sample, quality, ac, base, divergences...): 180 rows of three divergences per sample.

    Quantised coefficients are counted where they are computed (see :func:`coefficient_counts`); the counts of a sample meet once and
    all later grouping stays there.
    """
    counted = coefficient_counts(blocks, sample, pixels, qualities, AC_POSITIONS[:n_freq]).repartition(sample)
    return benford_divergences(counted, [sample, "quality", "ac"], "v", bases, count="n")


def coefficient_counts(blocks: DataFrame, sample: str, pixels: str, qualities: Sequence[int], positions: Sequence[int]) -> DataFrame:
    """(sample, quality, ac, v, n): how often a quantised coefficient occurs in a sample's blocks, counted within each Arrow batch.

    Only the needed coefficients are computed, once per block for all qualities.
    """
    basis = dct_basis()[list(positions)].T.copy()
    tables = np.array([[float(quality_table(q)[p]) for p in positions] for q in qualities])

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("pixels").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64) - 128.0
            coef = np.round(m @ basis, 9) + 0.0
            v = np.rint(coef[:, None, :] / tables[None]).astype(np.int64).reshape(len(m), -1)
            own = batch.column("sample").dictionary_encode(null_encoding="encode")
            low, cells = int(v.min()), v.shape[1]
            wide = int(v.max()) - low + 1
            of = own.indices.to_numpy().astype(np.int64)
            key = ((of[:, None] * cells + np.arange(cells)) * wide + (v - low)).ravel()
            size = len(own.dictionary) * cells * wide
            if size <= 8 * len(key):
                n = np.bincount(key, minlength=size)
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            cell = key // wide % cells
            yield pa.RecordBatch.from_arrays(
                [own.dictionary.take(pa.array(key // wide // cells)), pa.array(np.array(qualities, np.int32)[cell // len(positions)]),
                 pa.array((cell % len(positions) + 1).astype(np.int32)), pa.array((key % wide + low).astype(np.int32)), pa.array(n.astype(np.int64))],
                ["sample", "quality", "ac", "v", "n"])

    kind = blocks.schema[sample].dataType.simpleString()
    counted = blocks.select(F.col(sample).alias("sample"), F.col(pixels).alias("pixels")).mapInArrow(
        count, f"sample {kind}, quality int, ac int, v int, n long")
    return counted.withColumnRenamed("sample", sample)


def feature_index(quality: Column, ac: Column, base: Column, divergence: int,
                  qualities=BENFORD_QUALITIES, bases=BENFORD_BASES, n_freq=BENFORD_FREQUENCIES) -> Column:
    """Position in the fixed order quality, frequency, base, divergence."""
    at = lambda col, seq: (F.array_position(F.array(*[F.lit(x) for x in seq]), col) - 1).cast("int")
    return ((at(quality, qualities) * n_freq + ac - 1) * len(bases) + at(base, bases)) * len(DIVERGENCES) + divergence


def feature_vectors(blocks: DataFrame, sample: str = "sample", pixels: str = "pixels") -> DataFrame:
    """(sample, features): 540 divergences in fixed order."""
    rows = benford_features(blocks, sample, pixels)
    entry = F.array(*[
        F.struct(feature_index(F.col("quality"), F.col("ac"), F.col("base"), i).alias("i"), F.col(name).alias("v"))
        for i, name in enumerate(DIVERGENCES)])
    return rows.groupBy(sample).agg(
        F.transform(F.array_sort(F.flatten(F.collect_list(entry))), lambda e: e["v"]).alias("features"))


def feature_names(spark) -> DataFrame:
    """(position, name) of the 540 features."""
    ac = spark.range(BENFORD_FREQUENCIES).select((F.col("id") + 1).cast("int").alias("ac"))
    grid = ac.select("ac", F.explode(F.array(*[F.lit(q) for q in BENFORD_QUALITIES])).alias("quality"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(b) for b in BENFORD_BASES])).alias("base"))
    grid = grid.select("*", F.posexplode(F.array(*[F.lit(d) for d in DIVERGENCES])).alias("d", "divergence"))
    return grid.select(
        feature_index(F.col("quality"), F.col("ac"), F.col("base"), 0).alias("p"), "d",
        F.format_string("qf%d_ac%d_b%d_%s", "quality", "ac", "base", "divergence").alias("name")
    ).select((F.col("p") + F.col("d")).alias("position"), "name")


# --- co-occurrence ----------------------------------------------------------

def plane_pairs(planes: DataFrame, keys: Sequence[str], pixels: str, height: int, width: int,
                dy: int = 0, dx: int = 1) -> DataFrame:
    """(keys, i, j, n): value pairs of each pixel and its neighbour, for raster planes in one row."""
    if abs(dy) >= height or abs(dx) >= width:
        raise ValueError("offset larger than the plane")
    rows, columns = height - abs(dy), width - abs(dx)       # of pixels that have the neighbour
    first = lambda k: (max(0, -dy) + F.floor(k / columns)).cast("int") * width + max(0, -dx) + k % columns
    pairs = F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda k: F.struct(
        F.get(pixels, first(k)).cast("int").alias("i"), F.get(pixels, first(k) + dy * width + dx).cast("int").alias("j")))
    return planes.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.i", "p.j").agg(
        F.count("*").alias("n"))


def pixel_pairs(pixels: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x",
                value: str = "value", dy: int = 0, dx: int = 1) -> DataFrame:
    """The same pairs for one row per pixel.

    Each pixel is sent to its own place and to the place it is the neighbour of;
    one shuffle pairs them, and no place ever holds more than two rows.
    """
    role = F.array(
        F.struct(F.col(y).alias("py"), F.col(x).alias("px"), F.col(value).alias("i"), F.lit(None).cast("int").alias("j")),
        F.struct((F.col(y) - dy).alias("py"), (F.col(x) - dx).alias("px"), F.lit(None).cast("int").alias("i"), F.col(value).alias("j")))
    placed = pixels.select(*keys, F.explode(role).alias("r")).select(*keys, "r.*")
    paired = placed.groupBy(*keys, "py", "px").agg(F.max("i").alias("i"), F.max("j").alias("j"))
    return paired.filter("i is not null and j is not null").groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))


def cooccurrence(pairs: DataFrame, keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Normalise pair counts to sum to ``scale`` per plane; the matrix stays sparse.

    A plane has at most levels x levels rows, so the window is bounded.
    """
    total = F.sum("n").over(W.partitionBy(*keys))
    return pairs.withColumn("share", ratio(F.col("n"), total) * scale)


def channel_cooccurrence(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model input per (sample, channel): co-occurrence scaled by 1e4."""
    return cooccurrence(pairs, keys, COOCCURRENCE_SCALE)


def channel_tensor(pairs: DataFrame, sample: str = "sample", channel: str = "channel", levels: int = 256) -> DataFrame:
    """(sample, positions, shares): the planes of all channels stacked into one sparse vector, position ``(channel * levels + i) * levels + j``.

    Each plane sums to the scale of the model input. A sample has at most channels x levels^2 cells, and no more than it has pixels.
    """
    cells = channel_cooccurrence(pairs, [sample, channel])
    at = ((F.col(channel) * levels + F.col("i")) * levels + F.col("j")).cast("int")
    return cells.groupBy(sample).agg(F.sort_array(F.collect_list(F.struct(at.alias("p"), "share"))).alias("c")).select(
        sample, F.col("c.p").alias("positions"), F.col("c.share").alias("shares"))


# --- masks ------------------------------------------------------------------

def pixel_words(masks: DataFrame, keys: Sequence[str], pixel: str = "pixel", value: str = "value") -> DataFrame:
    """(keys, word, bits, seen): bitmaps of 64 pixels each, of those above the threshold and of those that occur.

    Rows are merged into words before they are shuffled, so a pixel is a bit from then on.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod({pixel}, 64) as int))")
    return masks.groupBy(*keys, F.floor(F.col(pixel) / 64).alias("word")).agg(
        F.bit_or(F.when(F.col(value) > MASK_THRESHOLD, bit).otherwise(F.lit(0).cast("bigint"))).alias("bits"), F.bit_or(bit).alias("seen"))


def class_bitmaps(masks: DataFrame, classes: Sequence[int] = (0, 1), sample: str = "sample", klass: str = "klass", pixel: str = "pixel",
                  value: str = "value", samples: DataFrame | None = None) -> DataFrame:
    """(sample, klass, words, area): one row for each sample and class, the union of its instances as a map of words, and how many pixels are on.

    A class without instances has no words. ``samples`` adds those that have no instance at all.
    """
    words = pixel_words(masks, [sample, klass], pixel, value).filter("bits <> 0")
    on = words.groupBy(sample, klass).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).alias("area"))
    base = (samples if samples is not None else masks).select(sample).distinct()
    grid = base.withColumn(klass, F.explode(F.array(*[F.lit(c) for c in classes])))
    return grid.join(on, [sample, klass], "left").withColumns({
        "words": F.coalesce("words", F.expr("cast(map() as map<bigint, bigint>)")), "area": F.coalesce("area", F.lit(0).cast("bigint"))})


def class_masks(masks: DataFrame, n_pixels: int, classes: Sequence[int] = (0, 1), sample: str = "sample",
                klass: str = "klass", pixel: str = "pixel", value: str = "value",
                samples: DataFrame | None = None) -> DataFrame:
    """(sample, klass, pixel, level): union of instances per class, 0 or 255, written out from the bitmaps.

    A class without instances gives an all-zero map.
    """
    maps = class_bitmaps(masks, classes, sample, klass, pixel, value, samples)
    word = F.coalesce(F.try_element_at("words", F.floor(F.col(pixel) / 64)), F.lit(0).cast("bigint"))
    bit = F.getbit(word, F.pmod(pixel, F.lit(64)).cast("int"))
    return (maps.withColumn(pixel, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_pixels - 1).cast("bigint"))))
            .select(sample, klass, pixel, (bit.cast("int") * 255).alias("level")))


# --- perturbations ----------------------------------------------------------

def condition_grid(df: DataFrame, conditions=CONDITIONS) -> DataFrame:
    """Every row under every condition, produced in place without a join."""
    rows = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(k).alias("kind"), F.lit(float(v)).alias("level"))
                     for n, k, v in conditions])
    return df.select("*", F.explode(rows).alias("_c")).select(*df.columns, "_c.*")


def perturb_signal(df: DataFrame, values: str = "pixels", id_col: str = "sample_id", seed=SEED,
                   conditions=CONDITIONS) -> DataFrame:
    """Apply the condition grid to numeric signals in 0..255.

    noise: additive Gaussian, reproducible per item and position; jpeg: rounding to
    a step that grows as quality falls; resize: keeps ``floor(n * factor)`` evenly
    spaced values. ``output_name`` is unique per item and condition.
    """
    grid = condition_grid(df, conditions)
    def noisy(v: Column, k: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), k.cast("string")))
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(v + F.col("level") * gaussian(h))))
    step = F.greatest(F.lit(1.0), F.rint((F.lit(100.0) - F.col("level")) / 5.0))
    size = F.floor(F.size(values) * F.col("level")).cast("int")
    out = (
        F.when(F.col("kind") == "noise", F.transform(values, noisy))
        .when(F.col("kind") == "jpeg", F.transform(values, lambda v: F.least(F.lit(255.0), F.rint(v / step) * step)))
        .when(F.col("kind") == "resize", F.transform(
            F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.get(values, F.floor(k / F.col("level")).cast("int"))))
        .otherwise(F.col(values)))
    return grid.withColumn(values, out).withColumn(
        "output_name", F.concat_ws("__", F.col(id_col).cast("string"), F.col("condition")))
