"""Summaries over recorded times, runs, published values and variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import LATENCY_LIMIT_MS, NORMALISED_SIDE, PUBLISHED_TOLERANCE_PP
from ..functions.numeric import ratio
from .features import pixel_words
from .metrics import auc
from .ranking import fixed_block


def latency(times: DataFrame, group: Sequence[str], value: str = "ms",
            limit: float = LATENCY_LIMIT_MS) -> DataFrame:
    """Mean, sample sd (0 for one row), median, max and whether the mean is under the limit.

    The median is exact and found by rank, never by gathering a group.
    """
    group = list(group)
    basic = times.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_ms"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd_ms"), F.max(value).alias("max_ms"))
    medians = exact_median(times, group, value)
    return basic.join(medians, group).withColumn("passed", F.col("mean_ms") < limit)


def exact_median(df: DataFrame, group: Sequence[str], value: str, n_blocks: int | None = None,
                 out: str = "median_ms") -> DataFrame:
    """Exact median per group over a value histogram cut into ordered blocks."""
    group = list(group)
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    block = fixed_block(rows, "_v", n_blocks)
    counts = rows.groupBy(*group, "_v").agg(F.count("*").alias("_c")).withColumn("_blk", block)
    before = W.partitionBy(*group).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.groupBy(*group, "_blk").agg(F.sum("_c").alias("_bc")).select(
        *group, "_blk", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_start"),
        F.sum("_bc").over(W.partitionBy(*group)).alias("_n"))
    upto = W.partitionBy(*group, "_blk").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_c").over(upto)).join(starts, [*group, "_blk"])
    last, first = F.col("_start") + F.col("_upto"), F.col("_start") + F.col("_upto") - F.col("_c")
    holds = lambda rank: F.max(F.when((first < rank) & (rank <= last), F.col("_v")))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return ranked.groupBy(*group).agg(((holds(low) + holds(high)) / 2.0).alias(out))


def total_latency(per_group: DataFrame, limit: float = LATENCY_LIMIT_MS) -> DataFrame:
    """Sum of the group means against the limit."""
    return per_group.agg(F.sum("mean_ms").alias("total_ms")).withColumn("passed", F.col("total_ms") < limit)


def mean_and_sd(runs: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample sd (0 for one run) of each value; failed runs (NULL) are skipped."""
    aggs = [F.count(values[0]).alias("n_runs")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_sd")]
    return runs.groupBy(*group).agg(*aggs)


def published_gap(measured: DataFrame, published: DataFrame,
                  tolerance_pp: float = PUBLISHED_TOLERANCE_PP) -> DataFrame:
    """Measured against published AUC per generator, in percentage points, by native side."""
    gap = (F.col("auc") - F.col("published_auc")) * 100
    return published.join(measured.select("generator", "auc"), "generator", "left").select(
        "generator", "native_side", (F.col("native_side") / float(NORMALISED_SIDE)).alias("reduction"),
        F.col("auc").alias("measured_auc"), "published_auc", gap.alias("gap_pp"),
        (F.abs(gap) <= tolerance_pp).alias("within")).orderBy("native_side", "generator")


def published_summary(gaps: DataFrame) -> DataFrame:
    """Means over the generators both have, their gap, and those within tolerance."""
    common = gaps.filter("measured_auc is not null")
    return common.agg(
        F.avg("measured_auc").alias("mean_measured"), F.avg("published_auc").alias("mean_published"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("within"), F.col("generator")))), ","
                     ).alias("within")).withColumn(
        "mean_gap_pp", (F.col("mean_measured") - F.col("mean_published")) * 100)


def extraction_log(masks: DataFrame, sample: str = "sample", instance: str = "instance",
                   klass: str = "klass", value: str = "value", pixel: str = "pixel", samples: DataFrame | None = None) -> DataFrame:
    """Per sample: instances by class, the covered area share of each class, and whether the detector returned nothing at all.

    ``samples`` (sample, null_detection) lists all that were processed; without it those with instances are logged. Areas come from
    bitmaps of 64 pixels a word.
    """
    words = pixel_words(masks, [sample, instance, klass], pixel, value)
    of = lambda k: F.bit_or(F.when(F.col(klass) == k, F.col("bits")).otherwise(F.lit(0).cast("bigint")))
    areas = words.groupBy(sample, "word").agg(of(0).alias("o"), of(1).alias("s"), F.bit_or("seen").alias("seen")).groupBy(sample).agg(
        F.sum(F.bit_count("o")).alias("on_object"), F.sum(F.bit_count("s")).alias("on_shadow"), F.sum(F.bit_count("seen")).alias("n_pixels"))
    counts = words.groupBy(sample).agg(
        F.count_distinct(instance).alias("n_instances"),
        F.count_distinct(F.when(F.col(klass) == 0, F.col(instance))).alias("n_object"),
        F.count_distinct(F.when(F.col(klass) == 1, F.col(instance))).alias("n_shadow"))
    log = counts.join(areas, sample).select(
        sample, "n_instances", "n_object", "n_shadow",
        ratio(F.col("on_object"), F.col("n_pixels")).alias("area_object"),
        ratio(F.col("on_shadow"), F.col("n_pixels")).alias("area_shadow"))
    if samples is None:
        return log.withColumn("null_detection", F.lit(False))
    return samples.select(sample, "null_detection").join(log, sample, "left").select(
        sample, *[F.coalesce(c, F.lit(0).cast(log.schema[c].dataType)).alias(c) for c in log.columns if c != sample], "null_detection")


def extraction_summary(log: DataFrame) -> DataFrame:
    """Totals over all logged samples: those without instances, and how many of them for want of any detection."""
    return log.agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("n_instances") == 0).alias("n_without"), F.count_if("null_detection").alias("n_null_detection"),
        F.sum("n_object").alias("n_object"), F.sum("n_shadow").alias("n_shadow"),
    ).withColumn("share_without", ratio(F.col("n_without"), F.col("n_samples")))


def scalar_summary(df: DataFrame, value: str, threshold: float, label: str = "label") -> DataFrame:
    """AUC of a numeric column used as a predictor, its median, max and count above a level."""
    one = df.withColumn("_k", F.lit(1))
    a = auc(one, ["_k"], value, label)
    stats = one.groupBy("_k").agg(F.max(value).cast("double").alias("max"),
                                  F.count_if(F.col(value) > threshold).alias("n_above"))
    med = exact_median(one, ["_k"], value, out="median")
    return a.join(stats, "_k").join(med, "_k").drop("_k")


def variant_comparison(metrics: DataFrame, a: str, b: str, values: Sequence[str],
                       variant: str = "variant") -> DataFrame:
    """The two variants side by side and their differences (b - a), one row per metric."""
    long = metrics.unpivot(variant, list(values), "metric", "value")
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col("value")))
    return long.groupBy("metric").agg(pick(a).alias("value_a"), pick(b).alias("value_b")).withColumn(
        "delta", F.col("value_b") - F.col("value_a"))


def protocol_drop(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """AUC under two protocols and the change, per technique."""
    pick = lambda v: F.max(F.when(F.col("protocol") == v, F.col("auc")))
    return metrics.groupBy("technique").agg(
        pick(before).alias("auc_before"), pick(after).alias("auc_after")
    ).withColumn("change", F.col("auc_after") - F.col("auc_before"))
