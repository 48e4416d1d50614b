"""Confusion metrics, tie-aware AUC and per-generator metrics from one histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import DECISION_THRESHOLD, LABEL_FAKE, LABEL_REAL
from ..functions.numeric import ratio
from .ranking import with_block

COUNTS = ("tn", "fp", "fn", "tp")


def confusion_columns(score: Column, label: Column, threshold: float = DECISION_THRESHOLD) -> list[Column]:
    hit = score >= F.lit(threshold)
    real, fake = label == LABEL_REAL, label == LABEL_FAKE
    return [
        F.count_if(real & ~hit).alias("tn"), F.count_if(real & hit).alias("fp"),
        F.count_if(fake & ~hit).alias("fn"), F.count_if(fake & hit).alias("tp"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """Derive the rates from tn, fp, fn, tp. Undefined is NULL, except f1 which is 0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n = tn + fp + fn + tp
    return counts.withColumns({
        "n_samples": n,
        "accuracy": ratio(tp + tn, n),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    })


def classification_metrics(
    df: DataFrame, group: Sequence[str], score: str = "score", label: str = "label",
    threshold: float = DECISION_THRESHOLD,
) -> DataFrame:
    """Counts and rates per group in one hash aggregation."""
    scored = df.filter(F.col(score).isNotNull())
    return with_rates(scored.groupBy(*group).agg(
        *confusion_columns(F.col(score), F.col(label), threshold)))


def _block_sums(
    df: DataFrame, group: list[str], part: Column, score: str, label: str,
    threshold: float, weight: Column, n_blocks: int | None,
) -> DataFrame:
    """Per (group, block, part): rank sums local to the block and the class counts.

    ``part`` is NULL for reals, which every part of the group shares.
    """
    hist = (
        df.filter(F.col(score).isNotNull())
        .select(*group, F.col(score).cast("double").alias("_s"), part.alias("_part"),
                (weight * (F.col(label) == LABEL_FAKE).cast("bigint")).alias("_p"),
                (weight * (F.col(label) == LABEL_REAL).cast("bigint")).alias("_r"))
    )
    counts = hist.groupBy(*group, "_part", "_s").agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"))
    hist = with_block(counts, hist, "_s", n_blocks)
    # Range frames see all rows of an equal score, so one ordered pass gives both sums.
    ordered = W.partitionBy(*group, "_blk").orderBy("_s")
    upto = ordered.rangeBetween(W.unboundedPreceding, W.currentRow)
    ties = ordered.rangeBetween(W.currentRow, W.currentRow)
    hit = F.col("_s") >= F.lit(threshold)
    return (
        hist.withColumn("_below", F.sum("_r").over(upto) - 0.5 * F.sum("_r").over(ties))
        .groupBy(*group, "_blk", "_part")
        .agg(F.sum(F.col("_p") * F.col("_below")).alias("_num"),
             F.sum("_p").alias("_p"), F.sum("_r").alias("_r"),
             F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"),
             F.sum(F.when(hit, F.col("_r")).otherwise(0)).alias("fp"))
    )


def _finish(blocks: DataFrame, group: list[str], part_name: str | None) -> DataFrame:
    over_blocks = W.partitionBy(*group).orderBy("_blk").rangeBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    ranked = (
        blocks
        .withColumn("_before", F.coalesce(F.sum("_r").over(over_blocks), F.lit(0)))
        .withColumn("_all_r", F.sum("_r").over(whole))
        .withColumn("_all_fp", F.sum("fp").over(whole))
    )
    if part_name:
        ranked = ranked.filter(F.col("_part").isNotNull()).withColumnRenamed("_part", part_name)
    keys = group + ([part_name] if part_name else [])
    out = ranked.groupBy(*keys).agg(
        F.sum(F.col("_num") + F.col("_before") * F.col("_p")).alias("_num"),
        F.sum("_p").alias("_p"), F.max("_all_r").alias("_all_r"),
        F.max("_all_fp").alias("fp"), F.sum("tp").alias("tp"))
    out = out.select(
        *keys,
        (F.col("_all_r") - F.col("fp")).cast("bigint").alias("tn"), F.col("fp").cast("bigint"),
        (F.col("_p") - F.col("tp")).cast("bigint").alias("fn"), F.col("tp").cast("bigint"),
        ratio(F.col("_num"), F.col("_p") * F.col("_all_r")).alias("auc"))
    return with_rates(out)


def evaluate(
    df: DataFrame, group: Sequence[str], score: str = "score", label: str = "label",
    threshold: float = DECISION_THRESHOLD, weight: Column | None = None,
    n_blocks: int | None = None,
) -> DataFrame:
    """All classification metrics and the exact AUC per group.

    AUC is the Mann-Whitney statistic with ties worth one half; NULL when a class
    is absent. Scores are first reduced to a histogram.
    """
    blocks = _block_sums(df, list(group), F.lit(None).cast("string"), score, label, threshold,
                         F.lit(1) if weight is None else weight, n_blocks)
    return _finish(blocks, list(group), None)


def auc(df: DataFrame, group: Sequence[str], score: str = "score", label: str = "label",
        weight: Column | None = None, n_blocks: int | None = None) -> DataFrame:
    """Exact AUC per group; any numeric column may serve as the predictor."""
    return evaluate(df, group, score, label, weight=weight, n_blocks=n_blocks).select(
        *group, "n_samples", "auc")


def evaluate_by_generator(
    df: DataFrame, group: Sequence[str], generator: str = "generator", score: str = "score",
    label: str = "label", threshold: float = DECISION_THRESHOLD, n_blocks: int | None = None,
) -> DataFrame:
    """Metrics of every generator against all reals of its group.

    The reals enter the histogram once and are shared by all generators; they
    are not copied per generator.
    """
    part = F.when(F.col(label) == LABEL_FAKE, F.col(generator))
    blocks = _block_sums(df, list(group), part, score, label, threshold, F.lit(1), n_blocks)
    return _finish(blocks, list(group), generator)


def report(metrics: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Fixed column order, rounded."""
    names = ["n_samples", "accuracy", "f1", "auc", "tn", "fp", "fn", "tp", "fpr", "fnr",
             "precision", "recall"]
    rounded = {"accuracy", "f1", "auc", "fpr", "fnr", "precision", "recall"}
    return metrics.select(*keys, *[
        F.round(c, digits).alias(c) if c in rounded else F.col(c)
        for c in names if c in metrics.columns])
