"""Error analysis over per-sample hits of every technique."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import DECISION_THRESHOLD, FUSION, MIN_INVERSION_SAMPLES
from ..functions.hashing import all_of
from ..functions.numeric import ratio
from .metrics import evaluate_by_generator


def score_matrix(scores: DataFrame, techniques: Sequence[str], keys: Sequence[str] = ("sample_id",),
                 carry: Sequence[str] = (), score: str = "score") -> DataFrame:
    """One row per sample, one column per technique; an absent score is NULL."""
    return scores.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in carry],
        *[F.max(F.when(F.col("technique") == t, F.col(score))).alias(t) for t in techniques])


def hits(matrix: DataFrame, techniques: Sequence[str], base: Sequence[str],
         threshold: float = DECISION_THRESHOLD, label: str = "label") -> DataFrame:
    """Boolean ``hit_<technique>`` and ``n_hits`` over the base techniques.

    Samples some technique has not scored are left out, so all rates share one population.
    """
    full = matrix.filter(all_of([F.col(t).isNotNull() for t in techniques]))
    marked = full.withColumns({
        f"hit_{t}": (F.col(t) >= threshold) == (F.col(label) == 1) for t in techniques})
    total = sum((F.col(f"hit_{t}").cast("int") for t in base[1:]), F.col(f"hit_{base[0]}").cast("int"))
    return marked.withColumn("n_hits", total)


def all_wrong_by_generator(h: DataFrame) -> DataFrame:
    """Samples wrong under every base technique, by generator, highest rate first."""
    return h.groupBy("generator").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_hits") == 0).alias("all_wrong"),
    ).withColumn("rate", ratio(F.col("all_wrong"), F.col("n"))).orderBy(F.desc("rate"), "generator")


def disagreement(h: DataFrame, base: Sequence[str]) -> DataFrame:
    """Share of samples on which exactly one technique of a pair is right."""
    pairs = list(combinations(base, 2))
    wide = h.agg(*[F.avg((F.col(f"hit_{a}") != F.col(f"hit_{b}")).cast("double")).alias(f"{a}_{b}")
                   for a, b in pairs])
    return wide.unpivot([], [f"{a}_{b}" for a, b in pairs], "pair", "rate")


def hit_distribution(h: DataFrame) -> DataFrame:
    return h.groupBy("n_hits").agg(F.count("*").alias("n"))


def fusion_rescue(h: DataFrame, base: Sequence[str], fusion: str = FUSION) -> DataFrame:
    """Of each technique's errors, how many the fusion gets right; techniques without errors drop out."""
    good = F.col(f"hit_{fusion}")
    wide = h.agg(*[F.struct(
        F.count_if(~F.col(f"hit_{t}")).alias("errors"),
        F.count_if(~F.col(f"hit_{t}") & good).alias("rescued")).alias(t) for t in base])
    long = wide.unpivot([], list(base), "technique", "c")
    return long.select("technique", "c.errors", "c.rescued").filter("errors > 0").withColumn(
        "rate", ratio(F.col("rescued"), F.col("errors")))


def fusion_spoil(h: DataFrame, base: Sequence[str], fusion: str = FUSION) -> DataFrame:
    """Samples the majority of techniques gets right and the fusion gets wrong."""
    majority = F.col("n_hits") >= (len(base) + 1) // 2
    return h.agg(F.count_if(majority & ~F.col(f"hit_{fusion}")).alias("spoiled"),
                 F.count("*").alias("n")).withColumn("rate", ratio(F.col("spoiled"), F.col("n")))


def auc_by_generator(scores: DataFrame, min_samples: int = MIN_INVERSION_SAMPLES,
                     threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """AUC and recall of every technique on every generator with enough samples."""
    m = evaluate_by_generator(scores, ["technique"], threshold=threshold)
    return m.withColumn("n", F.col("tp") + F.col("fn")).filter(F.col("n") >= min_samples).select(
        "technique", "generator", "auc", "recall", "n")


def inversions(per_generator: DataFrame) -> DataFrame:
    """Rows that rank fakes below reals, worst first."""
    return per_generator.filter("auc < 0.5").orderBy("auc", "technique", "generator")


def low_recall_without_inversion(per_generator: DataFrame) -> DataFrame:
    return per_generator.agg(F.count_if((F.col("recall") < 0.5) & (F.col("auc") >= 0.5)).alias("n_cases"))


def examples(h: DataFrame, k: int = 15, position: str = "sample_id", fusion: str = FUSION) -> DataFrame:
    """First ``k`` samples per error category in manifest order."""
    wrong = F.col("n_hits") == 0
    rows = h.select(position, F.explode(F.filter(F.array(
        F.when(wrong, F.lit("all_wrong")),
        F.when(wrong & F.col(f"hit_{fusion}"), F.lit("only_fusion_right"))),
        lambda c: c.isNotNull())).alias("category"))
    rank = F.row_number().over(W.partitionBy("category").orderBy(position))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
