"""Component scores: alignment, consolidation, coverage, aggregation, evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import COMPONENTS, CONFOUNDER_DELTA
from ..functions.hashing import all_of
from ..functions.numeric import ratio
from ..functions.paths import basename, stem
from .metrics import auc, evaluate, report


def align_by_name(entries: DataFrame, scores: DataFrame, path: str = "path",
                  score_path: str = "path", by_stem: bool = False) -> DataFrame:
    """Left join of scores onto entries by file name; the last score of a name wins upstream."""
    name = stem if by_stem else basename
    return entries.withColumn("name", name(F.col(path))).join(
        scores.select(name(F.col(score_path)).alias("name"),
                      *[c for c in scores.columns if c != score_path]), "name", "left")


def completeness(aligned: DataFrame, score: str = "score", name: str = "name") -> DataFrame:
    """How many entries lack a score, with the first three names."""
    missing = F.col(score).isNull()
    first3 = aligned.filter(missing).select(name).orderBy(name).limit(3).agg(
        F.array_join(F.array_sort(F.collect_list(name)), ",").alias("x"))
    return aligned.agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing")).withColumn(
        "first_missing", first3.scalar())


def consolidate(tables: Mapping[str, DataFrame], key: str = "name") -> DataFrame:
    """Full outer join of component tables (key, split, label, score); split and
    label come from whichever side has them."""
    frames = [t.select(key, F.col("split").alias(f"split_{c}"), F.col("label").alias(f"label_{c}"),
                       F.col("score").alias(c)) for c, t in tables.items()]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), frames)
    return joined.select(
        key, F.coalesce(*[f"split_{c}" for c in tables]).alias("split"),
        F.coalesce(*[f"label_{c}" for c in tables]).alias("label"), *tables)


def aggregate_components(components: Sequence[str] = COMPONENTS, how: str = "mean") -> Column:
    """Mean or max of the present components; 0.5 when none is present."""
    cols = [F.col(c) for c in components]
    if how == "mean":
        total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
        n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
        return F.coalesce(ratio(total, n), F.lit(0.5))
    if how == "max":
        return F.coalesce(F.greatest(*cols) if len(cols) > 1 else cols[0], F.lit(0.5))
    raise ValueError(f"unknown aggregation: {how}")


def coverage(table: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """One row per component with its share of non-missing rows, and the rows with all of them."""
    all_present = all_of([F.col(c).isNotNull() for c in components])
    wide = table.agg(*[F.count(c).alias(c) for c in components],
                     F.count_if(all_present).alias("all_components"), F.count("*").alias("n_rows"))
    return wide.unpivot("n_rows", [*components, "all_components"], "component", "n").withColumn(
        "share", ratio(F.col("n"), F.col("n_rows")))


def component_metrics(table: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """Metrics of each component on the rows that have it, and of their mean.

    One class only leaves the AUC undefined, with a note.
    """
    any_present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in components])
    long = table.withColumn("aggregate", F.when(any_present, aggregate_components(components))).unpivot(
        "label", [*components, "aggregate"], "component", "score")
    m = report(evaluate(long, ["component"]), ["component"])
    n_rows = table.agg(F.count("*").alias("n")).scalar()
    return m.withColumn("coverage", F.round(ratio(F.col("n_samples"), n_rows), 6)).withColumn(
        "note", F.when(F.col("auc").isNull(), F.lit("single class")).otherwise(F.lit("")))


def empty_input_confounder(rows: DataFrame, is_empty: str = "is_empty", score: str = "score",
                           label: str = "label", delta: float = CONFOUNDER_DELTA) -> DataFrame:
    """Empty rates by class; AUC over all, with content, and empty rows; the verdict."""
    tagged = rows.withColumn("part", F.explode(F.array(
        F.lit("all"), F.when(F.col(is_empty), F.lit("empty")).otherwise(F.lit("content")))))
    aucs = auc(tagged, ["part"], score, label)
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    wide = aucs.agg(pick("all", "auc").alias("auc_all"), pick("content", "auc").alias("auc_content"),
                    pick("empty", "auc").alias("auc_empty"))
    rates = rows.agg(
        F.count("*").alias("n"), F.count_if(is_empty).alias("n_empty"),
        F.avg(F.col(is_empty).cast("double")).alias("empty_rate"),
        F.avg(F.when(F.col(label) == 0, F.col(is_empty).cast("double"))).alias("empty_rate_real"),
        F.avg(F.when(F.col(label) == 1, F.col(is_empty).cast("double"))).alias("empty_rate_fake"))
    one = F.lit(1).alias("_k")
    both = rates.select("*", one).join(F.broadcast(wide.select("*", one)), "_k").drop("_k")
    change = F.col("auc_content") - F.col("auc_all")
    return both.withColumn("change", change).withColumn(
        "verdict", F.when(change < -delta, F.lit("shortcut")).when(change > delta, F.lit("noise"))
        .when(change.isNotNull(), F.lit("no effect")).otherwise(F.lit("undefined")))


def subset_evaluation(rows: DataFrame, group: Sequence[str] = ("subset",)) -> DataFrame:
    """n, class counts, accuracy, AUC and the 2x2 confusion matrix of each subset."""
    m = evaluate(rows, group)
    return m.select(
        *group, "n_samples", (F.col("fn") + F.col("tp")).alias("n_fake"),
        (F.col("tn") + F.col("fp")).alias("n_real"), "accuracy", "auc",
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion"))


def known_images(entries: DataFrame, table: DataFrame, key: str = "name",
                 components: Sequence[str] = COMPONENTS) -> DataFrame:
    """An absent row is ``unknown``; an absent cell is only a NULL component."""
    return entries.join(table.select(key, *components).withColumn("_seen", F.lit(True)), key, "left").withColumn(
        "status", F.when(F.col("_seen"), F.lit("known")).otherwise(F.lit("unknown"))).drop("_seen")


def service_parity(batch: DataFrame, service: DataFrame, key: str = "name",
                   components: Sequence[str] = COMPONENTS, tolerance: float = 1e-3) -> DataFrame:
    """Per (key, component): batch score, service score, difference, outcome.

    A blank batch score is skipped; a missing service score is divergent; a key the
    service lacks entirely is a failed call.
    """
    long = lambda d, v: d.unpivot(key, list(components), "component", v)
    served = service.select(key).distinct().withColumn("_called", F.lit(True))
    rows = (
        long(batch, "expected").filter("expected is not null")
        .join(long(service, "actual"), [key, "component"], "left").join(served, key, "left")
        .withColumn("diff", F.abs(F.col("actual") - F.col("expected")))
    )
    return rows.withColumn("outcome", (
        F.when(F.col("_called").isNull(), F.lit("failed"))
        .when(F.col("actual").isNull() | (F.col("diff") > tolerance), F.lit("divergent"))
        .otherwise(F.lit("equal")))).drop("_called")


def parity_summary(rows: DataFrame, key: str = "name") -> DataFrame:
    """Compared, divergent and failed counts and worst difference, per component and overall."""
    stats = [
        F.count_if(F.col("diff").isNotNull()).alias("compared"),
        F.count_if(F.col("outcome") == "divergent").alias("divergent"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.coalesce(F.max("diff"), F.lit(0.0)).alias("max_diff")]
    return rows.rollup("component").agg(*stats).select(
        F.coalesce("component", F.lit("all")).alias("component"), "compared", "divergent", "failed",
        "max_diff").withColumn("verdict", F.when(
            (F.col("divergent") == 0) & (F.col("failed") == 0), F.lit("parity")).otherwise(F.lit("no parity")))
