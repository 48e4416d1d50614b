"""Protocol jobs over score tables."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping, Sequence
from itertools import product


from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..constants import FUSION, SEED, SOURCE_TECHNIQUES, STATUS_FAILED, STATUS_OK, TRAINING_SEEDS
from ..operators.components import aggregate_components, component_metrics, consolidate, coverage
from ..operators.curves import bootstrap_interval, delong_pairs, roc_points
from ..operators.errors import (
    all_wrong_by_generator, auc_by_generator, disagreement, examples, fusion_rescue, fusion_spoil,
    hit_distribution, hits, inversions, low_recall_without_inversion, score_matrix,
)
from ..operators.features import condition_grid, feature_vectors, perturb_signal
from ..operators.filters import status_columns, validate_scores
from ..operators.fusion import Fusion
from ..operators.metrics import evaluate, evaluate_by_generator
from ..operators.splits import balanced_sample
from ..operators.summaries import mean_and_sd
from ..session import materialize

RUN_KEYS = ("protocol", "technique", "condition")


def fit_techniques(spark: SparkSession, jobs: Mapping[str, Callable[[], object]]) -> tuple[dict, DataFrame]:
    """Run every fit; a failure is recorded and the others go on."""
    fitted, rows = {}, []
    for name, job in jobs.items():
        try:
            fitted[name] = job()
            rows.append((name, STATUS_OK, None))
        except Exception as error:  # noqa: BLE001
            rows.append((name, STATUS_FAILED, str(error)))
    return fitted, spark.createDataFrame(rows, "technique string, status string, error string")


def fit_fusion(scores: DataFrame, split: str = "val", classifier: str = "logistic_regression",
               strategy: str = "prior", sources: Sequence[str] = SOURCE_TECHNIQUES, seed=SEED) -> Fusion:
    """Fit the fusion on validation or calibration scores; training scores are refused
    because techniques are optimistic on their own training rows."""
    if split not in ("val", "fusion"):
        raise ValueError("fusion is fitted on 'val' or 'fusion' scores only")
    part = scores.filter((F.col("split") == split) & F.col("technique").isin(*sources))
    # Every fitting step reads the matrix again, so it is written once.
    matrix = materialize(score_matrix(part, sources, carry=["label"]), "fusion_matrix")
    if matrix.isEmpty():
        raise ValueError(f"no source scores in split '{split}'")
    return Fusion(classifier, strategy, seed, tuple(sources)).fit(matrix)


def fused_scores(fusion: Fusion, scores: DataFrame, keys: Sequence[str] = ("sample_id",),
                 carry: Sequence[str] = ("label", "generator")) -> DataFrame:
    """Fusion scores in the long layout, ready for union with the source scores."""
    matrix = score_matrix(scores, fusion.sources, keys, carry)
    return fusion.score(matrix).withColumn("technique", F.lit(FUSION))


def run_protocol(scores: DataFrame, keys: Sequence[str] = RUN_KEYS,
                 failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Overall and per-generator metrics of every run in one query each; failures become rows."""
    keys = list(keys)
    overall = evaluate(scores, keys).withColumns(
        {"error": F.lit(None).cast("string"), "seed": F.lit(None).cast("int")})
    if failures is not None:
        overall = overall.unionByName(failures, allowMissingColumns=True)
    return status_columns(overall), evaluate_by_generator(scores, keys)


def robustness_inputs(signals: DataFrame, limit: int | None = None, seed=SEED, values: str = "pixels",
                      id_col: str = "sample_id") -> DataFrame:
    """Balanced test sample under every condition."""
    rows = signals if limit is None else balanced_sample(signals, limit, seed, id_col=id_col)
    return perturb_signal(rows, values, id_col, seed)


def robustness_scores(signals: DataFrame, scorers: Mapping[str, Callable[[DataFrame], DataFrame]], limit: int | None = None, seed=SEED,
                      values: str = "pixels", id_col: str = "sample_id") -> DataFrame:
    """(id, label, technique, condition, score): every sample of one balanced selection, perturbed in each way and scored by each technique.

    A scorer takes the perturbed signals (id, label, condition, values) and returns them with a score; features that it needs are its part
    of the plan. Written once, so that every report looks at the same scores.
    """
    inputs = robustness_inputs(signals, limit, seed, values, id_col)
    out = None
    for technique, score in scorers.items():
        rows = score(inputs).select(id_col, "label", F.lit(technique).alias("technique"), "condition", "score")
        out = rows if out is None else out.unionByName(rows)
    return materialize(out, "robustness-scores")


def signal_features(inputs: DataFrame, values: str = "pixels", id_col: str = "sample_id") -> DataFrame:
    """(id, label, condition, features): Benford features of perturbed signals, 64 values to a block; what is left over is dropped."""
    key = F.struct(id_col, "label", "condition").alias("sample")
    whole = F.floor(F.size(values) / 64).cast("int")
    cut = F.transform(F.sequence(F.lit(0), whole - 1), lambda b: F.slice(values, b * 64 + 1, 64))
    blocks = inputs.filter(whole > 0).select(F.to_json(key).alias("sample"), F.explode(cut).alias(values))
    kinds = f"{id_col} {inputs.schema[id_col].dataType.simpleString()}, label int, condition string"
    return feature_vectors(blocks, "sample", values).select(F.from_json("sample", kinds).alias("k"), "features").select("k.*", "features")


def common_samples(scores: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Scores of the samples that a technique scored under every condition, so that conditions compare equal samples."""
    n = scores.agg(F.count_distinct("condition").alias("n")).scalar()
    whole = scores.groupBy("technique", id_col).agg(F.count_distinct("condition").alias("_n")).filter(F.col("_n") == n)
    return scores.join(whole.select("technique", id_col), ["technique", id_col], "left_semi")


def robustness(scores: DataFrame) -> DataFrame:
    """AUC by technique and condition with the change from the clean condition."""
    m = evaluate(scores, ["technique", "condition"]).select("technique", "condition", "n_samples", "auc")
    clean = F.max(F.when(F.col("condition") == "clean", F.col("auc"))).over(W.partitionBy("technique"))
    return m.withColumn("clean_auc", clean).withColumn("change", F.col("auc") - F.col("clean_auc"))


def missing_runs(spark: SparkSession, done: DataFrame, techniques: Sequence[str],
                 seeds: Sequence[int] = TRAINING_SEEDS) -> DataFrame:
    """(technique, seed) runs that have no stored result yet."""
    wanted = spark.createDataFrame(list(product(techniques, seeds)), "technique string, seed int")
    return wanted.join(done.select("technique", "seed").distinct(), ["technique", "seed"], "left_anti")


def run_multi_seed(spark: SparkSession, run: Callable[[str, int], DataFrame], path: str, techniques: Sequence[str],
                   seeds: Sequence[int] = TRAINING_SEEDS) -> DataFrame:
    """Scores (technique, seed, ...) of all runs, each stored as it ends; a run that was stopped goes on where it was.

    ``run(technique, seed)`` gives scores. They are written first, to a folder of their own, and a record of the run after them: scores without a
    record, left by a run that was killed, aren't read and are replaced. Runs are few, one for each technique and seed.
    """
    record = "technique string, seed int"
    log = f"{path}/runs"
    spark.createDataFrame([], record).write.mode("append").parquet(log)
    for technique, seed in sorted(map(tuple, missing_runs(spark, spark.read.schema(record).parquet(log), techniques, seeds).collect())):
        run(technique, seed).withColumns({"technique": F.lit(technique), "seed": F.lit(seed)}).write.mode("overwrite").parquet(f"{path}/scores/{technique}-{seed}")
        spark.createDataFrame([(technique, seed)], record).coalesce(1).write.mode("append").parquet(log)
    done = spark.read.schema(record).parquet(log).distinct()
    stored = [f"{path}/scores/{r.technique}-{r.seed}" for r in done.filter(F.col("technique").isin(*techniques) & F.col("seed").isin(*seeds)).collect()]
    return spark.read.parquet(*stored)


def multi_seed(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics per (technique, seed) and their mean and spread over seeds."""
    runs = evaluate(scores, ["technique", "seed"])
    return runs, mean_and_sd(runs, ["technique"], ["auc", "accuracy"])


def score_and_store(technique, df: DataFrame, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Score with any object that has ``score(df)``, store, and return one row per
    technique: validation status and milliseconds per sample."""
    started = time.perf_counter()
    technique.score(df).write.mode("overwrite").parquet(path)
    elapsed = 1000.0 * (time.perf_counter() - started)
    stored = df.sparkSession.read.parquet(path)
    if "technique" not in stored.columns:
        stored = stored.withColumn("technique", F.lit(type(technique).__name__))
    checks = validate_scores(stored, ["technique"], expected if expected is not None else df)
    return checks.withColumn("ms_per_sample", F.lit(elapsed) / F.greatest("n", F.lit(1)))


def score_cache(cache: DataFrame, wanted: DataFrame,
                key: Sequence[str] = ("manifest_id", "technique", "model_version", "condition", "sample_id"),
                ) -> tuple[DataFrame, DataFrame]:
    """Stored scores of the wanted rows, and the rows still to be scored."""
    key = list(key)
    return wanted.join(cache, key), wanted.join(cache.select(*key), key, "left_anti")


class ScoreCache:
    """Stored scores in buckets by key: what is wanted is shuffled to the buckets, the cache itself never.

    The key holds the manifest, the technique, the version of its model, the condition and the sample, so another model
    version misses. ``path`` is where the table lies; a session that opens it again finds what was merged before.
    """

    KEY = ("manifest_id", "technique", "model_version", "condition", "sample_id")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200, sample_type: str = "bigint"):
        self.spark, self.name = spark, f"score_cache_{hashlib.md5(path.encode()).hexdigest()[:12]}"
        columns = ", ".join(f"{k} {sample_type if k == 'sample_id' else 'string'}" for k in self.KEY)
        spark.sql(f"create table if not exists {self.name} ({columns}, score double) using parquet "
                  f"clustered by ({', '.join(self.KEY)}) sorted by ({', '.join(self.KEY)}) into {buckets} buckets location '{path}'")

    def lookup(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hits with their scores, and what is still to be scored."""
        return score_cache(self.spark.table(self.name), wanted, self.KEY)

    def merge(self, scores: DataFrame) -> int:
        """Add the scores whose keys are new; the first score of a key stays. Returns how many rows were added."""
        new = materialize(score_cache(self.spark.table(self.name), scores.dropDuplicates(list(self.KEY)), self.KEY)[1].select(*self.KEY, "score"), "new-scores")
        new.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return new.count()


def significance(scores: DataFrame, fusions: Sequence[str], base: Sequence[str],
                 n_resamples: int = 1000, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """Bootstrap interval of every technique; each fusion against each base technique."""
    return bootstrap_interval(scores, ["technique"], n_resamples=n_resamples, seed=seed), significance_tests(scores, fusions, base)


def significance_tests(scores: DataFrame, fusions: Sequence[str], base: Sequence[str]) -> DataFrame:
    """Each fusion variant against each base technique."""
    return delong_pairs(scores, list(product(fusions, base))).withColumn("significant", F.col("p_value") < 0.05)


def error_analysis(scores: DataFrame, base: Sequence[str], fusion: str = FUSION, k: int = 15) -> dict[str, DataFrame]:
    """Every error report from one written hits table."""
    techniques = [*base, fusion]
    matrix = score_matrix(scores, techniques, carry=["label", "generator"])
    h = materialize(hits(matrix, techniques, base), "hits")
    per_generator = auc_by_generator(scores)
    return {
        "all_wrong": all_wrong_by_generator(h), "disagreement": disagreement(h, base),
        "distribution": hit_distribution(h), "rescue": fusion_rescue(h, base, fusion),
        "spoil": fusion_spoil(h, base, fusion), "auc_by_generator": per_generator,
        "inversions": inversions(per_generator), "low_recall": low_recall_without_inversion(per_generator),
        "examples": examples(h, k, fusion=fusion),
    }


def figure_tables(scores: DataFrame, techniques: Sequence[str]) -> dict[str, DataFrame]:
    """Inputs of the figures: ROC points and generator x technique AUC."""
    by_generator = evaluate_by_generator(scores, ["technique"])
    pivot = by_generator.groupBy("generator").agg(
        *[F.max(F.when(F.col("technique") == t, F.col("auc"))).alias(t) for t in techniques])
    return {"roc": roc_points(scores, ["technique"]), "generator_auc": pivot}


def condition_table(scores: DataFrame, techniques: Sequence[str]) -> DataFrame:
    """Technique AUC per condition, ``clean`` first."""
    m = evaluate(scores, ["technique", "condition"])
    wide = m.groupBy("condition").agg(
        *[F.max(F.when(F.col("technique") == t, F.col("auc"))).alias(t) for t in techniques])
    return wide.orderBy(F.col("condition") != "clean", "condition")


def component_run(tables: Mapping[str, DataFrame], base_scores: DataFrame,
                  component_technique: str = "T04") -> dict[str, DataFrame]:
    """Consolidate components, evaluate them, and compare fusions refitted with and
    without them on the same partition.

    ``base_scores`` holds (sample_id, name, split, label, generator, technique, score) of
    the other sources.
    """
    table = materialize(consolidate(tables), "components")
    names = list(tables)
    fourth = (
        base_scores.select("sample_id", "name", "split", "label", "generator").distinct()
        .join(table.select("name", *names), "name")
        .select("sample_id", "split", "label", "generator", F.lit(component_technique).alias("technique"),
                aggregate_components(names).alias("score")))
    three = base_scores.drop("name")
    sources3 = [s for s in SOURCE_TECHNIQUES if s != component_technique]
    allscores = three.unionByName(fourth)
    test = allscores.filter("split = 'test'")
    fused = []
    for tag, sources in (("three", sources3), ("four", list(SOURCE_TECHNIQUES))):
        model = fit_fusion(allscores, "val", sources=sources)
        fused.append(fused_scores(model, test).withColumn("technique", F.lit(tag)))
    both = materialize(fused[0].unionByName(fused[1]), "fused")
    return {"coverage": coverage(table, names), "metrics": component_metrics(table, names),
            "fusion_metrics": evaluate(both, ["technique"]),
            "fusion_test": delong_pairs(both, [("four", "three")])}
