"""Late fusion of technique scores that tolerates missing sources."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import SEED, SOURCE_TECHNIQUES
from ..functions.numeric import nan_to_null, sigmoid


class NotFitted(RuntimeError):
    """Scoring was asked of a model that has not been fitted."""


def imputation_values(matrix: DataFrame, sources: Sequence[str], strategy: str) -> dict[str, float]:
    """``prior``: 0.5 everywhere; ``mean``: the column mean, 0.5 for an empty column."""
    if strategy == "prior":
        return {s: 0.5 for s in sources}
    if strategy == "mean":
        row = matrix.agg(*[F.avg(s).alias(s) for s in sources]).first()
        return {s: 0.5 if row[s] is None else float(row[s]) for s in sources}
    raise ValueError(f"unknown imputation strategy: {strategy}")


def imputed(matrix: DataFrame, sources: Sequence[str], values: Mapping[str, float]) -> DataFrame:
    """Fill absent scores (NULL or NaN) and add an availability flag per source. A source without
    a column counts as absent."""
    col = lambda s: nan_to_null(F.col(s)) if s in matrix.columns else F.lit(None).cast("double")
    keep = [c for c in matrix.columns if c not in sources]
    return matrix.select(
        *keep, *[F.coalesce(col(s), F.lit(float(values[s]))).alias(s) for s in sources],
        *[col(s).isNotNull().cast("double").alias(f"has_{s}") for s in sources])


def scaling(filled: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd per column; a constant column gets scale 1. One aggregation."""
    row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    # A constant column may show rounding noise instead of exactly zero.
    return {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) if row[f"s_{c}"] > 1e-12 else 1.0) for c in columns}



def standardised(filled: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return filled.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


def _logistic(n: int, seed: int):
    # The penalty of a unit-strength L2 objective summed over n rows.
    return LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
                              maxIter=1000, tol=1e-10)


# Registry of fusion classifiers: name -> (rows, seed) -> estimator.
CLASSIFIERS = {
    "logistic_regression": _logistic,
    "random_forest": lambda n, seed: RandomForestClassifier(numTrees=200, seed=seed, maxDepth=30),
    "gradient_boosting": lambda n, seed: GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
}
_MODELS = {"logistic_regression": LogisticRegressionModel, "random_forest": RandomForestClassificationModel,
           "gradient_boosting": GBTClassificationModel}


@dataclass
class Fusion:
    """Impute, flag, standardise, classify."""

    classifier: str = "logistic_regression"
    strategy: str = "prior"
    seed: int = SEED
    sources: tuple[str, ...] = SOURCE_TECHNIQUES
    options: dict = field(default_factory=dict)  # estimator parameters by name
    values: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    model: Model | None = None

    @property
    def columns(self) -> list[str]:
        return [*self.sources, *[f"has_{s}" for s in self.sources]]

    def _features(self, matrix: DataFrame) -> DataFrame:
        ready = standardised(imputed(matrix, self.sources, self.values), self.scales)
        return VectorAssembler(inputCols=self.columns, outputCol="_features").transform(ready)

    def fit(self, matrix: DataFrame, label: str = "label") -> "Fusion":
        if self.classifier not in CLASSIFIERS:
            raise ValueError(f"unknown fusion classifier: {self.classifier}")
        self.values = imputation_values(matrix, self.sources, self.strategy)
        filled = imputed(matrix, self.sources, self.values)
        self.scales = scaling(filled, self.columns)
        estimator = CLASSIFIERS[self.classifier](filled.count(), self.seed).setLabelCol(label).setFeaturesCol("_features")
        for name, value in self.options.items():
            estimator.set(estimator.getParam(name), value)
        self.model = estimator.fit(self._features(matrix))
        return self

    def score(self, matrix: DataFrame, out: str = "score") -> DataFrame:
        """Keep every column of ``matrix`` except the sources; add the fused score."""
        if self.model is None:
            raise NotFitted("call fit() first")
        keep = [c for c in matrix.columns if c not in self.sources]
        if self.classifier == "logistic_regression":
            # A sum of eight products stays in generated code; no vectors are built.
            return matrix.select(*keep, self.probability(matrix).alias(out))
        return self.model.transform(self._features(matrix)).select(
            *keep, vector_to_array("probability")[1].alias(out))

    def probability(self, matrix: DataFrame) -> Column:
        """The fused score of a row of ``matrix`` as a column expression; logistic regression only."""
        if self.classifier != "logistic_regression" or self.model is None:
            raise NotFitted("call fit() of a logistic fusion first")
        margin = F.lit(float(self.model.intercept))
        weights = dict(zip(self.columns, self.model.coefficients))
        for s in self.sources:
            score = nan_to_null(F.col(s)) if s in matrix.columns else F.lit(None).cast("double")
            for c, value in ((s, F.coalesce(score, F.lit(float(self.values[s])))), (f"has_{s}", score.isNotNull().cast("double"))):
                mean, scale = self.scales[c]
                margin = margin + F.lit(float(weights[c])) * ((value - F.lit(mean)) / F.lit(scale))
        return sigmoid(margin)

    def weights(self, spark: SparkSession) -> DataFrame:
        """(technique, weight): coefficients or importances of the sources, not of the flags."""
        if self.model is None:
            raise NotFitted("call fit() first")
        vector = (self.model.coefficients if self.classifier == "logistic_regression"
                  else self.model.featureImportances)
        return spark.createDataFrame(
            [(s, float(vector[i])) for i, s in enumerate(self.sources)], "technique string, weight double")

    def save(self, path: str) -> None:
        if self.model is None:
            raise NotFitted("call fit() first")
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        state = {"classifier": self.classifier, "strategy": self.strategy, "seed": self.seed,
                 "sources": self.sources, "options": self.options, "values": self.values, "scales": self.scales}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> "Fusion":
        spark = SparkSession.active()
        try:
            state = json.loads(spark.read.text(f"{path}/state").first()["value"])
        except Exception as error:
            raise FileNotFoundError(f"no fusion model at {path}") from error
        state["sources"] = tuple(state["sources"])
        state["scales"] = {c: tuple(v) for c, v in state["scales"].items()}
        return cls(**state, model=_MODELS[state["classifier"]].load(f"{path}/model"))


class _Weights:
    """Intercept and coefficients that were given, not fitted."""

    def __init__(self, intercept: float, coefficients: Sequence[float]):
        self.intercept, self.coefficients = intercept, list(coefficients)


def given(sources: Sequence[str], intercept: float, weights: Sequence[float], flags: Sequence[float] | None = None) -> Fusion:
    """A logistic fusion with weights on the plain scores, 0.5 standing for what is missing."""
    out = Fusion(sources=tuple(sources), values={s: 0.5 for s in sources})
    out.scales = {c: (0.0, 1.0) for c in out.columns}
    out.model = _Weights(intercept, [*weights, *(flags or [0.0] * len(sources))])
    return out


def pick_variant(registry: Mapping[frozenset, str], available: Sequence[str]) -> str | None:
    """The variant fitted on exactly the available sources, else the largest one inside them."""
    have = frozenset(available)
    fits = [k for k in registry if k <= have]
    return registry[max(fits, key=lambda k: (len(k), sorted(k)))] if fits else None


def score_by_availability(matrix: DataFrame, registry: Mapping[frozenset, tuple[str, Fusion]], sources: Sequence[str] = SOURCE_TECHNIQUES,
                          out: str = "score") -> DataFrame:
    """Every row scored by the variant for the sources that it has; ``variant`` says which.

    ``registry`` names a logistic fusion for a set of sources. A row takes the one fitted on exactly its sources, else the largest inside
    them, as :func:`pick_variant` does; without any it has no score. All models are columns of one plan; there are at most 2^sources cases.
    """
    names = {k: name for k, (name, _) in registry.items()}
    models = {name: model for name, model in registry.values()}
    present = lambda s: nan_to_null(F.col(s)).isNotNull() if s in matrix.columns else F.lit(False)
    mask = sum((F.when(present(s), F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(sources)), F.lit(0))
    variant = F.lit(None).cast("string")
    for m in range(1 << len(sources)):
        picked = pick_variant(names, [s for i, s in enumerate(sources) if m >> i & 1])
        if picked:
            variant = F.when(mask == m, F.lit(picked)).otherwise(variant)
    score = F.lit(None).cast("double")
    for name, model in models.items():
        score = F.when(variant == name, model.probability(matrix)).otherwise(score)
    keep = [c for c in matrix.columns if c not in sources]
    return matrix.select(*keep, variant.alias("variant"), score.alias(out))


def available_sources(scores: DataFrame) -> list[str]:
    """Sources that produced at least one score."""
    rows = scores.filter("score is not null").select("technique").distinct().orderBy("technique").collect()
    return [r["technique"] for r in rows]
