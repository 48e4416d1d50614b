"""Forest over feature vectors: grid search, scoring, importances, persistence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import CV_FOLDS, FOREST_DEPTHS, FOREST_TREES, SEED
from .fusion import NotFitted
from .splits import stratified_folds

MAX_DEPTH = 30  # the deepest tree the trainer accepts; stands for "no limit"


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = rows / (classes * class size)."""
    row = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    n, p = row["n"], row["p"]
    w1, w0 = n / (2.0 * max(p, 1)), n / (2.0 * max(n - p, 1))
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(w1)).otherwise(F.lit(w0)))


@dataclass
class Forest:
    """Random forest chosen by stratified cross-validated AUC."""

    trees: Sequence[int] = FOREST_TREES
    depths: Sequence[int | None] = FOREST_DEPTHS
    folds: int = CV_FOLDS
    seed: int = SEED
    balanced: bool = False
    parallelism: int = 2
    model: RandomForestClassificationModel | None = None
    best: dict = field(default_factory=dict)

    def _vectors(self, df: DataFrame, features: str) -> DataFrame:
        return df.withColumn("_features", array_to_vector(F.col(features)))

    def fit(self, df: DataFrame, features: str = "features", label: str = "label",
            id_col: str = "sample_id") -> "Forest":
        data = self._vectors(df.select(id_col, features, label), features).drop(features)
        if self.balanced:
            data = class_weights(data, label)
        forest = RandomForestClassifier(featuresCol="_features", labelCol=label, seed=self.seed,
                                        featureSubsetStrategy="sqrt")
        if self.balanced:
            forest = forest.setWeightCol("weight")
        grid = (ParamGridBuilder()
                .addGrid(forest.numTrees, list(self.trees))
                .addGrid(forest.maxDepth, [MAX_DEPTH if d is None else d for d in self.depths]).build())
        folded = stratified_folds(data, self.folds, self.seed, label, id_col).cache()
        search = CrossValidator(
            estimator=forest, estimatorParamMaps=grid, numFolds=self.folds, foldCol="fold",
            parallelism=self.parallelism,
            evaluator=BinaryClassificationEvaluator(labelCol=label, numBins=0))
        try:
            fitted = search.fit(folded)
        finally:
            folded.unpersist()
        best = max(range(len(grid)), key=lambda i: fitted.avgMetrics[i])
        self.best = {"n_estimators": grid[best][forest.numTrees], "max_depth": grid[best][forest.maxDepth],
                     "cv_auc": float(fitted.avgMetrics[best])}
        self.model = fitted.bestModel
        return self

    def score(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        if self.model is None:
            raise NotFitted("call fit() first")
        keep = [c for c in df.columns if c != features]
        return self.model.transform(self._vectors(df, features)).select(
            *keep, vector_to_array("probability")[1].alias(out))

    def importances(self, names: DataFrame) -> DataFrame:
        """(position, name, weight) in feature order."""
        if self.model is None:
            raise NotFitted("call fit() first")
        dense = self.model.featureImportances.toArray()
        weights = names.sparkSession.createDataFrame(
            [(i, float(w)) for i, w in enumerate(dense)], "position int, weight double")
        return names.join(weights, "position")

    def save(self, path: str) -> None:
        if self.model is None:
            raise NotFitted("call fit() first")
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "Forest":
        try:
            model = RandomForestClassificationModel.load(path)
        except Exception as error:
            raise FileNotFoundError(f"no forest at {path}") from error
        return cls(model=model)
