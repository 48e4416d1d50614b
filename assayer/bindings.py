"""How the driver tables play the roles of score tables and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .constants import (
    DIFFUSION_GENERATORS, HELD_OUT_GENERATORS, LABEL_FAKE, LABEL_REAL, REAL, SOURCE_TECHNIQUES,
    TECHNIQUE_ORDER, TRAINING_GENERATORS,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: label, generator, four technique scores and their mean as fusion."""
    real = F.col("event_type").isin("view", "click")
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"),
        F.when(real, F.lit(REAL)).otherwise(F.col("event_type")).alias("generator"),
        F.when(real, LABEL_REAL).otherwise(LABEL_FAKE).alias("label"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("t01"),
        (F.pmod("user_id", F.lit(97)) / 96.0).alias("t02"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 100.0).alias("t03"),
        F.when(F.pmod("user_id", F.lit(5)) != 0, F.pmod("event_id", F.lit(89)) / 88.0).alias("t04"),
    )
    cols = ["t01", "t02", "t03", "t04"]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.col(cols[0]))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.lit(1))
    return base.withColumn("t05", total / n)


def scored_long(spark: SparkSession, sf_dir: str, techniques=SOURCE_TECHNIQUES) -> DataFrame:
    """(sample_id, label, generator, technique, score); missing scores are dropped."""
    wide = scored_wide(spark, sf_dir)
    return wide.unpivot(
        ["sample_id", "label", "generator"], [t.lower() for t in techniques], "technique", "score"
    ).filter("score is not null").withColumn("technique", F.upper("technique"))


def scored_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_long(spark, sf_dir, TECHNIQUE_ORDER)


def scored_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as two techniques; no unique key, so grouped statistics only."""
    return (
        table(spark, sf_dir, "lineitem")
        .select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise(F.lit(REAL)).alias("generator"),
                F.col("l_discount").alias("discount"),
                (F.col("l_extendedprice") / 100000.0).alias("price"))
        .unpivot(["label", "generator"], ["discount", "price"], "technique", "score")
    )


# Generator name of document source 5, 6, ... 19.
SOURCE_GENERATORS = TRAINING_GENERATORS + DIFFUSION_GENERATORS + HELD_OUT_GENERATORS + ("unlisted_model",)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus manifest: sources 0-4 are real, the others stand for generators."""
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    real = number <= 4
    name = F.try_element_at(F.array(*[F.lit(g) for g in SOURCE_GENERATORS]), number - 4)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.concat(F.when(real, F.lit("real")).otherwise(F.lit("fake")), F.lit("/"), F.col("source"),
                 F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.when(real, LABEL_REAL).otherwise(LABEL_FAKE).alias("label"),
        F.when(real, F.lit(REAL)).otherwise(name).alias("generator"),
        F.col("source"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"),
        F.col("n_chars").alias("size"),
    )


def components(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three partly overlapping component tables (name, split, label, score) over events."""
    base = scored_wide(spark, sf_dir).select(
        F.concat(F.lit("event_"), F.col("sample_id").cast("string")).alias("name"),
        F.when(F.pmod("sample_id", F.lit(10)) < 7, F.lit("train"))
        .when(F.pmod("sample_id", F.lit(10)) == 7, F.lit("val")).otherwise(F.lit("test")).alias("split"),
        "label", "sample_id", "t01", "t02")
    keep = lambda k, score: base.filter(F.pmod("sample_id", F.lit(k)) != 0).select(
        "name", "split", "label", score.alias("score"))
    return {
        "perspective_fields": keep(3, F.pmod("sample_id", F.lit(101)) / 100.0),
        "line_segment": keep(4, F.col("t02")),
        "object_shadow": keep(5, F.col("t01")),
    }


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embedding rows as the instance masks of one sample, in two classes."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("sample"), F.col("vec_id").alias("instance"),
        F.pmod("vec_id", F.lit(2)).cast("int").alias("klass"), F.col("label").alias("confidence"),
        F.posexplode("embedding").alias("pixel", "v"),
    ).select("sample", "instance", "klass", "confidence", "pixel", ((F.col("v").cast("double") + 1.0) / 2.0).alias("value"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 pixel blocks: 64 values in 0..255."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("sample"), F.col("vec_id").alias("block"),
        F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(
            F.lit(255.0), F.rint((v.cast("double") + 1.0) * 128.0)))).alias("pixels"),
    )
