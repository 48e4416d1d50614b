"""A corpus made ready for training: toxic documents go, one of each group of near-duplicates stays, personal data is redacted,
sources are mixed to target weights, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
decides on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import mixing, packing, pii, simhash, toxicity
from assayer.llm.common import ship, stored, table
from assayer.llm.queries import WORD_BPE, tokenizer_file


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labels of the corpus; documents whose probability of any toxicity reaches the cut are rejected."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups by shingles of five words and a similarity of 0.8 or more, verified on the sets of shingles."""
    ship(spark)
    return simhash.one_of_each_similar(docs, words=5, similarity=0.8)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, with flatter source weights: some documents repeat, some of large sources wait."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Executors still hold what earlier stages left in their workers, so fewer words are remembered."""
    ship(spark)
    return packing.packed_documents(docs, tokenizer_file(WORD_BPE), remember=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic), ("simhash", without_copies), ("pii", without_personal_data), ("mixing", mixed_sources), ("packing", packed)]

#: The trained models, the hash and the tokenizer are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
