"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from . import bit_sliced, code_trie, mixing, multi_index, nn_descent, packing, pii, simhash, token_counts, token_store, toxicity, url_filter, variants
from .common import ship, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), tokenizer_file(BYTE_BPE))
    return token_store.stored_documents(store, spark).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# Fixed values of the query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.search(table(spark, sf_dir, "embeddings"))


OP6_SQL = """WITH v AS (
  SELECT vec_id, list_transform(max(embedding), lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) GROUP BY 1),
q AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM q) WHERE rank <= 10"""


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.search(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))
    return toxicity.score(docs, model, ("doc_id",))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
                        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))


def op11_code_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_trie.compress(table(spark, sf_dir, "embeddings")).drop("label")


OP11_SQL = f"SELECT * EXCLUDE (label) FROM ({code_trie.compress_sql()})"


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def _shipping(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


LLM_QUERIES = {q.__name__: _shipping(q) for q in (op1_simhash, op2_mixing, op3_token_store, op4_token_counts, op5_url_filter, op6_bit_sliced, op7_nn_descent,
                                                      op8_toxicity, op9_pii, op10_packing, op11_code_trie,
                                                      op12_variants, op13_multi_index)}
LLM_ORACLES = {"op2_mixing": mixing.plan_sql(), "op5_url_filter": url_filter.judge_sql(URL_RULES), "op6_bit_sliced": OP6_SQL,
               "op11_code_trie": OP11_SQL, "op12_variants": variants.variants_sql(),
               "op13_multi_index": multi_index.near_vectors_sql()}
