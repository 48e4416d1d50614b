"""Exact top-k by integer inner product on a bit-sliced index.

Components become integers floor(scale x). The index cuts vectors by hash of vec_id into blocks of about ``ROWS``; in a block, bit b of
component d of all vectors is one bitmap, 64 vectors to a machine word. A query multiplies slices by shifting and
adds them with carry-save adders, three bitmaps of a weight becoming one of that weight and one of the next, until one bitmap is left for each
bit of the score. The best rows are picked from the most significant score slice downward: rows with the bit set are in if
there is room for all of them, else only they stay candidates. Rows still tied after the last slice have equal
scores and are resolved by vec_id.

A stated set of queries meets all vectors block by block: each task has one block of queries and one of the index, and hands on
its k best; the last step ranks k rows for each query and block.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; of rows with
the same vec_id the largest vector (component by component) counts; a query isn't compared with its own
vec_id; shorter vectors count as padded with zeros; ties go to the smaller vec_id; empty tables give no rows. A scaled
component of 2^40 or more in size, or a score beyond 64 bits, is refused. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import partitions, stored

ROWS = 16_384
QUERIES = 64
ALL = ~np.uint64(0)


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): one usable vector of each id, its components as integers."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = (vectors.filter("vec_id is not null and size(embedding) > 0").filter(usable)
             .groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.max("embedding").alias("embedding")))
    sized = F.when(F.exists("embedding", lambda x: F.abs(scale * x.cast("double")) >= 2.0 ** 40),
                   F.raise_error(F.lit("component too large to slice"))).otherwise(F.col("embedding"))
    return whole.select("vec_id", F.transform(sized, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (component, bit, word) of integers (row, component) less their least one; and that."""
    low = int(values.min())
    bits = max(1, int(values.max() - low).bit_length())
    rows, dims = values.shape
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = values - low
    out = np.empty((dims, bits, len(padded) // 64), np.uint64)
    for b in range(bits):
        packed = np.packbits((padded >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b] = np.ascontiguousarray(packed).view(np.uint64)
    return out, low


def build_index(numbers: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row for each block: ids in order, bitmaps and their shape. ``numbers`` is ``quantised``; a block is bounded by its hash."""
    blocks = max(1, -(-numbers.count() // rows))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        dims = max(map(len, part["v"]))
        values = np.zeros((len(part), dims), np.int64)
        for i, v in enumerate(part["v"]):
            values[i, :len(v)] = v
        maps, low = slices(values)
        return pd.DataFrame([{"block": part["block"].iloc[0], "ids": part["vec_id"].to_numpy(np.int64).tobytes(), "maps": maps.tobytes(),
                              "dims": dims, "bits": maps.shape[1], "low": low}])

    keyed = numbers.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return stored(keyed.groupBy("block").applyInPandas(build, "block int, ids binary, maps binary, dims int, bits int, low long"), "index")


def product_slices(maps: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of sum |q_d| z_d by weight, z_d being the sliced component, or its complement where q_d < 0."""
    dims, bits, words = maps.shape
    size, flip = np.abs(query), np.where(query < 0, ALL, np.uint64(0))
    weights: list[list[np.ndarray]] = [[] for _ in range(bits + int(size.max(initial=0)).bit_length() + dims.bit_length() + 1)]
    for j in range(int(size.max(initial=0)).bit_length()):
        d = np.flatnonzero(size >> j & 1)
        for b in range(bits):
            weights[j + b].append(maps[d, b] ^ flip[d, None])
    out = []
    for w, parts in enumerate(weights):
        v = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
        while len(v) > 1:
            t = len(v) // 3
            if t:
                x, y, z = v[:t], v[t:2 * t], v[2 * t:3 * t]
                half = x ^ y
                carry, rest = (x & y) | (half & z), v[3 * t:]
                v = np.concatenate([half ^ z, rest])
            else:
                carry, v = v[:1] & v[1:], v[:1] ^ v[1:]
            if w + 1 < len(weights):
                weights[w + 1].append(carry)
        out.append(v[0] if len(v) else np.zeros(words, np.uint64))
    return out


def best_rows(scores: list[np.ndarray], eligible: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows with the largest scores, ties to smaller positions."""
    inside, n, tied = np.zeros_like(eligible), 0, eligible
    for s in reversed(scores):
        upper = tied & s
        c = int(np.bitwise_count(upper).sum())
        if n + c > k:
            tied = upper
        else:
            inside, n, tied = inside | upper, n + c, tied & ~s
    places = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    return np.concatenate([places(inside), places(tied)[:k - n]])


def search_block(maps: np.ndarray, low: int, ids: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's k best rows for a query."""
    dims, bits, words = maps.shape
    q = np.zeros(dims, np.int64)
    q[:min(dims, len(query))] = query[:dims]
    if int(np.abs(q).sum()) * max(abs(low), abs(low + (1 << bits))) >= 1 << 62:
        raise ValueError("score beyond 64 bits")
    eligible = np.packbits(np.arange(64 * words) < len(ids), bitorder="little").view(np.uint64).copy()
    own = np.searchsorted(ids, query_id)
    if own < len(ids) and ids[own] == query_id:
        eligible[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
    scores = product_slices(maps, q)
    at = best_rows(scores, eligible, k)
    total = np.zeros(len(at), np.int64)
    for w, s in enumerate(scores):
        total += (s[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << w
    shift = int(q[q > 0].sum()) * low + int(q[q < 0].sum()) * (low + (1 << bits) - 1)
    return ids[at], total + shift


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best; ``queries`` has vec_id and v (see ``quantised``)."""
    spark = index.sparkSession
    n, blocks = queries.count(), [r.block for r in index.select("block").collect()]     # a number for each block
    groups = max(1, -(-n // QUERIES))
    asked = (queries.withColumn("asked", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(groups)).cast("int"))
             .groupBy("asked").agg(F.collect_list(F.struct("vec_id", "v")).alias("questions")))
    fan = max(partitions(spark), min(groups * len(blocks), 8 * partitions(spark)))
    left = asked.withColumn("block", F.explode(F.array(*map(F.lit, blocks)).cast("array<int>"))).repartition(fan, "asked", "block")
    right = index.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(fan, "asked", "block")

    def search(questions: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(questions) and len(block):
            b = block.iloc[0]
            ids = np.frombuffer(b["ids"], np.int64)
            maps = np.frombuffer(b["maps"], np.uint64).reshape(b["dims"], b["bits"], -1)
            for q in questions["questions"].iloc[0]:
                found, scores = search_block(maps, int(b["low"]), ids, q["vec_id"], np.asarray(q["v"], np.int64), k)
                out.append(pd.DataFrame({"query_id": q["vec_id"], "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score"])

    best = left.groupBy("asked", "block").cogroup(right.groupBy("asked", "block")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")       # k rows for each block of the index
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` against all rows."""
    numbers = stored(quantised(vectors), "numbers")
    return top_k(build_index(numbers), numbers.filter(F.col("vec_id") % every == 0), k)
