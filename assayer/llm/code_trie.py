"""Compression of vectors into short codes: product quantisation whose assignments walk a trie of the distinct parts.

Components become integers floor(scale x); vectors are cut into equal consecutive parts. A part's codebook starts as that part of
the rows with the smallest ids and is refined in rounds: every part goes to its nearest entry, every entry becomes the
componentwise floor of the mean of its parts.

Equal parts are counted once, before anything is compared. The distinct parts stand in lexicographic order, which is the order in which a
depth-first traversal meets the leaves of their trie: a node is a run of rows with equal leading components. For each node the
squared distances to all entries, added up over its components, come from those of the node above it, so common
prefixes are added once. A leaf takes the nearest entry and gives its components, times its count, to that entry's sums. Tasks walk a range of
leaves each and keep the path to the last one, block by block; only sums for each entry leave a task, and only the codebooks reach the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; repeated rows are coded each for itself and
weigh each; shorter (also empty) vectors count as padded with zeros, up to the next multiple of the number of parts; rows without vec_id are coded and come last where
the smallest ids are taken; of equal ids the smaller vector comes first; fewer rows than entries give a smaller codebook; ties go to the lower
entry; null labels are one label; an empty table gives no rows. Components so large that a squared distance might not fit 64 bits are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import partitions, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096


def integers(vectors: DataFrame, scale: int, label: str) -> DataFrame:
    """(vec_id, label, v) of the usable rows."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col("embedding").isNotNull()).filter(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))


def padded(numbers: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """All vectors with the same number of components, a multiple of ``parts``, and the width of a part."""
    size = numbers.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = max(1, -(-(size[0] or 0) // parts))
    if 4 * (size[1] or 0) ** 2 * width * parts >= 1 << 63:
        raise ValueError("components too large: a squared distance might not fit 64 bits")
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("v"))
    return numbers.withColumn("v", F.concat("v", fill)), width


def first_books(numbers: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, component) from the rows with the smallest ids."""
    rows = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2)


def distinct_parts(numbers: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, x, n), in lexicographic order and in ranges of it."""
    cut = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", p * width + 1, width).alias("x")) for p in range(parts)])
    rows = numbers.select(F.explode(cut).alias("c")).select("c.part", "c.x").groupBy("part", "x").agg(F.count("*").alias("n"))
    return stored(rows.repartitionByRange(partitions(numbers.sparkSession), "part", "x").sortWithinPartitions("part", "x"), "parts")


class Walk:
    """A depth-first walk over leaves in order; ``path`` holds the sums at every depth on the way to the last leaf."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.last, self.path = entries, None, None

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each of the next leaves, and its squared distance."""
        best, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            best[at:at + BLOCK], least[at:at + BLOCK] = self._block(x[at:at + BLOCK])
        return best, least

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row 0 stands for the leaf before this block, whose sums are known; its path is replaced by the one to the block's last leaf."""
        e = self.entries
        rows = np.concatenate([x[:1] if self.last is None else self.last[None], x])
        shared = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)
        if self.last is None:
            shared[0] = False
            self.path = np.zeros((x.shape[1], len(e)), np.int64)
        above, node = np.zeros((1, len(e)), np.int64), np.zeros(len(x), np.int64)
        path = []
        for d in range(x.shape[1]):
            new = np.flatnonzero(~shared[:, d])
            step = x[new, d, None] - e[None, :, d]
            above = np.concatenate([self.path[d][None], above[node[new]] + step * step])
            node = np.cumsum(~shared[:, d])
            path.append(above[node[-1]])
        self.last, self.path = x[-1], np.array(path)
        best = above.argmin(axis=1)
        return best[node], above[np.arange(len(above)), best][node]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def refined(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    n_parts, entries, width = books.shape

    def sums(batches):
        total, count, walks = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), [Walk(b) for b in books]
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            x = _matrix(batch.column("x"), width)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                best, _ = walks[p].leaves(x[at])
                np.add.at(count[p], best, n[at])
                np.add.at(total[p], best, x[at] * n[at, None])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    partial = parts.mapInArrow(sums, "part long, entry long, n long, s array<long>")
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[d]) for d in range(width)]).alias("s"))
    out = books.copy()
    for r in rows.collect():                            # one row for each used entry
        out[r.part, r.entry] = [s // r.n for s in r.s]
    return out


def encoded(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): each batch's distinct parts are walked; no shuffle."""
    n_parts, _, width = books.shape
    label = numbers.schema["label"].dataType

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), n_parts * width)
            codes, error = np.empty((len(v), n_parts), np.uint8), np.zeros(len(v), np.int64)
            for p in range(n_parts):
                x, row = np.unique(v[:, p * width:(p + 1) * width], axis=0, return_inverse=True)
                best, least = Walk(books[p]).leaves(x)
                codes[:, p], error = best[row.ravel()], error + least[row.ravel()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return numbers.mapInArrow(encode, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label),
                                                    T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(numbers: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 1) -> np.ndarray:
    books = first_books(numbers, parts, width, entries)
    leaves = distinct_parts(numbers, parts, width)
    for _ in range(rounds if books.size else 0):
        books = refined(leaves, books)
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable row; at most 256 entries, two hex digits each."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    numbers, width = padded(stored(integers(vectors, scale, label), "integers"), parts)
    books = train(numbers, parts, entries, rounds, width)
    rows = stored(encoded(numbers, books), "codes")
    # Few rows for few labels: Spark broadcasts the stored table below its own threshold, else splits skewed labels.
    by_label = stored(rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    return (rows.join(by_label, rows.label.eqNullSafe(by_label.same), "left")
            .select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")))


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB; vectors of one length, a multiple of ``parts``."""
    floor = "((s - ((s % c) + c) % c) // c)::BIGINT"
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
cut AS MATERIALIZED (SELECT vec_id, label, v, p::BIGINT AS p, v[(p * len(v) // {parts} + 1):((p + 1) * len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
part AS MATERIALIZED (SELECT p, x, count(*) AS n FROM cut GROUP BY 1, 2),
book0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM cut) WHERE e < {entries})"""]
    near = lambda k: f"""near{k} AS MATERIALIZED (SELECT p, x, any_value(n) AS n, arg_min(e, [d, e]) AS e, min(d)::BIGINT AS d FROM (
  SELECT q.p, q.x, q.n, b.e, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM part q JOIN book{k} b USING (p)) GROUP BY 1, 2)"""
    for k in range(rounds):
        steps += [near(k), f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
  SELECT p, e, list(f ORDER BY i) AS x FROM (SELECT p, e, i, {floor} AS f FROM (
    SELECT p, e, i, sum(n * x[i])::HUGEINT AS s, sum(n)::HUGEINT AS c FROM near{k}, range(1, len(x) + 1) t(i) GROUP BY 1, 2, 3)) GROUP BY 1, 2) m USING (p, e))"""]
    return "WITH " + ",\n".join(steps + [near(rounds), f"""
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT c.vec_id, c.label, c.v, string_agg(printf('%02x', a.e), '' ORDER BY c.p) AS code, sum(a.d)::BIGINT AS error
  FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id, label, v) AS r FROM cut) c JOIN near{rounds} a USING (p, x) GROUP BY c.vec_id, c.label, c.v, c.r)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, sha"""])
