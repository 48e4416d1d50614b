"""Approximate nearest neighbours by cosine: NN-descent builds the graph, queries walk it greedily.

Every usable vector is indexed; equal vectors are one node, so groups of copies cost nothing. Nodes are
compared in double precision by the squared distance of their unit vectors, summed from differences: in a tight group of near copies it
keeps its relative precision, where rounded products would all be equal. The graph starts from nodes that stand together in
the order of random hyperplane codes. In each round a node's neighbours, and some that have it as neighbour, are joined with their vectors
and compared with one another: neighbours of neighbours. Only pairs with a member that is new since the last round
are compared, and a node keeps its best ``degree``. Rounds end when few neighbours change.

A query walks the graph with a beam: the best ``beam`` nodes found so far that aren't expanded yet are joined with their neighbours, until none
is left or ``walks`` is reached. Queries that are indexed start at their own node, others at some fixed nodes. All nodes
found for a query are ranked by that distance, and the best are scored with the original vectors.

Nothing is grouped by a popular key without a limit: of the nodes that have a node as neighbour ``degree`` are drawn by hash
in each round, best neighbours are ranked with a limit before the shuffle, and of copies the ``k + 1`` smallest ids are kept.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part; of rows with the
same vec_id the largest vector counts; shorter vectors count as padded with zeros; a query isn't compared with its own vec_id;
ties go to the smaller vec_id; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions, seeded, stored

GROUP = 512         # nodes that start as each other's candidates
TABLES = 12
EDGE = "u bigint, v bigint, sim double"


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): one usable vector of each id, in double precision."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return (vectors.filter("vec_id is not null and size(embedding) > 0").filter(good)
            .groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.max("embedding").cast("array<double>").alias("x")))


def _unit(nodes: DataFrame, dims: int, seed: int) -> DataFrame:
    """(u, code, z): unit vectors as doubles, and hyperplane codes of each table."""

    def each(batches):
        planes = np.random.default_rng(seed).standard_normal((dims, TABLES * 16))
        for batch in batches:
            rows = batch.column("x").to_pylist()
            x = np.zeros((len(rows), dims))
            for i, r in enumerate(rows):
                x[i, :len(r)] = r
            x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            bits = (x @ planes > 0).reshape(len(rows), TABLES, 16)
            codes = (bits * (1 << np.arange(16))).sum(axis=2)
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(list(codes), pa.list_(pa.int64())), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())],
                                             ["u", "codes", "z"])

    return nodes.select("u", "x").mapInArrow(each, "u bigint, codes array<bigint>, z binary")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _closeness(z: np.ndarray) -> np.ndarray:
    """Minus the squared distances of all pairs of rows, summed from differences a dimension at a time."""
    sims = np.zeros((len(z), len(z)))
    for x in np.ascontiguousarray(z.T):
        d = x[:, None] - x
        sims -= np.multiply(d, d, out=d)
    return sims


def _compared(ids: np.ndarray, z: np.ndarray, least: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """For every member of a group its ``most`` best others above its own least similarity (minus the squared distance)."""
    sims = _closeness(z)
    sims[(ids[:, None] == ids[None, :]) | ~(fresh[:, None] | fresh[None, :]) | (sims <= least[:, None])] = -np.inf
    m = min(most, len(ids))
    best = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    value = np.take_along_axis(sims, best, axis=1)
    i, j = np.nonzero(np.isfinite(value))
    return ids[i], ids[best[i, j]], value[i, j]


def _edges(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(c) for c in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], ["u", "v", "sim"])


def _start(nodes: DataFrame, most: int) -> DataFrame:
    """Edges among runs of ``GROUP`` nodes in code order; a range of codes, however full, is cut by u."""

    def runs(batches):
        for batch in batches:
            table, u, z = batch.column("table").to_numpy(), batch.column("u").to_numpy(), _matrix(batch.column("z"))
            cuts = np.unique(np.concatenate([np.arange(0, len(u), GROUP), np.flatnonzero(np.diff(table)) + 1, [len(u)]]))
            parts = [_compared(u[a:b], z[a:b], np.full(b - a, -np.inf), np.ones(b - a, bool), most) for a, b in zip(cuts[:-1], cuts[1:])]
            if parts:
                yield _edges(parts)

    rows = nodes.select("u", "z", F.posexplode("codes").alias("table", "code"))
    return rows.repartitionByRange(partitions(nodes.sparkSession), "table", "code", "u").sortWithinPartitions("table", "code", "u").mapInArrow(runs, EDGE)


def _kept(edges: DataFrame, degree: int) -> DataFrame:
    """The best ``degree`` neighbours of each node; equal edges rank alike, and one that was there is old."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return (edges.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= degree)
            .groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")))


def _drawn_reverse(edges: DataFrame, degree: int, salt: int) -> DataFrame:
    """Of the nodes that have v as neighbour, ``degree`` by hash."""
    order = Window.partitionBy("v").orderBy(seeded(salt, F.col("u"), F.col("v")), "u")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= degree).drop("place")


def _round(nodes: DataFrame, edges: DataFrame, degree: int, most: int, salt: int) -> DataFrame:
    """Edges found by comparing each node's neighbours with one another."""
    members = edges.select(F.col("u").alias("centre"), F.col("v").alias("u"), "fresh").unionByName(
        _drawn_reverse(edges, degree, salt).select(F.col("v").alias("centre"), "u", "fresh"))
    least = edges.groupBy("u").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(float("-inf"))).alias("least"))
    members = members.join(nodes.join(least, "u").select("u", "z", "least"), "u")

    def groups(batches):
        held: list[pa.RecordBatch] = []

        def compare(rows: pa.Table):
            centre = rows.column("centre").to_numpy()
            u, fresh, least_sim = (rows.column(c).to_numpy() for c in ("u", "fresh", "least"))
            z = _matrix(rows.column("z").combine_chunks())
            cuts = [0, *(np.flatnonzero(np.diff(centre)) + 1), len(centre)]
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                _, first = np.unique(u[a:b], return_index=True)      # a node may be both kinds of neighbour
                at = a + first
                if len(at) > 1:
                    parts.append(_compared(u[at], z[at], least_sim[at], fresh[at], most))
            return parts

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            centre = rows.column("centre").to_numpy()
            last = np.flatnonzero(centre != centre[-1])
            done = last[-1] + 1 if len(last) else 0
            if done and (parts := compare(rows.slice(0, done))):
                yield _edges(parts)
            held = rows.slice(done).combine_chunks().to_batches()
        if held and (parts := compare(pa.Table.from_batches(held))):
            yield _edges(parts)

    return (members.repartition(partitions(nodes.sparkSession), "centre").sortWithinPartitions("centre", "u").mapInArrow(groups, EDGE))


class Index:
    """Nodes (u, x, z) with their copies' ids, and the graph (u, v); all stored in the shared folder."""

    def __init__(self, vectors: DataFrame, degree: int = 28, rounds: int = 7, most: int = 6, change: float = 0.02, seed: int = 0):
        self.vectors = stored(_usable(vectors), "vectors")
        self.ids = stored(self.vectors.groupBy("x").agg(F.min("vec_id").alias("u"))
                          .join(self.vectors.withColumnRenamed("x", "same"), F.col("x") == F.col("same")).select("u", "vec_id"), "ids")
        distinct = self.vectors.join(self.ids.select("u").distinct(), F.col("vec_id") == F.col("u"), "left_semi").withColumnRenamed("vec_id", "u")
        self.dims = self.vectors.agg(F.max(F.size("x"))).first()[0] or 1
        self.nodes = stored(distinct.join(_unit(distinct, self.dims, seed), "u"), "nodes")
        slim = self.nodes.select("u", "z")
        n = self.nodes.count()
        edges = stored(_kept(_start(self.nodes, degree // 2).withColumn("fresh", F.lit(True)), degree), "edges")
        for k in range(rounds):
            found = _round(slim, edges, degree, most, seed + k).withColumn("fresh", F.lit(True))
            edges = stored(_kept(edges.withColumn("fresh", F.lit(False)).unionByName(found), degree), "edges")
            if edges.filter("fresh").count() <= change * n * degree:
                break
        both = edges.select("u", "v").unionByName(_drawn_reverse(edges, degree, seed - 1).select(F.col("v").alias("u"), F.col("u").alias("v")))
        self.graph = stored(both.distinct(), "graph")

    def search(self, queries: DataFrame, k: int = 5, beam: int = 128, walks: int = 8, entries: int = 256) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found to each of ``queries`` (vec_id, embedding)."""
        asked = stored(_usable(queries), "asked")
        sources = stored(asked.groupBy("x").agg(F.min("vec_id").alias("q")), "sources")        # equal queries walk once
        z = _unit(sources.withColumnRenamed("q", "u"), self.dims, 0).select(F.col("u").alias("q"), F.col("z").alias("zq"))
        points = stored(sources.select("q", "x").join(z, "q"), "points")
        own = points.join(self.nodes.select("u", F.col("x").alias("x")), "x").select("q", "u")
        some = self.nodes.select("u").orderBy(seeded(1, F.col("u"))).limit(entries)              # at most ``entries`` rows
        strangers = points.join(own, "q", "left_anti").select("q").crossJoin(F.broadcast(some))
        found = self._near(own.unionByName(strangers).withColumn("expanded", F.lit(False)), points)
        for _ in range(walks):
            found = stored(found, "found")
            order = Window.partitionBy("q").orderBy(F.desc("sim"), "u")
            beamed = found.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= beam) & ~F.col("expanded")).select("q", "u")
            beamed = stored(beamed, "beam")
            if beamed.isEmpty():
                break
            reached = beamed.join(self.graph, "u").select("q", F.col("v").alias("u")).distinct().join(found.select("q", "u"), ["q", "u"], "left_anti")
            old = found.join(beamed.withColumn("now", F.lit(True)), ["q", "u"], "left").select("q", "u", (F.col("expanded") | F.col("now").isNotNull()).alias("expanded"), "sim")
            found = old.unionByName(self._near(reached.withColumn("expanded", F.lit(False)), points))
        return self._ranked(stored(found, "found"), asked, points, k)

    def _near(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """(q, u, expanded, sim) with minus the squared distance of the unit vectors."""

        def multiply(batches):
            for batch in batches:
                if batch.num_rows:
                    d = _matrix(batch.column("z")) - _matrix(batch.column("zq"))
                    sim = -np.einsum("ij,ij->i", d, d)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "u", "expanded")), pa.array(sim)], ["q", "u", "expanded", "sim"])

        return (pairs.join(self.nodes.select("u", "z"), "u").join(points.select("q", "zq"), "q")
                .mapInArrow(multiply, "q bigint, u bigint, expanded boolean, sim double"))

    def _ranked(self, found: DataFrame, asked: DataFrame, points: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("sim"), "u")
        short = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 4 * k + 4)
        exact = short.join(self.nodes.select("u", F.col("x").alias("y")), "u").join(points.select("q", "x"), "q").select("q", "u", _cosine(F.col("x"), F.col("y")).alias("score"))
        first = Window.partitionBy("u").orderBy("vec_id")
        copies = self.ids.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).select("u", "vec_id")
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        lists = (exact.join(copies, "u").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).select("q", "vec_id", "score"))
        names = asked.join(points.select("q", "x"), "x").select(F.col("vec_id").alias("query_id"), "q")
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (names.join(lists, "q").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(rank))
                .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _cosine(x: Column, y: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    product = F.zip_with(x, y, lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0)))
    square = lambda a: F.sqrt(total(F.transform(a, lambda v: v * v)))
    return total(product) / (square(x) * square(y))


def search(vectors: DataFrame, every: int = 50, k: int = 5, **options) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` against all rows."""
    return Index(vectors, **options).search(vectors.filter(F.col("vec_id") % every == 0), k)
