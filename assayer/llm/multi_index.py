"""Near-duplicate vectors by cosine, found through an inverted multi-index.

The two halves of the unit vectors have codebooks of their own; an entry for each half names a cell of the product grid. A vector lives in the cell of its
nearest entries and visits the cells nearest to it, in the order of the summed squared distances of the halves (multi-sequence order), until the target recall is
reached: the number of visits is the one with which ``target`` of trial pairs meet, the trial pairs being sampled vectors and others turned from them by exactly the
angle of the threshold in a random direction. Nearer pairs meet sooner. A pair meets if either visits the other's cell.

In a cell every resident meets every other resident and every visitor; cosines are exact, in double precision, on the original vectors. A pair that meets in two cells counts in the
higher-numbered one. Equal vectors are one node with a weight before anything is compared. Cells with more than ``TILE`` residents or visitors are cut into tiles and every
pair of tiles is a group of its own. A group hands on the number of links of each node and a spanning forest of them, never the pairs.

Codebooks are fitted on at most ``SAMPLE`` distinct vectors (fewer if they are long); the index holds all.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are returned; repeated rows and equal vectors are linked with each
other; shorter vectors count as padded with zeros; a null vec_id names no component: a group of such rows alone has a null component_id and all of it is kept; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, stored
from .components import connected, forest

SAMPLE, SAMPLE_NUMBERS = 20_000, 1 << 22
PER_CELL = 16
BOOK = 1024
TILE = 4096
CHUNK = 1 << 22


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch at length one, in double precision, padded to ``dims``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    out /= np.abs(out).max(axis=1, initial=1e-320, keepdims=True)        # neither the squares of large nor those of small components are lost
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)


def codebook(x: np.ndarray, entries: int, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Means of groups; an entry that no vector is nearest to starts again at the vector farthest from its own."""
    book = x[draw.choice(len(x), entries, replace=False)].copy()
    for _ in range(rounds):
        d = distances(x, book)
        near = d.argmin(axis=1)
        n = np.bincount(near, minlength=entries)
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        book = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        book[empty] = x[np.argsort(-d[np.arange(len(x)), near], kind="stable")[:len(empty)]]
    return book


def nearest_cells(u: np.ndarray, books: list[np.ndarray], visits: int) -> np.ndarray:
    """The first ``visits`` cells of each vector in multi-sequence order, the home cell first.

    With both halves' entries sorted by distance, the cell of ranks (a, b) comes after the (a + 1)(b + 1) - 1 cells of lower ranks, so
    only ranks with (a + 1)(b + 1) <= visits can be among the first.
    """
    k, cut = len(books[0]), books[0].shape[1]
    far = [distances(u[:, :cut], books[0]), distances(u[:, cut:], books[1])]
    reach = min(k, visits)
    order = [np.argsort(f, axis=1, kind="stable")[:, :reach] for f in far]
    low = [np.take_along_axis(f, o, axis=1) for f, o in zip(far, order)]
    a, b = np.array([(a, b) for a in range(reach) for b in range(min(reach, visits // (a + 1)))]).T
    total = low[0][:, a] + low[1][:, b]
    first = np.argsort(total, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(order[0][:, a] * k + order[1][:, b], first, axis=1)


class Index:
    """Codebooks and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, nodes: int, threshold: float, target: float, visits: int | None = None, per_cell: int = PER_CELL, trials: int = 2000):
        draw = np.random.default_rng(13)
        self.dims = sample.shape[1]
        cut = (self.dims + 1) // 2
        entries = max(1, min(BOOK, len(sample) // 4, round(math.sqrt(nodes / per_cell))))
        self.books = [codebook(half, entries, draw) for half in (sample[:, :cut], sample[:, cut:])]
        if visits:
            self.visits = min(entries ** 2, visits)
            return
        u = sample[draw.choice(len(sample), min(trials, len(sample)), replace=False)]
        turn = draw.standard_normal(u.shape)
        turn -= (turn * u).sum(axis=1, keepdims=True) * u
        size = np.sqrt((turn * turn).sum(axis=1, keepdims=True))
        v = threshold * u + math.sqrt(max(0.0, 1 - threshold ** 2)) * turn / np.where(size > 0, size, 1)
        self.visits = min(entries ** 2, 8)
        while True:
            there, back = nearest_cells(u, self.books, self.visits), nearest_cells(v, self.books, self.visits)
            met = (there == back[:, :1]) | (back == there[:, :1])
            rank = np.where(met.any(axis=1), met.argmax(axis=1), self.visits)
            if (rank < self.visits).mean() >= target or self.visits == entries ** 2:
                break
            self.visits = min(entries ** 2, 2 * self.visits)
        self.visits = min(self.visits, int(np.quantile(rank, target, method="higher")) + 1)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(node, embedding, least, n): every usable vector once, the smallest id that has it, and how many rows do; and the longest vector."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    nodes = (vectors.filter(F.col("embedding").isNotNull()).filter(usable).groupBy("embedding")
             .agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("n")))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")          # written, so that a node keeps its number
    return nodes, nodes.agg(F.max(F.size("embedding"))).first()[0] or 0


def build_index(nodes: DataFrame, dims: int, threshold: float, target: float, visits: int | None = None) -> Index:
    rows = max(1, min(SAMPLE, SAMPLE_NUMBERS // dims))
    sample = nodes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(rows).toArrow()
    return Index(units(sample.column("embedding").combine_chunks(), dims), nodes.count(), threshold, target, visits)


def _placed(nodes: DataFrame, index: Index) -> DataFrame:
    """(node, n, embedding, home, cells), one row for each node."""

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cells = nearest_cells(units(batch.column("embedding"), index.dims), index.books, index.visits).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("n"), batch.column("embedding"), pa.array(cells[:, 0]),
                     pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1], pa.array(cells.ravel()))],
                    ["node", "n", "embedding", "home", "cells"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return stored(nodes.select("node", "n", "embedding").mapInArrow(place, f"node long, n long, embedding {kind}, home int, cells array<int>"), "placed")


def _groups(placed: DataFrame, tile: int) -> DataFrame:
    """Every node in its home cell and in those it visits, dealt to groups (cell, a, b) of at most two blocks."""
    at = placed.select("node", "n", "embedding", "home", "cells", F.explode("cells").alias("cell"))
    at = at.withColumn("resident", F.col("cell") == F.col("home")).withColumn("cells", F.when(F.col("resident"), F.col("cells")))
    full = placed.select("home", F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.sum((F.col("cell") == F.col("home")).cast("long")).alias("residents"), F.sum((F.col("cell") != F.col("home")).cast("long")).alias("visitors"))
    # Few: each has more than ``tile`` rows. Spark broadcasts the stored table only if it is small.
    hot = stored(full.filter((F.col("residents") > tile) | (F.col("visitors") > tile)).select(
        "cell", F.greatest(F.lit(1), F.ceil(F.col("residents") / tile)).cast("int").alias("r"), F.ceil(F.col("visitors") / tile).cast("int").alias("q")), "hot")
    dealt = at.join(hot, "cell", "left")
    block = F.when(F.col("r").isNull(), F.lit(0)).when(F.col("resident"), F.pmod(F.xxhash64("node"), "r")).otherwise(F.col("r") + F.pmod(F.xxhash64("node"), "q")).cast("int")
    others = F.when(F.col("r").isNull(), F.lit(1)).when(F.col("resident"), F.col("r") + F.col("q")).otherwise(F.col("r"))
    return (dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
            .select("cell", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "n", "embedding", "home", "cells"))


def group_links(cell: int, cross: bool, block: np.ndarray, node: np.ndarray, n: np.ndarray, u: np.ndarray, home: np.ndarray, cells: np.ndarray, threshold: float):
    """(nodes, links, a, b): links of a group's nodes that count here, and a forest of them. ``cells`` are the residents' visits, in their order."""
    lives = home == cell
    rows, guests = np.flatnonzero(lives), np.flatnonzero(~lives)
    cells = np.sort(cells, axis=1)
    links, star = np.zeros(len(node), np.int64), []
    if not len(rows):
        return links, star
    for at in range(0, len(rows), step := max(1, CHUNK // len(node))):
        mine = rows[at:at + step]
        near = u[mine] @ u.T >= threshold
        if cross:
            near &= block[mine][:, None] != block[None, :]
        # Residents count a pair once; of a pair that meets in two cells the higher one counts it.
        near[:, rows] &= mine[:, None] < rows[None, :]
        if len(guests):
            met = guests[near[:, guests].any(axis=0)]
            again = met[home[met] > cell]
            if len(again):
                homes, of = np.unique(home[again], return_inverse=True)
                mutual = np.zeros((len(mine), len(homes)), bool)
                visits = cells[at:at + step]
                keys = (np.arange(len(mine), dtype=np.int64)[:, None] << 32 | visits).ravel()
                asked = np.arange(len(mine), dtype=np.int64)[:, None] << 32 | homes[None, :]
                mutual = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
                near[:, again] &= ~mutual[:, of]
        x, y = np.nonzero(near)
        if len(x):
            links[mine] += near @ n
            links += n[mine] @ near
            star.append(forest(node[mine[x]], node[y]))
    return links, star


def _found(groups: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(a, b, links): a node's links (a = b), and edges of forests (links = 0)."""
    key = ["cell", "a", "b"]

    def search(batches):
        def found(rows: pa.Table):
            keys = np.stack([rows.column(c).to_numpy() for c in key])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), rows.num_rows]
            block, node, n, home = (rows.column(c).to_numpy() for c in ("block", "node", "n", "home"))
            u = units(rows.column("embedding").combine_chunks(), dims)
            visits = rows.column("cells").combine_chunks()
            lives = np.concatenate([[0], np.cumsum(visits.is_valid().to_numpy(zero_copy_only=False))])
            flat = visits.flatten().to_numpy().astype(np.int64)
            flat = flat.reshape(int(lives[-1]), -1) if lives[-1] else np.zeros((0, 1), np.int64)
            nodes, links, edges = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s > 1:
                    some, star = group_links(int(keys[0, s]), keys[1, s] != keys[2, s], block[s:e], node[s:e], n[s:e], u[s:e], home[s:e], flat[lives[s]:lives[e]], threshold)
                    if star:
                        nodes.append(node[s:e][some > 0])
                        links.append(some[some > 0])
                        edges += star
            if nodes:
                a, b = (np.concatenate(x) for x in zip(*edges))
                nodes, links = np.concatenate(nodes), np.concatenate(links)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((nodes, a), (nodes, b), (links, np.zeros(len(a), np.int64)))], ["a", "b", "links"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = np.stack([batch.column(c).to_numpy()[[0, -1]] for c in key])
            if len(held) > 1 and (ends[:, 0] == ends[:, 1]).all() and all(held[0].column(c)[-1].as_py() == x for c, x in zip(key, ends[:, 1])):
                continue                                            # still within one group
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows.column(c).to_numpy() for c in key])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            done = other[-1] + 1 if len(other) else 0               # the last group may go on in the next batch
            if done:
                yield from found(rows.slice(0, done))
            held = rows.slice(done).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    spark = groups.sparkSession
    return stored(groups.repartition(partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(search, "a long, b long, links long"), "found")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, target: float = 0.99, tile: int = TILE, visits: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors`` (vec_id, embedding); ``threshold`` above 0.

    A given number of ``visits`` replaces the one found for the target.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    nodes, dims = distinct_vectors(rows)
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dims:
        return alone(rows)
    found = _found(_groups(_placed(nodes, build_index(nodes, dims, threshold, target, visits)), tile), dims, threshold)
    links = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected(found.filter("a <> b"))
    judged = (nodes.join(links, "node", "left").join(roots, "node", "left")
              .select("embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    judged = stored(judged, "judged")
    least = judged.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = judged.join(least, "root").select("embedding", "n_links", "component_id", F.lit(True).alias("used"))
    # Many rows may have one vector: Spark splits the rows of a skewed key.
    joined = rows.join(judged, "embedding", "left")
    component = F.when(F.col("used"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))


def near_vectors_sql(threshold: float = 0.95) -> str:
    """All pairs in DuckDB; vectors of one length."""
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
  coalesce(len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable FROM embeddings),
unit AS MATERIALIZED (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE usable),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM unit a JOIN unit b ON a.r <> b.r AND list_dot_product(a.e, b.e) / (a.size * b.size) >= {threshold}),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT x.a, l.b FROM reach x JOIN link l ON x.b = l.a),
least AS (SELECT x.a AS r, min(v.vec_id) AS component_id FROM reach x JOIN v ON x.b = v.r GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN n USING (r)"""
