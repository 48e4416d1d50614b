"""Connected components of a link table, by joins and minima; no component is ever gathered in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

LINK = "a bigint, b bigint"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some links as stars: each node but the smallest with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for end in (root[x], root[y]):
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _thinned(links: DataFrame) -> DataFrame:
    """Fewer links, same components: those of each Arrow batch become stars."""

    def thin(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.select("a", "b").mapInArrow(thin, LINK)


def connected(links: DataFrame) -> DataFrame:
    """(node, root): every node with a link, and the smallest node of its component.

    Alternating large and small stars. A star's hub may have any number of neighbours: minima are combined
    before they are shuffled, and the joins on the hub are of the kind that Spark splits when skewed.
    """
    links = stored(_thinned(links.filter("a <> b")), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(least, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(joined.select("a", F.col("low").alias("b"))))
        links = stored(small.filter("a <> b").distinct(), "links")
        # Stars are stable: the sums of (node, root) pairs then stay the same.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
