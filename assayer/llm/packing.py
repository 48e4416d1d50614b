"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Pieces of documents are dealt by hash into cells of about ``CELL`` pieces, so no task grows with the
corpus. For every cell several islands each evolve a population of packings: a child gets whole well-filled bins
of one parent, bins of the other that hold any of their pieces are broken up, and the displaced pieces are
best-fitted, longest first. After each epoch the elite of an island moves on to the next one (one shuffle of
packings). An island stops once it meets the lower bound of its cell, for nothing can be better. The emptiest sequences
of every cell, one in ``LOOSE``, are then taken out and all of these are packed again in cells of their own, until one cell is left.
Pieces are dealt by what they hold, so the result is the same for any partitions and when executors come or go.

Defined results: null text is an empty document of one token (the end id); repeated rows are packed each for itself;
an empty table gives no rows; only documents longer than ``capacity`` are cut. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, stored
from .encode import encoder

CELL = 4096
LOOSE = 12
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, remember: int = 400_000) -> DataFrame:
    """One row for each piece of each document: its place in the document, its length and the CRC of its ids.

    ``remember`` bounds the words a worker keeps encoded; fewer take less memory and more time.
    """

    def cut(batches):
        codec = encoder(tokenizer, capacity=remember)
        for batch in batches:
            for part, texts in codec.pieces(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                rows = []
                for doc_id, tokens in zip(ids, texts):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    rows += [(doc_id, k, s, len(t := tokens[s:s + capacity]), zlib.crc32(t.tobytes()))
                             for k, s in enumerate(range(0, len(tokens), capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: volume, with the room lost beside large pieces, for every size of the least piece."""
    counts = np.bincount(lengths, minlength=capacity + 2)
    number = np.cumsum(counts[::-1])[::-1]                                  # pieces of a length or longer
    volume = np.cumsum((counts * np.arange(capacity + 2))[::-1])[::-1]
    half, least = capacity // 2 + 1, np.arange(1, capacity // 2 + 1)
    alone = capacity - least + 1            # no piece of ``least`` or more fits beside these
    paired = number[half] - number[alone]
    room = paired * capacity - (volume[half] - volume[alone])
    rest = -(-(volume[least] - volume[half] - room) // capacity)
    return int((number[half] + np.maximum(rest, 0)).max(initial=-(-int(volume[0]) // capacity)))


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> int:
    """Put the pieces of ``order`` one after the other where they leave least room; ``bins`` is filled in place.

    ``free`` holds the room of the bins so far and grows. Returns the number of bins. The bit set of rooms
    that occur makes each step a shift and a lowest bit.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(free):
        if r:
            by_room[r].append(b)
            mask |= 1 << r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        room -= n
        free[b] = room
        bins[i] = b
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return len(free)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Mean squared fill: rewards full bins beside nearly empty ones among packings with as many bins."""
    fill = np.bincount(bins, lengths) / capacity
    return float((fill ** 2).mean())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``b`` go into ``a``; what they displace is best-fitted again."""
    fill = np.bincount(b, lengths)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = np.zeros(len(fill), bool)
    taken[draw.choice(well, max(1, int(len(well) * draw.uniform(0.05, 0.5))), replace=False)] = True
    moved = taken[b]
    broken = np.zeros(a.max() + 1, bool)
    broken[a[moved]] = True
    worst = np.argsort(np.bincount(a, lengths))[:draw.integers(1, 4)]       # mutation: break up the emptiest too
    broken[worst] = True
    kept = ~moved & ~broken[a]
    child = np.full(len(a), -1, np.int64)
    _, child[kept] = np.unique(a[kept], return_inverse=True)
    n_kept = int(child.max()) + 1 if kept.any() else 0
    _, place = np.unique(b[moved], return_inverse=True)
    child[moved] = place + n_kept
    n = int(child.max()) + 1
    free = (capacity - np.bincount(child[child >= 0], lengths[child >= 0], minlength=n)).astype(int).tolist()
    order = np.flatnonzero(child < 0)       # pieces are in descending order of length
    best_fit(order, lengths, child, free, capacity)
    return child


def evolve(lengths: np.ndarray, capacity: int, population: list[np.ndarray], generations: int, size: int,
           draw: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first; ends early at the lower bound."""
    bound = lower_bound(lengths, capacity)
    met = lambda p: int(p.max()) + 1 <= bound
    if not population:
        first = np.zeros(len(lengths), np.int64)
        best_fit(np.arange(len(lengths)), lengths, first, [], capacity)
        population = [first]
    while len(population) < size and not any(map(met, population)):
        one = np.zeros(len(lengths), np.int64)
        best_fit(np.argsort(-lengths * draw.uniform(0.8, 1.25, len(lengths)), kind="stable"), lengths, one, [], capacity)
        population.append(one)
    scored = sorted(((fitness(p, lengths, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for g in range(generations):
        if any(met(p) for _, _, p in scored):
            break
        x, y = draw.choice(min(len(scored), size), 2, replace=False)
        child = crossover(scored[max(x, y)][2], scored[min(x, y)][2], lengths, capacity, draw)
        scored.append((fitness(child, lengths, capacity), len(population) + g, child))
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:size]
    return sorted((p for _, _, p in scored[:size]), key=lambda p: int(p.max()))


def pack_cells(pieces: DataFrame, capacity: int, islands: int, epochs: int, generations: int, size: int,
               seed: int) -> DataFrame:
    """Bins of each cell: (cell, bins), 32-bit bin numbers of its pieces in order of descending length.

    ``pieces`` has cell and length; a cell is bounded by the hash that deals the pieces.
    """
    cells = pieces.groupBy("cell").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("lengths"))
    state = cells.select("cell", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                         F.array().cast("array<binary>").alias("population"))
    schema = "cell bigint, lengths array<int>, island int, n_bins bigint, population array<binary>"

    def one_epoch(epoch: int):
        def step(frames):
            for frame in frames:
                out = []
                for cell, lengths, island, population in zip(frame.cell, frame.lengths, frame.island, frame.population):
                    lengths, draw = np.asarray(lengths, np.int64), np.random.default_rng([seed, int(cell), int(island), epoch])
                    bins = [np.frombuffer(p, np.int32).astype(np.int64) for p in population]
                    best = evolve(lengths, capacity, bins, generations, size, draw)
                    out.append((cell, lengths, island, int(best[0].max()) + 1, [p.astype(np.int32).tobytes() for p in best]))
                yield pd.DataFrame(out, columns=["cell", "lengths", "island", "n_bins", "population"])
        return step

    spark = pieces.sparkSession
    state = state.repartition(2 * partitions(spark), "cell", "island")
    for epoch in range(epochs):
        if epoch:
            # The two best of an island go on to the next one of the ring; it keeps its own too.
            moved = state.select("cell", F.lit(None).cast("array<int>").alias("lengths"),
                                 F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("population", 1, 2).alias("population"))
            state = (state.drop("n_bins").unionByName(moved).groupBy("cell", "island")
                     .agg(F.max("lengths").alias("lengths"), F.flatten(F.collect_list("population")).alias("population"))
                     .select("cell", "lengths", "island", "population"))
        state = stored(state.mapInPandas(one_epoch(epoch), schema), "packings")
    best = F.min_by(F.element_at("population", 1), F.struct("n_bins", "island"))
    return state.groupBy("cell").agg(best.alias("bins"))


def _placed(capacity: int):
    """(cell, rows and bins of a cell) to rows with bin, offset and whether the bin is among the emptiest."""

    def place(rows: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "copy"], ascending=[False] + [True] * 5)
        rows["bin"] = np.frombuffer(solution["bins"].iloc[0], np.int32).astype(np.int64)
        fill = rows.groupby("bin")["length"].transform("sum")
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        bins = pd.DataFrame({"fill": fill, "bin": rows["bin"]}).drop_duplicates().sort_values(["fill", "bin"])["bin"]
        rows["loose"] = rows["bin"].isin(bins.iloc[:max(1, len(bins) // LOOSE)])
        return rows[["cell", "doc_id", "piece", "start", "length", "ids_crc32", "copy", "bin", "offset", "loose"]]

    return place


def pack(pieces: DataFrame, capacity: int = 2048, cell: int = CELL, islands: int = 3, epochs: int = 3,
         generations: int = 30, size: int = 6, seed: int = 0) -> DataFrame:
    """``pieces`` (see ``cut_documents``) with sequence_id and offset; pieces of full length stand alone.

    Rounds are few: each leaves a twelfth of a cell's sequences for the next one.
    """
    names = [f.split()[0] for f in PIECE.split(", ")]
    # Stored once, with numbers: encoding isn't repeated, and the dealing below holds in every later job, however the table is read.
    numbered = stored(told_apart(pieces).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = [numbered.filter(F.col("length") == capacity).select(
        *names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    rest = numbered.filter(F.col("length") < capacity).drop("row")
    number = 0
    while n := rest.count():
        cells = -(-n // cell)
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64(F.lit(number), *names, "copy"), F.lit(cells)))
        solved = pack_cells(dealt, capacity, islands, epochs, generations, size, seed + number)
        done = stored(dealt.groupBy("cell").cogroup(solved.groupBy("cell")).applyInPandas(
            _placed(capacity), f"cell bigint, {PIECE}, copy bigint, bin bigint, offset bigint, loose boolean"), "placed")
        last = cells == 1
        ids = (F.lit(number) * (1 << 58) + F.col("cell") * (1 << 24) + F.col("bin")).cast("bigint")
        kept = done if last else done.filter("not loose")
        placed.append(kept.select(*names, ids.alias("sequence_id"), "offset"))
        if last:
            break
        rest = done.filter("loose").select(*names, "copy")
        number += 1
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def told_apart(pieces: DataFrame) -> DataFrame:
    """The same rows with ``copy``, which numbers equal rows from 0: dealing by content is then the same for any partitions and splits equal rows.

    Equal rows are counted and made again, in two steps of at most ``CELL`` for each row that makes some.
    """
    names = [f.split()[0] for f in PIECE.split(", ")]
    counted = pieces.groupBy(*names).agg(F.count("*").alias("n"))
    high = counted.withColumn("high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / CELL))))
    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(CELL - 1), F.col("n") - 1 - F.col("high") * CELL)))
    return high.select(*names, "high", low.alias("low")).select(*names, (F.col("high") * CELL + F.col("low")).alias("copy"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, remember: int = 400_000, **options) -> DataFrame:
    return pack(cut_documents(docs, tokenizer, capacity, remember=remember), capacity, **options)
