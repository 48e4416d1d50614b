"""ROC points, placement values, DeLong comparison and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import LABEL_FAKE, LABEL_REAL, SEED
from ..functions.numeric import ratio, two_sided_p
from ..session import default_blocks, materialize, small_table
from .draws import SIGN, allotted, leaf_of, md5_numbers, order_bits
from .ranking import fixed_block, fixed_points, row_points, seeded_rank, with_row_block


#: Rows that a task sorts or groups where their number decides how many tasks there are, and blocks for each such task.
TASK_ROWS, TASK_BLOCKS = 500_000, 8


def _score_counts(df: DataFrame, group: list[str], score: str, label: str,
                  n_blocks: int | None) -> DataFrame:
    """(group, block, score) with the counts of fakes ``p`` and reals ``r``."""
    rows = df.filter(F.col(score).isNotNull()).select(
        *group, F.col(score).cast("double").alias("s"),
        (F.col(label) == LABEL_FAKE).cast("bigint").alias("p"), (F.col(label) == LABEL_REAL).cast("bigint").alias("r"))
    block = fixed_block(rows, "s", n_blocks)
    return (
        rows.groupBy(*group, "s")
        .agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        .withColumn("blk", block)
    )


def roc_points(
    df: DataFrame, group: Sequence[str], score: str = "score", label: str = "label",
    n_blocks: int | None = None,
) -> DataFrame:
    """ROC points per group by descending threshold, collinear points dropped.

    The leading point has a NULL threshold (the infinite one) and rates 0, 0.
    """
    group = list(group)
    counts = _score_counts(df, group, score, label, n_blocks)
    desc = W.partitionBy(*group, "blk").orderBy(F.desc("s"))
    local = counts.withColumns({
        "cp": F.sum("p").over(desc.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "cr": F.sum("r").over(desc.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "next_p": F.lead("p").over(desc), "next_r": F.lead("r").over(desc),
        "first_in_block": F.row_number().over(desc) == 1,
    })
    by_block = W.partitionBy(*group).orderBy(F.desc("blk"))
    whole = W.partitionBy(*group)
    blocks = (
        counts.groupBy(*group, "blk")
        .agg(F.sum("p").alias("bp"), F.sum("r").alias("br"),
             F.max_by(F.struct("p", "r"), "s").alias("head"))
        .withColumns({
            "before_p": F.coalesce(F.sum("bp").over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "before_r": F.coalesce(F.sum("br").over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "after": F.lead("head").over(by_block),
            "first_block": F.row_number().over(by_block) == 1,
            "n_p": F.sum("bp").over(whole), "n_r": F.sum("br").over(whole),
        })
    )
    points = local.join(blocks, [*group, "blk"]).select(
        *group, "s", "p", "r", "n_p", "n_r",
        (F.col("cp") + F.col("before_p")).alias("tp"), (F.col("cr") + F.col("before_r")).alias("fp"),
        F.coalesce("next_p", "after.p").alias("q_p"), F.coalesce("next_r", "after.r").alias("q_r"),
        (F.col("first_block") & F.col("first_in_block")).alias("first"))
    kept = points.filter(
        F.col("first") | F.col("q_p").isNull()
        | (F.col("q_p") != F.col("p")) | (F.col("q_r") != F.col("r")))
    point = F.struct(F.col("s").alias("threshold"), ratio(F.col("fp"), F.col("n_r")).alias("fpr"),
                     ratio(F.col("tp"), F.col("n_p")).alias("tpr"))
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    both = F.when(F.col("first"), F.array(start, point)).otherwise(F.array(point))
    return kept.select(*group, F.explode(both).alias("_pt")).select(*group, "_pt.*")


def placements(
    rows: DataFrame, group: Sequence[str], score: str = "score", label: str = "label",
    n_blocks: int | None = None, out: str = "placement",
) -> DataFrame:
    """Add each row's placement: for a fake the share of reals below it, for a real
    the share of fakes above it, ties one half.

    Rows are shuffled once, by (group, block). A frequent score is a block of its
    own whose rows need only the block totals, so they are not shuffled at all.
    """
    group = list(group)
    place = _placer(rows, group, score, label, n_blocks)
    single = place(rows.filter(place.single), out, alone=True)
    return place(rows.filter(~place.single), out).unionByName(single).select(*rows.columns, out)


class _placer:
    """Placements by one score, its blocks and their totals taken beforehand; applies to any table with the same scores."""

    def __init__(self, rows: DataFrame, group: list[str], score: str, label: str, n_blocks: int | None):
        self.group, self.score, self.label = group, score, label
        self.points, self.single = row_points(rows, score, n_blocks)
        self.p, self.r = (F.col(label) == LABEL_FAKE).cast("bigint"), (F.col(label) == LABEL_REAL).cast("bigint")
        by_block = W.partitionBy(*group).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*group)
        self.blocks = small_table(
            with_row_block(rows, score, self.points, self.single).groupBy(*group, "_blk").agg(F.sum(self.p).alias("_bp"), F.sum(self.r).alias("_br"))
            .select(*group, "_blk", "_bp", "_br",
                    F.coalesce(F.sum("_bp").over(by_block), F.lit(0)).alias("_before_p"),
                    F.coalesce(F.sum("_br").over(by_block), F.lit(0)).alias("_before_r"),
                    F.sum("_bp").over(whole).alias("_n_p"), F.sum("_br").over(whole).alias("_n_r")))

    def __call__(self, rows: DataFrame, out: str, alone: bool = False, spread: Column | None = None, tasks: int = 1) -> DataFrame:
        """Rows with their placement. With ``alone`` all scores are frequent ones; with ``spread`` they are among the others, dealt by it to ``tasks``."""
        placed = with_row_block(rows, self.score, self.points, self.single)
        half_p, half_r = 0.5 * F.col("_bp"), 0.5 * F.col("_br")
        if not alone:
            keys = [*self.group, "_blk"]
            if spread is not None:
                keys = [*self.group, "_at"]
                dealt = F.col("_blk").cast("bigint") * 8192 + F.when(self.single, spread).otherwise(0)
                placed = placed.withColumn("_at", dealt).repartition(tasks, *keys)
            # The totals join after the window, so they are neither shuffled nor sorted.
            ordered = W.partitionBy(*keys).orderBy(self.score)
            upto, ties = (ordered.rangeBetween(low, W.currentRow) for low in (W.unboundedPreceding, W.currentRow))
            placed = placed.withColumns({
                "_cp": F.sum(self.p).over(upto) - 0.5 * F.sum(self.p).over(ties),
                "_cr": F.sum(self.r).over(upto) - 0.5 * F.sum(self.r).over(ties)})
            half_p, half_r = (F.when(self.single, half).otherwise(F.col(c)) for half, c in ((half_p, "_cp"), (half_r, "_cr")))
        below = ratio(F.col("_before_r") + half_r, F.col("_n_r"))
        above = ratio(F.col("_n_p") - F.col("_before_p") - half_p, F.col("_n_p"))
        return placed.join(self.blocks, [*self.group, "_blk"]).select(
            *rows.columns, F.when(F.col(self.label) == LABEL_FAKE, below).otherwise(above).alias(out))


def delong_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]], group: Sequence[str] = (),
    sample: str = "sample_id", technique: str = "technique", score: str = "score",
    label: str = "label", n_blocks: int | None = None,
) -> DataFrame:
    """Paired AUC comparison of technique pairs on the samples both have scored.

    The variance of the difference is the variance of per-sample placement
    differences, so no fake is ever compared with every real. All pairs run in one
    plan over the score matrix, which is written once. z and p are NULL when the
    variance is zero.
    """
    names = sorted({t for pair in pairs for t in pair})
    keys = [*group, "_pair"]
    wanted = df.filter(F.col(technique).isin(*names) & F.col(score).isNotNull()).select(*group, sample, label, technique, score)
    # With more reducers than this, a task sorts all it writes in memory, which grows with the files it reads; up to it, nothing is held.
    unsorted = max(1, int(df.sparkSession.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")))
    tasks_for = lambda n: min(unsorted, max(default_blocks(df.sparkSession), -(-n // TASK_ROWS)))
    # Dealt by number before they are grouped, so that no map of a task holds more samples than its share.
    matrix = materialize(
        wanted.repartition(tasks_for(wanted.count()), *group, sample).groupBy(*group, sample)
        .agg(F.max(label).alias("_y"),
             *[F.max(F.when(F.col(technique) == t, F.col(score))).alias(t) for t in names]),
        "matrix")
    both = F.array_compact(F.array(*[
        F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(
            F.lit(i).alias("_pair"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")))
        for i, (a, b) in enumerate(pairs)]))
    rows = (
        matrix.select(*group, F.xxhash64(sample).alias("_id"), "_y", F.explode(both).alias("_p"))
        .select(*group, "_id", "_y", "_p.*"))
    # A sample is a row of every pair. A block of all rows may lie in one pair, so a task's share is cut into several: blocks are dealt by hash.
    tasks = tasks_for(matrix.count() * len(pairs))
    n_blocks = n_blocks or min(8192, TASK_BLOCKS * tasks)
    spread = F.pmod("_id", F.lit(n_blocks))
    # One side after the other: the scores of a sample stay in one row, and nothing is grouped by sample again.
    sides = [(_placer(rows, keys, s, "_y", n_blocks), v) for s, v in (("_a", "va"), ("_b", "vb"))]
    placed = rows
    for place, v in sides:
        placed = place(placed, v, spread=spread, tasks=tasks)
    fake, real, d = F.col("_y") == LABEL_FAKE, F.col("_y") == LABEL_REAL, F.col("va") - F.col("vb")
    names_of = F.array(*[F.struct(F.lit(a).alias("technique_a"), F.lit(b).alias("technique_b")) for a, b in pairs])
    moments = placed.groupBy(*keys).agg(
        F.avg(F.when(fake, F.col("va"))).alias("auc_a"), F.avg(F.when(fake, F.col("vb"))).alias("auc_b"),
        F.count_if(fake).alias("m"), F.count_if(real).alias("k"),
        F.var_samp(F.when(fake, d)).alias("s10"), F.var_samp(F.when(real, d)).alias("s01"))
    moments = moments.withColumn("_t", F.get(names_of, F.col("_pair"))).select("*", "_t.*")
    variance = ratio(F.col("s10"), F.col("m")) + ratio(F.col("s01"), F.col("k"))
    return (
        moments.withColumn("difference", F.col("auc_a") - F.col("auc_b"))
        .withColumn("z", F.when(variance > 0, F.col("difference") / F.sqrt(variance)))
        .withColumn("p_value", two_sided_p(F.col("z")))
        .select(*group, "technique_a", "technique_b", "auc_a", "auc_b", "difference", "z", "p_value"))


# --- bootstrap --------------------------------------------------------------

def _interval(aucs: DataFrame, group: list[str], confidence: float) -> DataFrame:
    a = (1.0 - confidence) / 2.0
    return aucs.groupBy(*group).agg(
        F.percentile("auc", F.array(F.lit(a), F.lit(1.0 - a))).alias("q")
    ).select(*group, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def _aucs(sums: DataFrame, group: list[str]) -> DataFrame:
    """(group, replicate, p, r, auc) from the sums of each block of scores: (group, leaf, replicate, twice, p, r)."""
    before = W.partitionBy(*group, "replicate").orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return (
        sums.withColumn("before", F.coalesce(F.sum("r").over(before), F.lit(0)))
        .groupBy(*group, "replicate")
        .agg(F.sum("p").alias("p"), F.sum("r").alias("r"),
             ratio(F.sum(wide("twice") + 2 * wide("before") * wide("p")), 2 * F.sum("p").cast("double") * F.sum("r")).alias("auc"))
    )


def bootstrap_replicates(
    df: DataFrame, group: Sequence[str], score: str = "score", label: str = "label",
    n_resamples: int = 1000, seed: int = SEED, n_blocks: int | None = None,
) -> DataFrame:
    """(group, replicate, p, r, auc): the AUC of every class-stratified bootstrap replicate, and how many fakes and reals it drew.

    Each replicate draws as many rows of a class as it has, with replacement, by binomials down the trie of scores (see ``draws``). Scores are counted;
    blocks of the trie get their draws from one small table for each group, share them out where they lie and return
    one row per replicate, so nothing of size ``samples x replicates`` is ever shuffled. All sums are of integers.
    """
    group = list(group)
    rows = df.filter(F.col(score).isNotNull()).select(
        *group, F.col(score).cast("double").alias("s"),
        (F.col(label) == LABEL_FAKE).cast("bigint").alias("p"), (F.col(label) == LABEL_REAL).cast("bigint").alias("r"))
    # Drawing is work of the processor, not of bytes: tasks are fixed by number, so that adaptive execution doesn't join them.
    tasks = 2 * default_blocks(df.sparkSession)
    bounds = np.unique(order_bits(np.array(fixed_points(rows, "s", n_blocks or min(8192, tasks)))))

    @F.pandas_udf("long")
    def leaf(s: pd.Series) -> pd.Series:
        return pd.Series((leaf_of(order_bits(s.to_numpy()), bounds) ^ SIGN).view(np.int64))

    counts = rows.groupBy(*group, "s").agg(F.sum("p").alias("p"), F.sum("r").alias("r")).withColumn("leaf", leaf("s"))
    name = lambda frame: (seed, *(str(frame[g].iloc[0]) for g in group))
    sides = (("p", LABEL_FAKE), ("r", LABEL_REAL))
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in counts.schema if f.name in group)

    def share_out(leaves: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("leaf", ignore_index=True)
        keys = leaves["leaf"].to_numpy().view(np.uint64) ^ SIGN
        for side, label_value in sides:
            drawn = np.zeros((len(leaves), n_resamples), np.int64)
            n = leaves[side].to_numpy(np.int64)
            for i, k in allotted(keys, n, np.full(n_resamples, n.sum()), (*name(leaves), label_value)):
                drawn[i] = k
            leaves[f"drawn_{side}"] = [d.tobytes() for d in drawn]
        return leaves[[*group, "leaf", "drawn_p", "drawn_r"]]

    def resample(cells: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("s", kind="stable", ignore_index=True)
        keys, key = order_bits(cells["s"].to_numpy()), name(cells)
        ways = {side: allotted(keys, cells[side].to_numpy(np.int64), np.frombuffer(draws[f"drawn_{side}"].iloc[0], np.int64), (*key, label_value))
                for side, label_value in sides}
        ahead = {side: next(way, None) for side, way in ways.items()}
        twice, p, r = (np.zeros(n_resamples, np.int64) for _ in range(3))
        while at := [x[0] for x in ahead.values() if x is not None]:
            i, now = min(at), {}
            for side, way in ways.items():
                if ahead[side] is not None and ahead[side][0] == i:
                    now[side], ahead[side] = ahead[side][1], next(way, None)
            if "p" in now:
                twice += now["p"] * (2 * r + now.get("r", 0))       # a tie counts one half
                p += now["p"]
            r += now.get("r", 0)
        out = pd.DataFrame({"replicate": np.arange(n_resamples), "twice": twice, "p": p, "r": r})
        for g in (*group, "leaf"):
            out[g] = cells[g].iloc[0]
        return out[[*group, "leaf", "replicate", "twice", "p", "r"]]

    counts = materialize(counts, "score-counts")
    drawn = materialize(counts.groupBy(*group, "leaf").agg(F.sum("p").alias("p"), F.sum("r").alias("r")).groupBy(*group).applyInPandas(
        share_out, f"{head}leaf long, drawn_p binary, drawn_r binary"), "draws")
    dealt = lambda table: table.repartition(tasks, *group, "leaf").groupBy(*group, "leaf")
    sums = dealt(counts).cogroup(dealt(drawn)).applyInPandas(
        resample, f"{head}leaf long, replicate int, twice bigint, p bigint, r bigint")
    return _aucs(sums, group)


def bootstrap_interval(
    df: DataFrame, group: Sequence[str], score: str = "score", label: str = "label",
    n_resamples: int = 1000, confidence: float = 0.95, seed: int = SEED,
    n_blocks: int | None = None,
) -> DataFrame:
    """Class-stratified bootstrap interval of the AUC; the same for any partitioning, block count or order."""
    aucs = bootstrap_replicates(df, group, score, label, n_resamples, seed, n_blocks).filter("auc is not null")
    return _interval(aucs, list(group), confidence)


#: Ranks whose draws are counted together, and replicates at a time.
DEALT, ROUNDS = 1 << 16, 32


def bootstrap_interval_hashed(
    df: DataFrame, group: Sequence[str], sample: str = "sample_id", score: str = "score",
    label: str = "label", n_resamples: int = 1000, confidence: float = 0.95, seed: int = SEED,
    n_blocks: int | None = None,
) -> DataFrame:
    """The same interval with md5 draws, reproducible in any SQL engine.

    Draw k of replicate b takes row ``md5(seed|b|label|k) mod n`` of its class. Groups share the hashes of a label and the draws of
    classes of equal size, which are counted for ``DEALT`` ranks and ``ROUNDS`` replicates at a time: what is shuffled is one packed
    number for each draw, and the counts of each score. It still is of size ``samples x n_resamples``, so this suits audits and small
    replicate numbers; :func:`bootstrap_interval` is the one for large tables.
    """
    group = list(group)
    keys = [*group, label]
    rows = df.filter(F.col(score).isNotNull()).select(*keys, sample, F.col(score).cast("double").alias("s"))
    classes = small_table(rows.groupBy(*keys).agg(F.count("*").alias("n")).dropna(subset=keys))
    ranked = (
        seeded_rank(rows, keys, sample, seed).withColumn("idx", F.col("seeded_rank") - 1)
        .select(*keys, F.shiftright("idx", 16).alias("dealt"), F.col("idx").bitwiseAND(DEALT - 1).cast("int").alias("at"), "s"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = "".join(f"{k} {kinds[k]}, " for k in keys)
    wide = min(ROUNDS, n_resamples)
    rounds = F.explode(F.sequence(F.lit(0), F.lit((n_resamples - 1) // wide))).alias("round")
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.array_max("sizes") - 1, 16))).alias("chunk")

    def draw(frames):
        for frame in frames:
            for label_value, name, sizes, chunk, part in frame.itertuples(index=False):
                sizes, first = np.sort(np.asarray(sizes, np.int64)), chunk * DEALT
                replicates = range(part * wide, min((part + 1) * wide, n_resamples))
                hashes = [md5_numbers(f"{seed}|{b + 1}|{name}|".encode(), first, min(first + DEALT, int(sizes[-1]))) for b in replicates]
                for n in sizes[sizes > first]:
                    idx = np.concatenate([h[:n - first] % np.uint64(n) for h in hashes])
                    row = np.repeat(np.arange(len(hashes), dtype=np.uint32), min(DEALT, n - first))
                    dealt = (idx >> np.uint64(16)).astype(np.int64)
                    order = np.argsort(dealt, kind="stable")
                    taken = ((row << np.uint32(16)) | (idx & np.uint64(DEALT - 1)).astype(np.uint32))[order]
                    blocks, starts = np.unique(dealt[order], return_index=True)
                    yield pd.DataFrame({label: label_value, "n": n, "round": part, "dealt": blocks,
                                        "taken": [t.tobytes() for t in np.split(taken, starts[1:])]})

    def count(cells: pd.DataFrame) -> pd.DataFrame:
        drawn = np.zeros(wide * DEALT, np.int32)
        for taken in cells["taken"]:
            drawn += np.bincount(np.frombuffer(taken, np.uint32), minlength=len(drawn)).astype(np.int32)
        out = cells.iloc[:1].drop(columns="taken")
        out["drawn"] = [(drawn if drawn.max() > 255 else drawn.astype(np.uint8)).tobytes()]
        return out

    def weigh(cells: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or draws.empty:
            return pd.DataFrame(columns=[*keys, "round", "s", "w"])
        values, place = np.unique(cells["s"].to_numpy(), return_inverse=True)
        order = np.argsort(place, kind="stable")
        at, starts = cells["at"].to_numpy()[order], np.searchsorted(place[order], np.arange(len(values)))
        drawn = draws["drawn"].iloc[0]
        drawn = np.frombuffer(drawn, np.uint8 if len(drawn) == wide * DEALT else np.int32).reshape(wide, DEALT)
        w = np.ascontiguousarray(np.add.reduceat(drawn[:, at], starts, axis=1, dtype=np.int32).T)
        out = pd.DataFrame({"s": values, "w": [x.tobytes() for x in w]})
        for k in keys:
            out[k] = cells[k].iloc[0]
        out["round"] = draws["round"].iloc[0]
        return out[[*keys, "round", "s", "w"]]

    def compare(cells: pd.DataFrame) -> pd.DataFrame:
        values, place = np.unique(cells["s"].to_numpy(), return_inverse=True)
        w = np.frombuffer(b"".join(cells["w"]), np.int32).reshape(-1, wide)
        p, r = (np.zeros((len(values), wide), np.int64) for _ in "pr")
        for side, label_value in ((p, LABEL_FAKE), (r, LABEL_REAL)):
            of = (cells[label] == label_value).to_numpy()
            np.add.at(side, place[of], w[of])
        part, below = int(cells["round"].iloc[0]), np.cumsum(r, axis=0) - r
        out = pd.DataFrame({"replicate": np.arange(part * wide, (part + 1) * wide), "twice": (p * (2 * below + r)).sum(axis=0),
                            "p": p.sum(axis=0), "r": r.sum(axis=0)})
        for g in (*group, "leaf"):
            out[g] = cells[g].iloc[0]
        return out[out["replicate"] < n_resamples][[*group, "leaf", "replicate", "twice", "p", "r"]]

    spark = df.sparkSession
    tasks = default_blocks(spark)
    drawn = (
        classes.groupBy(label, F.col(label).cast("string").alias("name")).agg(F.sort_array(F.collect_set("n")).alias("sizes"))
        .select("*", chunks).select("*", rounds).repartition(4 * tasks, "chunk", "round")
        .mapInPandas(draw, f"{label} {kinds[label]}, n bigint, round int, dealt bigint, taken binary")
        .groupBy(label, "n", "round", "dealt").applyInPandas(count, f"{label} {kinds[label]}, n bigint, round int, dealt bigint, drawn binary"))
    drawn = drawn.join(F.broadcast(classes), [label, "n"]).select(*keys, "round", "dealt", "drawn")
    cells = ranked.select("*", rounds)
    at = [*keys, "round", "dealt"]
    weighted = materialize(cells.groupBy(*at).cogroup(drawn.groupBy(*at)).applyInPandas(weigh, f"{head}round int, s double, w binary"), "weighted")
    # A block holds at most about 2^18 counted scores, however large the table and few the blocks.
    n_blocks = max(n_blocks or tasks, min(8192, weighted.count() >> 18))
    sums = (
        weighted.withColumn("leaf", fixed_block(weighted, "s", n_blocks).cast("bigint")).groupBy(*group, "leaf", "round")
        .applyInPandas(compare, f"{head.replace(f'{label} {kinds[label]}, ', '')}leaf bigint, replicate int, twice bigint, p bigint, r bigint"))
    return _interval(_aucs(sums, group), group, confidence)
