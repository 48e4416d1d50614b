"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found in an index of variable-length grams.

The gram dictionary holds every gram of ``SHORT`` symbols and the extensions, by one symbol, of every frequent gram; the frequent ones are those in
more than ``FREQUENT`` places, or in more if over ``DICTIONARY`` would be. A word is decomposed by taking at every position the longest gram of the dictionary that starts there: grams are
short where they are rare and long where they are common. One edit only changes grams that touch it (or, at the end of the word, grams that
would have gone on), so the largest number over all places bounds a word's affected grams. A word stands in the lists of one gram more than that bound,
the rarest ones: two near words then have a list in common, for the rarest gram that both keep is among these in both. A kept gram
has everything before it, or everything after it, unchanged too, so a list is kept apart by what stands before its gram, and again by what
stands after it. The words of a merged list are verified pair by pair. Nothing is lost, whatever the dictionary.

Words of lengths L - 1 and L are compared in a class of their own with a longest gram fitted to L, so that a gram always remains unaffected. Lists of more than
``TILE`` words are cut into tiles and every pair of tiles is a group of its own; only verified pairs leave a task.

Defined results: null and empty texts have no words; repeated rows count each for itself; a null doc_id stands as an empty string in what is hashed; very long runs are words like
others; ties go to the smaller word in code-point order; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, stored

SHORT, LONG = 2, 7                      # symbols of a gram; eight bits each
FREQUENT, DICTIONARY = 64, 1 << 18
TILE = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
CELLS = 1 << 21                         # symbols compared at a time


def count_words(docs: DataFrame, least: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): lower-cased runs of letters, of which every ``one_in``-th by hash has lost a letter; combined before the shuffle."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.filter(F.length("run") >= least).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


class Words:
    """A batch of words as one run of symbols."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.rest = np.repeat(self.start + self.length, self.length) - np.arange(len(self.points))

    def grams(self) -> dict[int, np.ndarray]:
        """By size: the gram starting at every symbol as a number, zero where the word ends sooner."""
        symbols = (1 + (self.points.astype(np.int64) - 1) % 255)
        out, code = {}, np.zeros(len(symbols), np.int64)
        for q in range(1, LONG + 1):
            code <<= 8
            code[:max(0, len(symbols) - q + 1)] |= symbols[q - 1:]
            out[q] = np.where(self.rest >= q, code, 0)
        return out


def frequent_grams(words: DataFrame, frequent: int = FREQUENT, at_most: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """The grams that are extended, and their counts: at most ``at_most`` of them."""

    def count(batches):
        for batch in batches:
            grams = Words(batch.column("word").to_pylist()).grams()
            every = np.concatenate([grams[q] for q in range(SHORT, LONG + 1)])
            gram, n = np.unique(every[every > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    counted = stored(words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
                     .filter(F.col("n") > frequent), "grams")
    top = counted.orderBy(F.desc("n"), "gram").limit(at_most + 1).toPandas()
    if len(top) > at_most:
        top = top[top["n"] > top["n"].iloc[-1]]         # equal counts stay or go together
    top = top.sort_values("gram")
    return top["gram"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def longest_gram(size: int, least: int) -> int:
    """For words of ``size - 1`` and ``size`` symbols: one gram more than an edit can affect must fit into the shorter."""
    return min(LONG, max(4, size // 2), max(size - 1, least) - SHORT)


def index_rows(words: Words, dictionary: tuple[np.ndarray, np.ndarray], least: int):
    """(key, class, word) for each list that a word stands in."""
    known, counts = dictionary

    def places(codes):
        if not len(known):
            return np.zeros(len(codes), np.int64)
        i = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[i] == codes, counts[i], 0)

    grams, out = words.grams(), []
    # Hashes of what stands before the end of each symbol, and from each symbol on, within its word.
    table = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power = np.cumprod(np.full(int(words.length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    value = table[words.points % 256] ^ words.points.astype(np.uint64)
    within = np.arange(len(words.points)) - words.start[words.word]
    before = np.cumsum(value * power[within])
    before -= np.concatenate([np.zeros(1, np.uint64), before])[words.start[words.word]]
    after = value * power[words.rest - 1]
    after = np.cumsum(after[::-1])[::-1]
    after = after - np.append(after, np.uint64(0))[(words.start + words.length)[words.word]]

    for size in np.unique(np.concatenate([words.length, words.length + 1])).tolist():
        member = (words.length == size) | (words.length == size - 1)
        at = np.flatnonzero(member[words.word] & (words.rest >= SHORT))
        long = longest_gram(size, least)
        q, gram = np.full(len(at), SHORT), grams[SHORT][at]
        n = places(gram)
        for k in range(SHORT + 1, long + 1):
            longer = (q == k - 1) & (n > 0) & (words.rest[at] >= k)
            q[longer], gram[longer] = k, grams[k][at[longer]]
            n[longer] = places(gram[longer])
        # Grams that an edit at a symbol touches; at the end of a word also those that stopped for want of another symbol.
        step = np.zeros(len(words.points) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + q, -1)
        affected = np.maximum.reduceat(np.cumsum(step)[:-1], words.start)
        would_go_on = (n > 0) & (q < long) & (words.rest[at] == q)
        affected = np.maximum(affected, np.bincount(words.word[at], would_go_on, len(words.length)).astype(np.int64))
        order = np.lexsort((at, gram, n, words.word[at]))
        at, q = at[order], q[order]
        mine = words.word[at]
        rank = np.arange(len(at)) - np.searchsorted(mine, mine)
        kept = rank <= affected[mine]
        at, q, mine = at[kept], q[kept], mine[kept]
        salt = np.uint64(size) * np.uint64(0xC2B2AE3D27D4EB4F) + q.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        for side, context in enumerate((before[at + q - 1], after[at])):
            key = (context ^ (salt + np.uint64(side))) * np.uint64(0xFF51AFD7ED558CCD)
            out.append(((key ^ (key >> np.uint64(32))).view(np.int64), np.full(len(at), size, np.int32), mine))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]


def one_edit(points: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b of a class (row length: its longer words) differ by one edit."""
    size = points.shape[1]
    out = np.zeros(len(a), bool)
    level = (length[a] == size) & (length[b] == size)
    at = np.flatnonzero(level)
    out[at] = (points[a[at]] != points[b[at]]).sum(axis=1) == 1
    at = np.flatnonzero(~level & (length[a] != length[b]))
    swap = length[a[at]] == size
    short, long = points[np.where(swap, b[at], a[at]), :size - 1], points[np.where(swap, a[at], b[at])]
    first, last = short != long[:, :-1], (short != long[:, 1:])[:, ::-1]
    same = lambda unequal: np.where(unequal.any(axis=1), unequal.argmax(axis=1), size - 1)
    out[at] = same(first) + same(last) >= size - 1
    return out


def near_in_lists(keys: np.ndarray, tile: np.ndarray, words: list[str], n: np.ndarray):
    """(word, near, n of near) of verified pairs, both ways; ``keys`` are rows (class, key, a, b), equal ones together."""
    pairs = set()
    length = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(keys[0]).tolist():
        rows = np.flatnonzero(keys[0] == size)
        points = np.zeros((len(rows), size), np.uint32)
        flat = np.frombuffer("".join(words[r] for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        points[np.arange(size)[None, :] < length[rows, None]] = flat
        same = (keys[:, rows[1:]] == keys[:, rows[:-1]]).all(axis=0)
        end = np.append(np.flatnonzero(~same), len(rows) - 1)           # last row of each group
        last = end[np.searchsorted(end, np.arange(len(rows)))]
        crossing = keys[2, rows] != keys[3, rows]
        x = np.arange(len(rows))
        gap = 1
        while len(x := x[x + gap <= last[x]]):
            for part in np.array_split(x, max(1, len(x) * size // CELLS)):
                y = part + gap
                ok = ~crossing[part] | (tile[rows[part]] != tile[rows[y]])
                found = one_edit(points, length[rows], part[ok], y[ok])
                pairs.update(zip(rows[part[ok][found]].tolist(), rows[y[ok][found]].tolist()))
            gap += 1
    found = {(words[i], words[j]): int(n[j]) for x, y in pairs for i, j in ((x, y), (y, x))}
    return found


def near_pairs(words: DataFrame, least: int = 6, frequent: int = FREQUENT, tile: int = TILE) -> DataFrame:
    """(word, near, n) for every two near words of ``words`` (word, n), both ways; words of at least ``least`` code points, 4 or more."""
    if least < 4:
        raise ValueError("words of fewer than 4 code points have no gram that an edit can't affect")
    dictionary = frequent_grams(words, frequent)

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, size, at = index_rows(Words(batch.column("word").to_pylist()), dictionary, least)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(size), pa.array(key), batch.column("word").take(at), batch.column("n").take(at)], ["size", "key", "word", "n"])

    lists = stored(words.select("word", "n").repartition(partitions(words.sparkSession)).mapInArrow(index, "size int, key long, word string, n long"), "lists")
    # Few: each has more than ``tile`` rows. Spark broadcasts the stored table only if it is small.
    hot = stored(lists.groupBy("size", "key").agg(F.count("*").alias("words")).filter(F.col("words") > tile), "hot")
    tiles = F.coalesce(F.ceil(F.col("words") / tile), F.lit(1)).cast("int")
    dealt = (lists.join(hot, ["size", "key"], "left").withColumn("tiles", tiles)
             .withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("size", "key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "word", "n"))
    group = ["size", "key", "a", "b"]

    def verify(batches):
        def pairs(rows: pa.Table):
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in group])
            found = near_in_lists(keys, rows.column("tile").to_numpy(), rows.column("word").to_pylist(), rows.column("n").to_numpy())
            if found:
                x, y = zip(*found)
                return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(list(found.values()), pa.int64())], ["word", "near", "n"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows.column(c).to_numpy() for c in group])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            done = other[-1] + 1 if len(other) else 0                   # the last list may go on in the next batch
            if done and (out := pairs(rows.slice(0, done))) is not None:
                yield out
            held = rows.slice(done).to_batches()
        if held and (out := pairs(pa.Table.from_batches(held))) is not None:
            yield out

    return (dealt.repartition(partitions(words.sparkSession), *group).sortWithinPartitions(*group)
            .mapInArrow(verify, "word string, near string, n long").distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in steps that double."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = stored(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        if ways.filter("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(words: DataFrame, least: int = 6, ratio: int = 5, frequent: int = FREQUENT, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a word's form is its most frequent near word, if that is ``ratio`` times as frequent."""
    words = stored(words, "words")
    pairs = near_pairs(words, least, frequent, tile)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("top"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("top.less") >= ratio * F.col("n"), F.struct(F.col("top.near").alias("form"), (-F.col("top.less")).alias("n"))).alias("top"))
    judged = stored(judged.select("word", "n", "n_near", F.col("top.form").alias("form"), F.col("top.n").alias("form_n")), "judged")
    return (judged.join(roots(judged.filter("form is not null")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, least: int = 6, least_n: int = 5) -> DataFrame:
    return variants(count_words(docs, least, least_n), least)


def variants_sql() -> str:
    """The same in DuckDB: CRC by bytes, near words by what is left when a code point is taken out."""
    return f"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
bytes AS (SELECT run, hex(encode(id || ':' || run)) AS x FROM run WHERE length(run) >= 6),
hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda k: ('0x' || x[2 * k + 1:2 * k + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
word AS MATERIALIZED (SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING count(*) >= 5),
out AS MATERIALIZED (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM word, range(length(word)) r(i)),
pair AS (SELECT a.word, b.word AS near FROM out a JOIN out b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word FROM out a JOIN word b ON a.rest = b.word UNION SELECT b.word, a.word FROM out a JOIN word b ON a.rest = b.word),
best AS (SELECT p.word, count(*) AS n_near, min({{less: -w.n, near: p.near}}) AS top FROM pair p JOIN word w ON p.near = w.word GROUP BY 1),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 5 * w.n THEN top.near END AS form,
    CASE WHEN -top.less >= 5 * w.n THEN -top.less END AS form_n FROM word w LEFT JOIN best b ON w.word = b.word),
way AS (SELECT word, form AS root, 1 AS step FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT y.word, j.form, y.step + 1 FROM way y JOIN judged j ON y.root = j.word WHERE j.form IS NOT NULL)
SELECT j.word, j.form, coalesce(r.root, j.word) AS root, j.n, j.n_near, j.form_n::BIGINT AS form_n
FROM judged j LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY 1) r ON j.word = r.word"""
