"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w x - threshold_k): one set of weights for all grades, thresholds in ascending order. The expected
severity is the sum of these probabilities. Features are lower-cased words, and word beginnings of 4 to 6 letters
valued by their distinct words. The vocabulary holds the ``n_features`` that are most surely in a larger share of toxic than of
clean labelled documents; how sure is no condition, since that depends on the size of the table: the penalty keeps weak ones small.

The model is fitted on at most ``most_labelled`` labelled documents, half of them from each class where there are so
many, chosen by hash of doc_id. The decision threshold is set where each fifth is judged by a model of the other four, so
every label counts for weights and threshold, however few there are. Everything else, scoring above all, reads whole texts of all documents. Vocabulary and weights are bounded by ``n_features`` and travel with the task.

Defined results: null, empty and wordless texts are scored from the thresholds alone; repeated rows are scored each for
itself; labelled ids without a document, null labels and repeated labels (the highest grade counts) do no harm; without
toxic or without clean labels nothing is called toxic; an empty table gives no rows. Other columns are passed on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import fresh, seeded, stored

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
FOLDS = 5


def features(text: str) -> Counter:
    """Each distinct word once, and how many distinct longer words have each beginning (marked ^).

    Repeating a word doesn't add to it: junk repeats words a thousand times.
    """
    words = set(WORD.findall(text.lower()))
    out = Counter(words)
    for w in words:
        for k in PREFIXES:
            if len(w) > k:
                out["^" + w[:k]] += 1
    return out


@dataclass
class Model:
    weights: dict[str, float]       # by feature
    thresholds: np.ndarray          # ascending, one fewer than grades
    cut: float                      # of the probability of a grade above 0

    def score(self, text: str) -> tuple[float, float, int, int]:
        """Expected severity, probability of any toxicity, most likely grade, verdict."""
        w, used = self.weights, []
        for word in set(WORD.findall(text.lower())):
            if word in w:
                used.append(w[word])
            used += [w[p] for k in PREFIXES if len(word) > k and (p := "^" + word[:k]) in w]
        z = math.fsum(used)     # exact, so the order of the words doesn't matter
        above = _sigmoid(z - self.thresholds)
        grade = int(np.argmax(-np.diff(np.concatenate([[1.0], above, [0.0]]))))
        return float(above.sum()), float(above[0]), grade, int(above[0] >= self.cut)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
                n_grades: int, penalty: float = 0.1, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood; sparse entries (row, column, value).

    Quasi-Newton steps with a memory of ten and a halving line search. Thresholds stay ordered, being a first one
    and the logarithms of the gaps.
    """
    n, m = len(grades), n_grades - 1
    at = np.arange(n)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = x[:n_features], x[n_features:]
        gaps = np.exp(np.clip(t[1:], -30, 30))
        theta = np.cumsum(np.concatenate([t[:1], gaps]))
        above = _sigmoid(np.bincount(rows, w[cols] * values, minlength=n)[:, None] - theta[None, :])
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = edges * (1 - edges)
        p = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        upper, lower = slope[at, grades] / p, slope[at, grades + 1] / p
        dtheta = (np.bincount(grades + 1, lower, minlength=m + 2) - np.bincount(grades, upper, minlength=m + 2))[1:-1]
        tail = np.cumsum(dtheta[::-1])[::-1]
        dw = np.bincount(cols, (upper - lower)[rows] * values, minlength=n_features) - penalty * w
        # A weak pull keeps gaps finite where a grade doesn't occur.
        value = -np.log(p).sum() + penalty / 2 * (w @ w) + 0.5e-3 * (t @ t)
        return value, -np.concatenate([dw, tail[:1] - 1e-3 * t[:1], tail[1:] * gaps - 1e-3 * t[1:]])

    x = np.zeros(n_features + m)
    value, slope = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, used = -slope, []
        for s, y in reversed(pairs):
            a = (s @ step) / (s @ y)
            step = step - a * y
            used.append(a)
        if pairs:
            step = step * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y), a in zip(pairs, reversed(used)):
            step = step + (a - (y @ step) / (s @ y)) * s
        size = 1.0 if pairs else 1.0 / max(1.0, np.abs(slope).max())
        while size > 1e-10:
            new_value, new_slope = loss(x + size * step)
            if new_value <= value + 1e-4 * size * (slope @ step):
                break
            size /= 2
        else:
            break
        s, y = size * step, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y)]
        done = value - new_value < 1e-7 * (1 + abs(value))
        x, value, slope = x + s, new_value, new_slope
        if done:
            break
    return x[:n_features], np.cumsum(np.concatenate([x[n_features:n_features + 1], np.exp(x[n_features + 1:])]))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int, seed: int) -> DataFrame:
    """(doc_id, grade, text) of at most ``most_labelled`` documents, one of each family of copies."""
    known = labels.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    half = most_labelled // 2
    key = seeded(seed, F.col("doc_id"))
    picked = [known.filter(side).orderBy(key, "doc_id").limit(half) for side in ("grade > 0", "grade = 0")]
    # At most most_labelled rows of two numbers.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.mapInArrow(_with_families, "doc_id bigint, text string, grade int, family bigint, kin bigint")
    for name in ("family", "kin"):
        rows = rows.groupBy(name).agg(F.max(F.struct("grade", "doc_id", "text", "kin")).alias("r")).select("r.*")
    return rows.select("doc_id", "grade", "text")


def _with_families(batches):
    """Two least hashes of each text's word triples: near copies mostly share one, and would count as many proofs."""
    from xxhash import xxh3_64_intdigest as digest

    for batch in batches:
        least: list[list[int]] = [[], []]
        for text in batch.column("text").to_pylist():
            words = WORD.findall(text.lower())
            triples = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
            for seed, out in enumerate(least):
                out.append(min(digest(t, seed) for t in triples))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "text", "grade")] + [pa.array(np.array(x, np.uint64).view(np.int64)) for x in least],
            ["doc_id", "text", "grade", "family", "kin"])


def _vocabulary(sample: DataFrame, n_features: int, least_documents: int) -> list[str]:
    """The features most surely in a larger share of toxic documents than of clean ones."""

    def spread(batches):
        for batch in batches:
            for grade, text in zip(batch.column("grade").to_pylist(), batch.column("text").to_pylist()):
                names = list(features(text))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([int(grade > 0)] * len(names), pa.int32())], ["feature", "toxic"])

    n = sample.agg(F.count(F.when(F.col("grade") > 0, 1)).alias("toxic"), F.count(F.when(F.col("grade") == 0, 1)).alias("clean")).first()
    if not n.toxic or not n.clean:
        return []
    counted = (sample.mapInArrow(spread, "feature string, toxic int").groupBy("feature")
               .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") + F.col("b") >= least_documents))
    odds = lambda c, total: F.log((F.col(c) + 0.5) / (F.lit(total) - F.col(c) + 0.5))
    spread_of = lambda c, total: 1 / (F.col(c) + 0.5) + 1 / (F.lit(total) - F.col(c) + 0.5)
    z = (odds("a", n.toxic) - odds("b", n.clean)) / F.sqrt(spread_of("a", n.toxic) + spread_of("b", n.clean))
    rows = (counted.select("feature", z.alias("z")).filter("z > 0")
            .orderBy(F.desc("z"), "feature").limit(n_features).collect())
    return [r.feature for r in rows]


def fit(docs: DataFrame, labels: DataFrame, n_grades: int = 4, most_labelled: int = 12_000, n_features: int = 4096,
        least_documents: int = 4, seed: int = 0) -> Model:
    """``labels``: doc_id and grade. If no grade exceeds 1, toxic documents are graded 1, 2, ... in equal shares by
    how strongly they use words of the vocabulary, by the weights of a fit to two grades.

    At most most_labelled x (words in the vocabulary) counts come to the driver, never texts.
    """
    sample = stored(labelled_sample(docs, labels, most_labelled, seed), "labelled")
    names = _vocabulary(sample, n_features, least_documents)
    if not names:
        return Model({}, np.full(n_grades - 1, np.inf), 1.0)
    place = {f: k for k, f in enumerate(names)}

    def entries(batches):
        for batch in batches:
            out = []
            for doc_id, grade, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "grade", "text"))):
                c = features(text)
                kept = {place[f]: n for f, n in c.items() if f in place}
                out.append((doc_id, grade, list(kept), list(kept.values())))
            if out:
                types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["doc_id", "grade", "at", "times"])

    rows = sample.mapInArrow(entries, "doc_id bigint, grade int, at array<int>, times array<int>").toArrow().sort_by("doc_id")
    grades = rows.column("grade").to_numpy().astype(int)
    i = np.repeat(np.arange(len(grades)), pc.list_value_length(rows.column("at")).to_numpy())
    j, v = pc.list_flatten(rows.column("at")).to_numpy(), pc.list_flatten(rows.column("times")).to_numpy().astype(float)
    toxic = grades > 0
    if grades.max() == 1 and n_grades > 2:
        w, _ = fit_ordinal(i, j, v, grades, len(names), 2)
        hits = np.bincount(i, w[j] * v, minlength=len(grades))
        cuts = np.quantile(hits[toxic], np.arange(1, n_grades - 1) / (n_grades - 1))
        grades = np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    n_grades = max(n_grades, int(grades.max()) + 1)
    fold = np.array([(d * 2654435761 + seed) % 1000 * FOLDS // 1000 for d in rows.column("doc_id").to_pylist()])
    p = np.zeros(len(grades))
    for k in range(FOLDS):
        held = fold == k
        among, place_of = ~held[i], np.cumsum(~held) - 1
        w, theta = fit_ordinal(place_of[i[among]], j[among], v[among], grades[~held], len(names), n_grades)
        p[held] = _sigmoid(np.bincount(i, w[j] * v, minlength=len(grades)) - theta[0])[held]
    w, theta = fit_ordinal(i, j, v, grades, len(names), n_grades)
    return Model({f: float(x) for f, x in zip(names, w)}, theta, _cut(p, toxic))


def _cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that parts documents a model hasn't seen with the best F1: midway between the two neighbours.

    Only where most of the documents above are toxic, else F1 of few labels may be best with all documents rejected; 0.5 if
    that is nowhere.
    """
    order = np.argsort(-p, kind="stable")
    n, hits = np.arange(1, len(p) + 1), np.cumsum(toxic[order])
    f1 = np.where(2 * hits > n, 2 * hits / (n + toxic.sum()), 0.0)
    if not f1.any():
        return 0.5
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


SCORES = ("expected_severity", "p_toxic", "grade", "toxic")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, by default all) with expected_severity, p_toxic, grade and toxic; no shuffle.

    Columns of these names in ``docs`` are replaced.
    """
    kept = [c for c in (keep or docs.columns) if c not in SCORES]
    schema = StructType([f for c in kept for f in docs.schema if f.name == c])
    for name, kind in zip(SCORES, (DoubleType(), DoubleType(), IntegerType(), IntegerType())):
        schema = schema.add(name, kind)
    extra = [] if "text" in kept else ["text"]

    def each(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            scores = [model.score(t.as_py()) for t in texts]
            columns = list(zip(*scores)) if scores else [[]] * 4
            types = (pa.float64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(c, t) for c, t in zip(columns, types)],
                                             [*kept, *SCORES])

    return docs.select(*kept, *extra).mapInArrow(each, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, as they are, that aren't toxic."""
    names = {c: fresh(c) for c in docs.columns}
    scored = score(docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text").alias("text")), model, tuple(names.values()))
    return scored.filter("toxic = 0").select(*[F.col(n).alias(c) for c, n in names.items()])
