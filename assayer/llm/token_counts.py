"""Token counts of sections: whole documents are encoded once and their tokens attributed by character spans.

A token lies in the section that holds all its characters. One that crosses a boundary is allotted by rule:
``majority`` (most of its characters, ties to the earlier section), ``start`` (its first character), ``end`` (its last
character) or ``split`` (to each section the share of its characters there). A token without width counts as
the character at its place. Characters in no section are section -1, which appears only where tokens are left over.

Defined results: null and empty texts have one empty section 0 (without sections of their own) and no tokens;
repeated rows are counted each for itself; an empty table gives no rows. Columns besides doc_id, text and sections
are not read, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .encode import encoder

RULES = ("majority", "start", "end", "split")
COUNTED = "doc_id bigint, section int, begin bigint, end bigint, n_tokens double, n_crossing bigint"


def lines(text: str) -> np.ndarray:
    """Begin and end of each line, its line break included; code points."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    cuts = np.unique(np.concatenate([[0], breaks, [len(text)]]))
    return np.stack([cuts[:-1], cuts[1:]], 1) if len(cuts) > 1 else np.zeros((1, 2), np.int64)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str, n_chars: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, crossing tokens that reach into it, and tokens outside all sections.

    ``spans``: starts and ends of tokens; ``sections``: begins and ends, sorted and disjoint. Both sides are
    sorted, so the join is two binary searches a token; crossing tokens are looked at in the sections that they reach.
    """
    n = len(sections)
    begins, ends = sections[:, 0], sections[:, 1]
    start = np.minimum(spans[0], max(n_chars - 1, 0)).astype(np.int64)
    last = np.maximum(spans[1] - 1, start)
    full = np.flatnonzero(ends > begins)            # an empty section holds no character

    def of(place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begins[full], place, side="right") - 1
        k = np.where(k >= 0, full[np.maximum(k, 0)], -1) if len(full) else np.full(len(place), -1)
        return np.where((k >= 0) & (place < ends[k]), k, -1) if n else k

    first_of, last_of = of(start), of(last)
    inside = (first_of == last_of) & (first_of >= 0)
    counts, crossing, outside = np.bincount(first_of[inside], minlength=n).astype(float), np.zeros(n, np.int64), 0.0
    s, e = start[~inside], last[~inside] + 1
    near, beyond = np.searchsorted(ends, s, side="right"), np.searchsorted(begins, e, side="left")
    for s, e, k, j, low, high in zip(s, e, first_of[~inside], last_of[~inside], near, np.maximum(near, beyond)):
        overlap = np.clip(np.minimum(ends[low:high], e) - np.maximum(begins[low:high], s), 0, None)
        crossing[low:high] += overlap > 0
        if rule == "split":
            counts[low:high] += overlap / (e - s)
            outside += 1 - overlap.sum() / (e - s)
            continue
        if rule == "majority":      # ties go to the earlier section, and to a section before no section
            k = low + int(overlap.argmax()) if len(overlap) else -1
            if k >= 0 and (not overlap[k - low] or overlap[k - low] < (e - s) - overlap.sum()):
                k = -1
        elif rule == "end":
            k = j
        if k >= 0:
            counts[k] += 1
        else:
            outside += 1
    return counts, crossing, outside


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """One row for each section of each document.

    ``sections`` names a column array<struct<begin, end>> of sorted disjoint code point ranges; without it sections
    are the lines of the text. No shuffle: sections travel with their document.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")]
    if sections:
        columns.append(F.expr(f"transform({sections}, s -> array(s.begin, s.end))").cast("array<array<bigint>>").alias("sections"))

    def count(batches):
        codec = encoder(tokenizer, spans=True)
        for batch in batches:
            for part, tokens in codec.pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                given = part.column("sections").to_pylist() if sections else [None] * len(texts)
                out: list[tuple] = []
                for doc_id, text, own, t in zip(part.column("doc_id").to_pylist(), texts, given, tokens):
                    where = lines(text) if not sections else np.array(own or [], np.int64).reshape(-1, 2)
                    counts, crossing, outside = attribute(t[1:], where, rule, len(text))
                    out += zip([doc_id] * len(where), range(len(where)), where[:, 0].tolist(), where[:, 1].tolist(),
                               counts.tolist(), crossing.tolist())
                    if outside:
                        out.append((doc_id, -1, None, None, outside, None))
                if out:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)],
                                                     [x.split()[0] for x in COUNTED.split(", ")])

    return docs.select(*columns).mapInArrow(count, COUNTED)
