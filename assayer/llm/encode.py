"""Token ids of whole texts, encoded by the tokenizers library one distinct word at a time.

A pre-tokenizer that never joins characters across a single space between two non-blank characters
gives a text the same tokens as its words one after the other, each with the space in front of it.
Both byte-level and lower-casing word-end files behave so. The words of a batch are made distinct
by Arrow, only words not met lately are encoded, and the ids are put together by index arithmetic.
Texts with irregular blanks or with the string of a special token are encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of Unicode and the four separators that some libraries count as such.
BLANK = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
IRREGULAR = f"^ | $| {BLANK}|{BLANK} |\\x00"
#: Further places where no token goes across: before a comma or full stop that follows a letter (one that
#: lower-cases to one letter), and after a lone line break before a letter. They make many more words equal.
CUTS = ((r"([\p{Ll}A-Z])([,.])", "\\1\0\\2"), (r"([\p{Ll}A-Z,.])\n(\pL)", "\\1\n\0\\2"))

_encoders: dict[tuple, "Encoder"] = {}


class Encoder:
    """Encodes batches of texts; ``spans`` keeps the character span of every token.

    Words are remembered in two generations of ``capacity`` entries (about 200 bytes each), so memory is bounded
    and frequent words stay.
    """

    def __init__(self, path: str, spans: bool = False, capacity: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spans, self.capacity = spans, capacity
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _records(self, texts: list[str]) -> list[bytes]:
        """Per text its ids, and with spans its starts and ends after them, as 32-bit integers."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            out.append(ids.tobytes() + self._pairs(e).T.tobytes() if self.spans else ids.tobytes())
        return out

    @staticmethod
    def _pairs(encoding) -> np.ndarray:
        return np.fromiter(chain.from_iterable(encoding.offsets), np.int32).reshape(-1, 2)

    def _joined(self, words: list[str], together: int = 1000) -> list[bytes]:
        """``_records`` of words that begin with a space: encoded joined, told apart by their offsets."""
        groups = [words[i:i + together] for i in range(0, len(words), together)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False)):
            sizes = np.fromiter(map(len, group), np.int64, len(group))
            begins = np.cumsum(sizes) - sizes
            pairs = self._pairs(e)
            word = np.searchsorted(begins, pairs[:, 0], side="right") - 1
            cuts = np.searchsorted(word, np.arange(len(group) + 1)) * 4
            data = [np.array(e.ids, np.uint32).tobytes()]
            if self.spans:
                data += [(pairs[:, k] - begins[word]).astype(np.int32).tobytes() for k in (0, 1)]
            cuts = cuts.tolist()
            parts = [[d[a:b] for a, b in zip(cuts, cuts[1:])] for d in data]
            out += parts[0] if len(parts) == 1 else map(b"".join, zip(*parts))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.recent) > self.capacity:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        found, missing = list(map(recent.get, words)), []
        for i, r in enumerate(found):
            if r is None:
                r = older.get(words[i])
                if r is None:
                    missing.append(i)
                else:
                    recent[words[i]] = found[i] = r
        spaced = [i for i in missing if words[i][:1] == " "]
        other = [i for i in missing if words[i][:1] != " "]
        for places, records in ((spaced, self._joined), (other, self._records)):
            for i, r in zip(places, records([words[i] for i in places])):
                recent[words[i]] = found[i] = r
        return found

    def _regular(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring(texts, " ", "\0 ")
        for pattern, cut in CUTS:
            marked = pc.replace_substring_regex(marked, pattern, cut)
        parts = pc.split_pattern(marked, "\0")
        words, offsets = parts.flatten(), parts.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        records = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())      # quicker than to_pylist
        width = 3 if self.spans else 1
        sizes = np.fromiter(map(len, records), np.int64, len(records)) // (4 * width)
        flat = np.frombuffer(b"".join(records), np.int32)
        begins = np.cumsum(sizes * width) - sizes * width
        n = sizes[codes]
        ends = np.cumsum(n)
        at = np.repeat(begins[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate([[0], ends])[offsets]
        if not self.spans:
            rows = flat[at].view(np.uint32)
            return [rows[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(chars) - chars                        # of the word, over the whole batch
        begin -= np.repeat(begin[offsets[:-1]], np.diff(offsets))
        size, begin = np.repeat(n, n), np.repeat(begin, n)
        rows = np.stack([flat[at], flat[at + size] + begin, flat[at + 2 * size] + begin])
        return [rows[:, a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: empty); with spans an array of rows ids, starts, ends (code points)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, IRREGULAR)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = odd.to_numpy(zero_copy_only=False)
        where = np.flatnonzero(~odd)
        for i, ids in zip(where, self._regular(texts.take(pa.array(where))) if len(where) else []):
            out[i] = ids
        for i in np.flatnonzero(odd):
            record = np.frombuffer(self._records([texts[i].as_py()])[0], np.int32)
            out[i] = record.reshape(3, -1) if self.spans else record.view(np.uint32)
        return out

    def pieces(self, batch: pa.RecordBatch, text: str, most_bytes: int = 3_000_000):
        """(slice of the batch, encoded texts) with a bounded amount of text at a time."""
        column = batch.column(text).cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), self.encode(column.slice(a, b - a))


def encoder(path: str, spans: bool = False, capacity: int = 400_000) -> Encoder:
    """One encoder for each file and worker."""
    key = (path, spans, capacity)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
