"""Draws with replacement of a fixed size from counted scores, split down a tree of binomials.

n draws from rows that are counted by score are one multinomial draw. It is made by halving: of the draws that fall to a node of the trie of
scores, a binomial number falls to its left child. Every node has a generator of its own, keyed by the seed, the group, the class and the node, so what a
score gets depends on the scores alone, not on how they are cut into blocks; and every replicate draws exactly n.

The trie goes by the bits of a score in sorting order. Its upper part is drawn over blocks that are whole subtrees (see :func:`leaf_of`), the rest inside each block.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

SIGN = np.uint64(1 << 63)


def order_bits(x: np.ndarray) -> np.ndarray:
    """Numbers that sort as the doubles do."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits are equal."""
    x = a ^ b
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def leaf_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First key of the block of each key: the largest subtree around it with at most one of the sorted ``bounds`` inside."""
    at = np.searchsorted(bounds, keys, side="right")
    near = np.full((4, len(keys)), -1)
    for row, step in enumerate((-2, -1, 0, 1)):
        i = at + step
        ok = (i >= 0) & (i < len(bounds))
        if ok.any():
            near[row, ok] = shared_bits(keys[ok], bounds[i[ok]])
    depth = np.sort(near, axis=0)[2] + 1
    drop = np.minimum(64 - depth, 63).astype(np.uint64)
    return np.where(depth == 0, np.uint64(0), keys >> drop << drop)


class _Generators:
    """One generator that is set to the stream of a key: the same numbers as a new Philox with that key, without making one for each node."""

    def __init__(self):
        self.bits = np.random.Philox(key=0)
        self.generator = np.random.Generator(self.bits)
        self.state = self.bits.state

    def __call__(self, key: tuple) -> np.random.Generator:
        number = int.from_bytes(hashlib.md5(repr(key).encode()).digest(), "big")
        self.state["state"]["key"] = np.array((number & 0xFFFFFFFFFFFFFFFF, number >> 64), np.uint64)
        self.bits.state = self.state
        return self.generator


def allotted(keys: np.ndarray, counts: np.ndarray, drawn: np.ndarray, key: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """(position, draws in each replicate) of ascending ``keys`` with rows, for ``drawn`` draws from all of them."""
    total = [0, *np.cumsum(counts).tolist()]
    keys, seeded = keys.tolist(), _Generators()         # plain integers: a node looks at single keys
    stack = [(0, len(keys), drawn)]
    while stack:
        a, b, k = stack.pop()
        if total[a] == total[b] or not k.any():
            continue
        if b - a == 1:
            yield a, k
            continue
        depth = 64 - (keys[a] ^ keys[b - 1]).bit_length()
        right = keys[b - 1] >> (63 - depth) << (63 - depth)        # first key of the right child
        m = bisect_left(keys, right, a, b)
        left, rows = total[m] - total[a], total[b] - total[a]
        if left == rows:
            stack.append((a, m, k))
        elif not left:
            stack.append((m, b, k))
        else:
            few = seeded((*key, depth, right)).binomial(k, left / rows)
            stack += [(m, b, k - few), (a, m, few)]


# --- md5 draws, many at a time ------------------------------------------------

_SINE = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_WORDS = [(step * i + add) % 16 for i, (step, add) in enumerate([(1, 0)] * 16 + [(5, 1)] * 16 + [(3, 5)] * 16 + [(7, 0)] * 16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_numbers(prefix: bytes, first: int, end: int, at_once: int = 16384) -> np.ndarray:
    """The first 15 hex digits of md5 of ``prefix`` and k in decimals, as numbers, for k from ``first`` up to ``end``."""
    out = np.empty(end - first, np.uint64)
    while first < end:
        digits = len(str(first))
        stop = min(end, 10 ** digits, first + at_once)
        part = out[len(out) - (end - first):][:stop - first]
        if len(prefix) + digits > 55:
            part[:] = [int(hashlib.md5(prefix + b"%d" % k).hexdigest()[:15], 16) for k in range(first, stop)]
        else:
            part[:] = _md5_block(prefix, np.arange(first, stop), digits)
        first = stop
    return out


def _md5_block(prefix: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """One block of MD5 for many messages of equal length, each step over all of them."""
    text = np.zeros((len(numbers), 64), np.uint8)
    size = len(prefix) + digits
    text[:, :len(prefix)] = np.frombuffer(prefix, np.uint8)
    for place in range(digits):
        text[:, size - 1 - place] = numbers // 10 ** place % 10 + 48
    text[:, size] = 128
    text[:, 56:58] = (size * 8 % 256, size * 8 // 256)
    words = np.ascontiguousarray(text.view("<u4").T).astype(np.uint32, copy=False)
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += words[_WORDS[i]]
        f += _SINE[i]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        np.left_shift(f, np.uint32(_TURNS[i]), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    head = [(x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in zip((a, b), _START)]
    return (head[0] << np.uint64(32) | head[1]) >> np.uint64(4)
