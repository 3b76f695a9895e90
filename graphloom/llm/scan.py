"""Texts as arrays of code points: character classes, range hashes, and a hash index, all in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
#: Characters handled at once; temporary arrays stay a few megabytes however long the texts are.
SLAB = 1 << 19

_classes: np.ndarray | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = _inverse = np.ones(1, np.uint64)


def classes() -> np.ndarray:
    """Class of every code point; built once in a process."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        kind = {"L": LETTER, "N": NUMBER}
        out[:] = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        out[WHITE_SPACE] = SPACE
        _classes = out
    return _classes


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_mixed: np.ndarray | None = None


def _mixed_points() -> np.ndarray:
    global _mixed
    if _mixed is None:
        _mixed = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return _mixed


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, SLAB + 1)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.r_[np.uint64(1), np.cumprod(np.full(size, _BASE, np.uint64))]
        _inverse = np.r_[np.uint64(1), np.cumprod(np.full(size, inv, np.uint64))]


class RangeHash:
    """64-bit hashes of any ranges of an array of code points, from one prefix sum."""

    def __init__(self, cp: np.ndarray):
        _grow(len(cp))
        self._sum = np.empty(len(cp) + 1, np.uint64)
        self._sum[0] = 0
        np.cumsum(_mixed_points()[cp] * _powers[: len(cp)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * _inverse[start]
        return mix(h ^ (end - start).astype(np.uint64))


class HashIndex:
    """64-bit hash -> dense number, growing; lookups and insertions are vectorized."""

    def __init__(self, bits: int = 16):
        self._bits = bits
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._vals = np.full(1 << self._bits, -1, np.int64)
        self.size = 0

    def get(self, h: np.ndarray) -> np.ndarray:
        """The numbers, -1 where unknown."""
        mask = np.uint64((1 << self._bits) - 1)
        slot = (h & mask).astype(np.int64)
        val = self._vals[slot]
        out = np.where(self._keys[slot] == h, val, -1)
        todo = np.flatnonzero((out < 0) & (val >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            s = slot[todo]
            val = self._vals[s]
            hit = (val >= 0) & (self._keys[s] == h[todo])
            out[todo[hit]] = val[hit]
            todo = todo[(val >= 0) & ~hit]
        return out

    def add(self, h: np.ndarray) -> None:
        """Insert distinct, unknown hashes; they get the next numbers in order."""
        if 2 * (self.size + len(h)) > len(self._keys):
            held = self._vals >= 0
            keys, vals = self._keys[held], self._vals[held]
            size = self.size
            while 2 * (size + len(h)) > 1 << self._bits:
                self._bits += 2
            self._clear()
            self._put(keys, vals)
            self.size = size
        self._put(h, np.arange(self.size, self.size + len(h)))
        self.size += len(h)

    def _put(self, h: np.ndarray, vals: np.ndarray) -> None:
        mask = (1 << self._bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self._vals[s] < 0
            put = todo[free]
            self._vals[slot[put]] = vals[put]  # of several at one slot the last one stays
            won = free & (self._vals[s] == vals[todo])
            self._keys[s[won]] = h[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask


def pretoken_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pretokens of the byte-level split pattern start, over texts laid end to end.

    The pattern: a contraction; an optional blank and a run of letters, of numbers, or of other
    characters; white space up to the last before a word; white space. No text is empty.
    """
    n = len(cp)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    last = first[1:]
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    before_word = space & ~last
    before_word[:-1] &= ~space[1:]
    blank = before_word & (cp == 32)
    start[1:] &= ~blank[:-1]
    start |= before_word
    mark = np.flatnonzero((cp == 39) & start)
    if len(mark):
        mark = mark[~last[mark]]
        a = cp[mark + 1]
        one = np.isin(a, [ord(c) for c in "stmd"])
        b = np.where(~last[mark + 1], cp[np.minimum(mark + 2, n - 1)], 0)
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[mark[one | two] + 1] = False
        after = np.r_[mark[one] + 2, mark[two] + 3]
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start)


def slabs(lengths: list[int], room: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most room characters together, or one text."""
    low, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > room:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(lengths):
        yield low, len(lengths)
