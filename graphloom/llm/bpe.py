"""Encoding with a public byte-level BPE tokenizer (problem 7).

Method. Texts are cut into pretokens by the tokenizer's own pattern, expressed over arrays of
character classes; each distinct pretoken of a batch, told apart by a 64-bit hash, is encoded
once. Pretokens are bucketed by length into padded numpy matrices of token
ids. Every round each row merges its leftmost pair of least rank: ranks come from an open-
addressing hash table over id pairs, the row is closed up behind the merge, only the two pairs
next to the merge are looked up again, and rows without a further merge leave the matrix. Runs
too long for a padded row are merged in one dimension, all places of the least pair at a time,
which gives the same ids unless a merge brings up a lower rank; then the run is done pair by
pair from a heap.

Why it holds at size: one narrow pass over the documents without a shuffle; the vocabulary is
sent once to each executor; the cache of pretokens is bounded and only saves time.

Cases. Null, empty: the empty list. Blank and very long texts, unbroken runs and any Unicode
are encoded whole. Special tokens' strings are ordinary text. Repeated doc_ids and texts give
a row each; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.scan import HashIndex, RangeHash, points, pretoken_starts, slabs

#: Where the vocabulary is read from unless a path is given.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_NONE = np.int32(2**31 - 1)
_LONG = 64
_CACHE = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, by vectorized linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(10, int(len(left) * 3).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._vals = np.full(1 << bits, _NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            s = slot[todo]
            free = self._keys[s] < 0
            put = todo[free]
            self._keys[slot[put]] = key[put]  # of several at one slot the last one stays
            won = self._keys[s] == key[todo]
            self._vals[s[won]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self._mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> self._shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, _NONE where a pair does not merge; ids below 0 never do."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        key = np.where((left < 0) | (right < 0), np.int64(-2), key)
        slot = self._slot(key)
        seen = self._keys[slot]
        out = np.where(seen == key, self._vals[slot], _NONE)
        todo = np.flatnonzero((seen != key) & (seen >= 0) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self._mask
            seen = self._keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self._vals[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


class Bpe:
    """A byte-level BPE vocabulary in the ranks format: base64 token, blank, id."""

    def __init__(self, body: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in body.splitlines() if line)}
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(merged, np.int32))
        self._ranks = ranks
        self._index, self._floor = None, 0
        self._reset()

    def _reset(self) -> None:
        self._floor += 0 if self._index is None else self._index.size
        self._index = HashIndex()
        self._single: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.int32)
        self._start = np.zeros(1 << 14, np.int64)
        self._size = np.zeros(1 << 14, np.int64)
        self._used = 0

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pretoken."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > _LONG):
            out[i] = self._long(words[i])
        low = 0
        for width in (1, 2, 4, 6, 8, 12, 16, 24, 32, _LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for part in np.array_split(rows, max(1, len(rows) * width // (1 << 18))):
                if len(part):
                    self._matrix([words[i] for i in part], width, part, out)
        for i in np.flatnonzero(sizes == 0):
            out[i] = np.zeros(0, np.int32)
        return out  # type: ignore[return-value]

    def _matrix(self, words: list[bytes], width: int, where: np.ndarray, out: list) -> None:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_id[raw]
        ids[np.arange(width) >= size[:, None]] = -1
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        while True:
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                least = rank[np.arange(len(rank)), at]
            else:
                least = np.full(len(ids), _NONE)
            ended = least == _NONE
            if ended.any():
                for i, row, n in zip(where[ended], ids[ended], size[ended], strict=True):
                    out[i] = row[:n].copy()
                go = ~ended
                where, ids, rank, size = where[go], ids[go], rank[go], size[go]
                if not len(where):
                    return
                at, least = at[go], least[go]
                keep = max(1, int(size.max()))
                ids, rank = ids[:, :keep], rank[:, : keep - 1]
            n, cols = ids.shape
            row = np.arange(n)
            ids[row, at] = least
            behind = np.arange(cols - 1)
            ids = np.take_along_axis(ids, behind + (behind > at[:, None]), axis=1)
            size = size - 1
            ids[behind >= size[:, None]] = -1
            if cols > 2:
                behind = np.arange(cols - 2)
                rank = np.take_along_axis(rank, behind + (behind >= at[:, None]), axis=1)
                has_left = np.flatnonzero(at > 0)
                rank[has_left, at[has_left] - 1] = self.pairs.get(ids[has_left, at[has_left] - 1], ids[has_left, at[has_left]])
                has_right = np.flatnonzero(at < cols - 2)
                rank[has_right, at[has_right]] = self.pairs.get(ids[has_right, at[has_right]], ids[has_right, at[has_right] + 1])
            else:
                rank = rank[:, :0]

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank):
            least = rank.min()
            if least == _NONE:
                break
            place = np.flatnonzero(rank == least)
            # Of overlapping places every second one is taken, from the left of each run.
            run = np.cumsum(np.r_[True, np.diff(place) > 1])
            first = place[np.flatnonzero(np.r_[True, np.diff(run) > 0])]
            place = place[(place - first[run - 1]) % 2 == 0]
            ids[place] = least
            alive = np.ones(len(ids), bool)
            alive[place + 1] = False
            moved = place - np.arange(len(place))
            ids = ids[alive]
            rank = rank[alive[1:]]
            near = np.unique(np.r_[moved - 1, moved])
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = fresh = self.pairs.get(ids[near], ids[near + 1])
            if len(fresh) and fresh.min() < least:
                return self._heap(word)
        return ids

    def _heap(self, word: bytes) -> np.ndarray:
        part: list[bytes | None] = [bytes([b]) for b in word]
        nxt, prev = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := self._ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if part[i] is not None else len(part)
            if j >= len(part) or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[i] < len(part):
                prev[nxt[i]] = i
                if (r := self._ranks.get(part[i] + part[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[nxt[i]]))
            if (k := prev[i]) >= 0 and (r := self._ranks.get(part[k] + part[i])) is not None:
                heapq.heappush(heap, (r, k, part[k], part[i]))
        return np.array([self._ranks[p] for p in part if p is not None], np.int32)

    def _numbers(self, text: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache positions of pretokens; the unknown ones are encoded together first."""
        if self._index.size > _CACHE:
            self._reset()
        at = self._index.get(hashes)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh, where = np.unique(hashes[unknown], return_index=True)
            pick = unknown[where]
            got = self.words([text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
            base, need = self._index.size, sum(map(len, got))
            while self._used + need > len(self._ids):
                self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            while base + len(fresh) > len(self._start):
                self._start, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._size))
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._size[base : base + len(fresh)] = sizes
            self._start[base : base + len(fresh)] = self._used + np.cumsum(sizes) - sizes
            self._ids[self._used : self._used + need] = np.concatenate(got)
            self._used += need
            self._index.add(fresh)
            at[unknown] = self._index.get(hashes[unknown])
        return at

    def pretokens(self, text: str, text_starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pretokens of texts laid end to end, and their cache positions."""
        cp = points(text)
        starts = pretoken_starts(cp, np.zeros(1, np.int64) if text_starts is None else text_starts)
        ends = np.r_[starts[1:], len(cp)]
        return starts, self._numbers(text, RangeHash(cp).of(starts, ends), starts, ends)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pretokens of a text, and the number of ids of each."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, at = self.pretokens(text)
        return starts, self._size[at]

    def count_one(self, pretoken: str) -> int:
        """The number of ids of one pretoken, kept by its string."""
        if pretoken not in self._single:
            if len(self._single) > 10_000:
                self._single.clear()
            self._single[pretoken] = len(self.words([pretoken.encode("utf-8", "surrogatepass")])[0])
        return self._single[pretoken]

    def cached(self, at: np.ndarray | None, pretokens: list[str]) -> list[np.ndarray]:
        """The ids of pretokens, from their cache positions where these still hold."""
        if at is None or (at < self._floor).any():
            return self.words([w.encode("utf-8", "surrogatepass") for w in pretokens])
        at = at - self._floor
        return [self._ids[a : a + n] for a, n in zip(self._start[at].tolist(), self._size[at].tolist(), strict=True)]

    def counts_batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """counts() of each text and the cache positions for cached(), from one pass; no text is empty."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        starts, at = self.pretokens("".join(texts), first)
        num = self._size[at]
        cuts = np.searchsorted(starts, first)
        own = starts - np.repeat(first, np.diff(np.r_[cuts, len(starts)]))
        return np.split(own, cuts[1:]), np.split(num, cuts[1:]), np.split(at + self._floor, cuts[1:])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of the texts in it."""
        sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts, at = self.pretokens(joined, np.unique((ends - sizes)[sizes > 0])) if (joined := "".join(t for t in texts if t)) else (np.zeros(0, np.int64),) * 2
        n, first = self._size[at], self._start[at]
        total = np.r_[0, np.cumsum(n)]
        ids = self._ids[np.arange(total[-1]) + np.repeat(first - total[:-1], n)]
        return ids, np.r_[0, total[np.searchsorted(starts, ends)]]


_loaded: dict[int, Bpe] = {}


def loaded(body: bytes) -> Bpe:
    """The vocabulary of this worker, built once."""
    key = hash(body)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(body)
    return _loaded[key]


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast value: a fixed file of under a megabyte."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, ids: the token ids of every text."""
    body = vocabulary(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(body.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in slabs([len(t or "") for t in texts]):
                ids, offsets = bpe.encode_batch(texts[low:high])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
