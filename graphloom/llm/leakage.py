"""Evaluation texts leaking into training text (problem 8).

Method. Texts become sequences of normalized words. Every passage of n words of an item is a
window of the size of the least passage that counts, and so is every n words of a document. CGK
random walks embed the windows: 3n/2 steps, each of which emits the current word and moves on or
stays by a random bit that depends on the step and the word, so that windows a few edits apart
come out close in Hamming distance. Repeated bit sampling hashes some of the emitted words, by
several draws on each of several walks; their number is measured, so that windows within the
permitted edits meet with the target recall. Equal windows meet under every draw. Windows of a
document that meet some item window are joined to stretches, the stretches meet the items by
signature, and each pair is verified: the least edit distance of a window of the item to any
part of the stretch, and the longest run of equal words.

A whole item is no window: a document that holds 12 of its 70 words is 58 edits away from it.

Why it holds at size: documents are read once, however many items there are. What goes to the
workers is a Bloom filter of the item signatures, of bounded size; above the bound it lets more
windows through, which the join by signature then drops. Only stretches that met a signature
are shuffled, in pieces of bounded length. Texts are worked through in slabs.

Words are runs of letters and digits after normalization: escapes (\\n, \\u0041, \\u{41}, \\101, %20,
&amp;) are resolved, marks of comments and of character data dropped, inline tags dropped and other
tags taken as breaks, whatever their length, commands of text markup dropped, compatibility
forms folded, case folded, invisible characters removed.

Cases. Null and empty texts, and items of fewer than n words, give no pairs. Repeated documents
or items give a pair once. A null doc_id or item_id is kept as it is. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scan import LETTER, NUMBER, RangeHash, classes, mix, points, slabs
from graphloom.session import broadcast_if_small, cut

WINDOW = 12
EDITS = 1
RECALL = 0.95
#: Sampled words of one draw, and draws on one walk.
SAMPLES, DRAWS = 8, 4
#: Bits of the Bloom filter for each signature, at most so many bits in all, and probes.
FILTER_BITS, FILTER_MOST, FILTER_PROBES = 48, 1 << 29, 6
#: Bits of the filter that one task builds.
SEGMENT_BITS = 1 << 20
#: Windows of one stretch.
STRETCH = 256

#: Tags inside a line of text, which part no words.
INLINE = "a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
#: Commands of text markup whose argument is text.
COMMANDS = "textbf|textit|texttt|textsc|textsf|textrm|textsl|textnormal|emph|underline|uline|enquote|mbox|text|mathrm|mathbf|mathit|mathsf|mathtt|section|subsection|subsubsection|paragraph|chapter|title|caption|footnote|item"
_REST = r"""(?>(?:\s+[^\s"'<>/=]+(?>\s*=\s*(?>"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*+)\s*+/?>"""
_INLINE = re.compile(rf"</?(?:{INLINE}){_REST}", re.IGNORECASE)
_TAG = re.compile(rf"<!--|-->|<!\[CDATA\[|\]\]>|<!doctype[^<>]*+>|<\?[a-z][^<>]*+\?>|</?[a-z][^\s<>/=\"']*+{_REST}", re.IGNORECASE)
_COMMAND = re.compile(rf"\\+(?:{COMMANDS})\*?(?=[\s{{\[])")
_UNICODE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\}|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|x\{([0-9a-fA-F]{1,6})\})")
_OCTAL = re.compile(r"\\+([0-3][0-7]{2})")
_ESCAPE = re.compile(r"\\+([nrtfvb0])")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")


def _invisible() -> re.Pattern:
    """Format characters, fillers and variation selectors."""
    codes = sorted({*(c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"), 0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)})
    spans: list[list[int]] = []
    for c in codes:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]")


_INVISIBLE = _invisible()


def _character(m: re.Match) -> str:
    code = int(next(g for g in m.groups() if g), 16)
    return chr(code) if code < 0x110000 else " "


def _untagged(text: str) -> str:
    return _TAG.sub(" ", _INLINE.sub("", text))


def normalize(text: str) -> str:
    """The text of which runs of letters and digits are the words."""
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
        text, resolved = _UNICODE.subn(_character, text)
        if resolved:  # two escapes can make one character
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        text = _ESCAPE.sub(" ", _OCTAL.sub(lambda m: chr(int(m[1], 8)), text))
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m[0], errors="replace"), text)
    if "<" in text or "-->" in text:
        text = _untagged(text)
    while "&" in text and (plain := html.unescape(text)) != text:  # an escaped escape is shorter each time
        text = _untagged(plain) if "<" in plain else plain
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return unicodedata.normalize("NFKC", text.casefold())


class Words:
    """The words of texts laid end to end: hashes, places, and the text each is from."""

    def __init__(self, texts: list[str]):
        self.texts = [normalize(t) for t in texts]
        self.joined = "\n".join(self.texts)
        cp = points(self.joined)
        kind = classes()[cp]
        inside = np.r_[False, (kind == LETTER) | (kind == NUMBER), False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = RangeHash(cp).of(self.start, self.end)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in self.texts), np.int64, len(self.texts)))
        self.owner = np.searchsorted(ends, self.start, "right")

    def windows(self, n: int) -> np.ndarray:
        """First words of the windows of n words that lie in one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.owner[: len(self.owner) - n + 1] == self.owner[n - 1 :])

    def at(self, first: int, n: int) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True)]


class Walks:
    """CGK walks over windows of n words, each with several draws of sampled steps."""

    def __init__(self, n: int, samples: int, walks: int, draws: int = DRAWS):
        self.n = n
        self.plans = []
        steps = n + n // 2  # on average three quarters of a window; what lies behind is seldom met
        for turn in range(walks):
            rng = np.random.default_rng(0xC6 + turn)
            drawn = [set(rng.choice(steps, min(samples, steps), replace=False).tolist()) for _ in range(draws)]
            salts = rng.integers(1, 1 << 63, 1 + steps // 64, dtype=np.uint64)
            odd = rng.integers(1, 1 << 62, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.plans.append((salts, drawn, odd, rng.integers(1, 1 << 63, draws, dtype=np.uint64)))

    def signatures(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each draw (row) and window (column): a sum of the sampled words by odd factors of their steps."""
        out = np.empty((sum(len(p[1]) for p in self.plans), len(first)), np.uint64)
        words = np.r_[hashes, np.zeros(1, np.uint64)]
        row = 0
        for salts, drawn, odd, starts in self.plans:
            bits = [mix(words ^ s).view(np.int64) for s in salts]
            last = 1 + max(max(d) for d in drawn)
            for low in range(0, len(first), 1 << 14):
                at = first[low : low + (1 << 14)].copy()
                stop = at + self.n
                made = out[row : row + len(drawn), low : low + (1 << 14)]
                made[:] = starts[:, None]
                for t in range(last):
                    # Past the window, which takes n steps at least, every step emits the same pad.
                    here = at if t < self.n else np.where(at < stop, at, len(hashes))
                    some = [m for d, m in zip(drawn, made, strict=True) if t in d]
                    if some:
                        word = words[here] * odd[t]
                        for m in some:
                            m += word
                    at += (bits[t // 64][here] >> (t % 64)) & 1
            row += len(drawn)
        return out


@functools.cache
def measured(n: int, samples: int, edits: int, recall: float, trials: int = 2000, draws: int = DRAWS, most: int = 16) -> tuple[int, float]:
    """Walks needed so that windows `edits` random edits apart meet with the recall, and the recall measured with them."""
    if edits == 0:
        return 1, 1.0
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 62, (trials, 2 * n), dtype=np.uint64)
    b = a.copy()
    for row in b:
        for _ in range(edits):
            i, kind, new = int(rng.integers(0, n)), int(rng.integers(0, 3)), rng.integers(1, 1 << 62, dtype=np.uint64)
            if kind == 0:
                row[i:-1] = row[i + 1 :].copy()
            elif kind == 1:
                row[i + 1 :], row[i] = row[i:-1].copy(), new
            else:
                row[i] = new
    first = np.arange(trials) * 2 * n
    walks = Walks(n, samples, most, draws)
    met = (walks.signatures(a.ravel(), first) == walks.signatures(b.ravel(), first)).reshape(most, draws, trials).any(axis=1)
    got = np.logical_or.accumulate(met, axis=0).mean(axis=1)
    enough = np.flatnonzero(got >= recall)
    need = int(enough[0]) + 1 if len(enough) else most
    return need, float(got[need - 1])


def probes(signatures: np.ndarray, bits: int) -> np.ndarray:
    """The places of each signature in a filter of so many bits (a power of two); one row for each probe."""
    step = mix(signatures) | np.uint64(1)
    return np.stack([((signatures + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(FILTER_PROBES)])


def passing(signatures: np.ndarray, bits: int, body: np.ndarray) -> np.ndarray:
    """Places of the signatures that the filter lets through; few outlast the first probe."""
    left, step = np.arange(0), None
    for i in range(FILTER_PROBES):
        if i == 1:
            step = mix(signatures[left]) | np.uint64(1)
        at = ((signatures if i == 0 else signatures[left] + np.uint64(i) * step) & np.uint64(bits - 1)).view(np.int64)
        on = np.flatnonzero((body[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        left, step = (on, step) if i == 0 else (left[on], step[on])
    return left


class Passages:
    """Word sequences with one numbering, and the places of each one's runs of m words."""

    #: Sequences kept before the numbering starts over.
    MOST = 4096

    def __init__(self, m: int):
        self.m = m
        self.clear()

    def clear(self) -> None:
        self.number: dict[str | tuple, int] = {}
        self.known: dict[str, tuple[np.ndarray, dict[int, list[int]]]] = {}

    def get(self, key: str, words: Callable[[], list[str]]) -> tuple[np.ndarray, dict[int, list[int]]]:
        """The numbers of the words, and the places of each run by its number."""
        if key not in self.known:
            number = self.number
            codes = [number.setdefault(w, len(number)) for w in words()]
            places: dict[int, list[int]] = {}
            for j, r in enumerate(zip(*(codes[i:] for i in range(self.m)), strict=False)):
                places.setdefault(number.setdefault(r, len(number)), []).append(j)
            self.known[key] = np.array(codes, np.int64), places
        return self.known[key]


def _nearest(parts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The least edit distance of each window (a row) to any stretch of the words of its part."""
    column = np.tile(np.arange(windows.shape[1] + 1), (len(windows), 1)).T
    best = column[-1]
    for word in parts.T:
        new = np.zeros_like(column)
        for i in range(1, len(column)):
            new[i] = np.minimum(np.minimum(column[i], new[i - 1]) + 1, column[i - 1] + (windows[:, i - 1] != word))
        column, best = new, np.minimum(best, new[-1])
    return best


def verify(pairs: list[tuple[tuple, tuple]], n: int, most: int) -> list[tuple[int, int]]:
    """For each stretch and item (of Passages) the least edit distance (most + 1 if it is more) of n consecutive words of the
    item to any part of the stretch, and the longest run of equal words (0 if it is under the length that any such part has).

    Exact: k edits leave a run of at least (n - k) / (k + 1) equal words in a window, and the rest of its match lies
    within k places of that run's diagonal.
    """
    m = least_run(n, most)
    out: list[tuple[int, int]] = []
    who, first, last, shift, texts, items = [], [], [], [], [], []
    at_text = at_item = 0
    pad = np.full(n + 2 * most, -1, np.int64)
    for k, ((here, own), (there, places)) in enumerate(pairs):
        met = sorted((i - j, j) for r in own.keys() & places.keys() for i in own[r] for j in places[r])
        ended: list[list[int]] = []  # diagonal, first and end place in the item of each run
        for d, j in met:
            if ended and ended[-1][0] == d and ended[-1][2] == j + m - 1:
                ended[-1][2] += 1
            else:
                ended.append([d, j, j + m])
        longest = max((e - j for _, j, e in ended), default=0)
        out.append((0 if longest >= n else most + 1, longest))
        if longest >= n or not most or not ended:
            continue
        texts += [pad, here, pad]
        items.append(there)
        for d, j, e in ended:
            who.append(k)
            first.append(at_item + max(0, j + m - n))
            last.append(at_item + min(e - m, len(there) - n))
            shift.append(at_text + len(pad) + d - most - at_item)
        at_text += 2 * len(pad) + len(here)
        at_item += len(there)
    if who:
        text, item = np.concatenate(texts), np.concatenate(items)
        many = np.maximum(np.array(last) - np.array(first) + 1, 0)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(first, many) + step
        whose, start = np.repeat(who, many), at + np.repeat(shift, many)
        their, some = item[at[:, None] + np.arange(n)], text[start[:, None] + np.arange(n + 2 * most)]
        held = np.zeros(len(at), np.int64)
        for c in range(n):
            held += (some == their[:, c, None]).any(axis=1)
        near = np.flatnonzero(held >= n - most)  # each edit takes at most one word out
        for k, f in zip(whose[near].tolist(), _nearest(some[near], their[near]).tolist(), strict=True):
            out[k] = (min(out[k][0], f), out[k][1])
    return out


def least_run(n: int, most: int) -> int:
    return max(1, -(-(n - most) // (most + 1)))


def stretches(words: Words, first: np.ndarray, hit: np.ndarray, n: int, margin: int) -> Iterator[tuple[int, int, int, int]]:
    """Text, first word, end, and end in `hit` of the stretches that the windows numbered `hit` (ascending) make up."""
    low = 0
    at, owner = first[hit], words.owner[first[hit]]
    for high in range(1, len(hit) + 1):
        if high < len(hit) and owner[high] == owner[low] and at[high] - at[high - 1] <= n and high - low < STRETCH:
            continue
        text = int(owner[low])
        a, b = np.searchsorted(words.owner, (text, text + 1))
        yield text, max(int(a), int(at[low]) - margin), min(int(b), int(at[high - 1]) + n + margin), high
        low = high


def item_signatures(items: DataFrame, window: int, samples: int, walks: int) -> DataFrame:
    """item_no, sig: the signatures of every window of every item (item_no, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Walks(window, samples, walks)
        for batch in batches:
            ids, texts = np.asarray(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            for low, high in slabs([len(t) for t in texts], 1 << 17):
                words = Words(texts[low:high])
                first = words.windows(window)
                sig = plan.signatures(words.hash, first)
                owner = np.tile(ids[low:high][words.owner[first]], len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(sig.ravel().view(np.int64))], ["item_no", "sig"])

    return items.mapInArrow(run, "item_no bigint, sig bigint").distinct()


def signature_filter(signatures: DataFrame) -> tuple[int, bytes]:
    """Bits and body of a Bloom filter of the column sig, built in segments; its size is bounded by FILTER_MOST."""
    n = signatures.count()
    bits = 1 << 10
    while bits < min(n * FILTER_BITS, FILTER_MOST):
        bits *= 2
    size = min(bits, SEGMENT_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(probes(batch.column(0).to_numpy().view(np.uint64), bits))
            first = np.flatnonzero(np.r_[True, at[1:] // size != at[:-1] // size][: len(at)])
            parts = np.split((at % size).astype(np.int32), first[1:]) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(at[first] // size, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], ["segment", "places"])

    def segment(table: pa.Table) -> pa.Table:
        on = np.zeros(size, np.uint8)
        for part in table["places"].chunks:
            on[part.flatten().to_numpy()] = 1
        return pa.table({"segment": table["segment"].slice(0, 1), "body": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    parts = signatures.select("sig").mapInArrow(places, "segment bigint, places array<int>").groupBy("segment").applyInArrow(segment, "segment bigint, body binary")
    body = bytearray(bits // 8)
    for row in parts.collect():  # at most FILTER_MOST bits in all
        body[row["segment"] * size // 8 : (row["segment"] + 1) * size // 8] = row["body"]
    return bits, bytes(body)


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = EDITS, recall: float = RECALL, samples: int = SAMPLES) -> DataFrame:
    """doc_id, item_id, edits, run: documents with a part within `edits` edits of a window of the item, and the longest equal run near it."""
    spark = documents.sparkSession
    held = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    held = cut(held.select(F.xxhash64("item_id", "text").alias("item_no"), "item_id", "text"))
    walks, _ = measured(window, samples, edits, recall)
    known = cut(item_signatures(held.select("item_no", "text").distinct(), window, samples, walks))
    bits, body = signature_filter(known)
    sieve = spark.sparkContext.broadcast(body)
    docs = documents.select("doc_id", "text").where(F.length("text") > 0)
    hits = docs.mapInArrow(_sift(sieve, bits, window, samples, walks, edits), "doc_id bigint, words string, sigs array<bigint>")
    hits = cut(hits.withColumn("stretch", F.xxhash64("doc_id", "words")))
    met = hits.select("stretch", F.explode("sigs").alias("sig")).join(broadcast_if_small(known), "sig").select("stretch", "item_no").distinct()
    # A number is given: what is to be verified is small in bytes and long in work. A stretch's pairs come one after another.
    met = cut(met).repartition(max(8, 2 * spark.sparkContext.defaultParallelism), "stretch").sortWithinPartitions("stretch")
    words = broadcast_if_small(hits.select("stretch", "doc_id", "words"))
    pairs = met.join(words, "stretch").join(broadcast_if_small(held), "item_no").select("doc_id", "words", "item_id", "text")
    sure = pairs.mapInArrow(_verified(window, edits), "doc_id bigint, item_id bigint, edits int, run int")
    return sure.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("run").alias("run"))


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = EDITS, recall: float = RECALL, samples: int = SAMPLES) -> DataFrame:
    """doc_id, item_id: the documents that hold `window` consecutive words of an item, out of the verified stretches."""
    return leaks(documents, items, window, edits, recall, samples).where(F.col("run") >= window).select("doc_id", "item_id")


def _sift(sieve, bits: int, window: int, samples: int, walks: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, plan = np.frombuffer(sieve.value, np.uint8), Walks(window, samples, walks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in slabs([len(t) for t in texts], 1 << 17):
                words = Words(texts[low:high])
                first = words.windows(window)
                sig = plan.signatures(words.hash, first)
                met = [passing(s, bits, body) for s in sig]
                hit = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
                on = np.zeros(sig.shape, bool)
                for r, m in enumerate(met):
                    on[r, m] = True
                rows, begin = [], 0
                for text, a, b, end in stretches(words, first, hit, window, 2 * edits):
                    some = hit[begin:end]
                    rows.append((ids[low + text], " ".join(words.at(a, b - a)), np.unique(sig[:, some][on[:, some]]).view(np.int64)))
                    begin = end
                docs, text, sigs = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(text, pa.string()), pa.array(list(sigs), pa.list_(pa.int64()))], ["doc_id", "words", "sigs"])

    return run


def _verified(window: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Passages(least_run(window, edits))

        def words_of(text: str) -> list[str]:
            w = Words([text])
            return w.at(0, len(w.start))

        for batch in batches:
            docs, words, items, texts = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for low in range(0, len(docs), 512):
                if len(known.known) > Passages.MOST:
                    known.clear()
                pairs = [(known.get(" " + w, lambda w=w: w.split(" ")), known.get("|" + t, lambda t=t: words_of(t))) for w, t in zip(words[low : low + 512], texts[low : low + 512], strict=True)]
                rows += [(docs[low + k], items[low + k], *v) for k, v in enumerate(verify(pairs, window, edits)) if v[0] <= edits]
            ids, names, least, longest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(least, pa.int32()), pa.array(longest, pa.int32())], ["doc_id", "item_id", "edits", "run"])

    return run
