"""Splitting oversized texts at natural boundaries (problem 9).

Method. A text is handled in ranges of bytes, which are taken out of it before any worker sees
it, each with the bytes before it as a halo. A worker looks for the last natural boundary in the
half range before each nominal place that is also a certain pretoken boundary; these tables of
boundaries are stitched per text, so that every range runs from one boundary to the next. A
range's first piece takes its overlap from the halo, so ranges are cut into pieces
independently of one another: a worker finds the boundaries inside (paragraph, line, sentence,
pretoken), their positions and their token sums, and emits pieces by offset. Prefix sums over
the ranges' lengths, tokens and pieces shift the offsets and number the pieces. Texts of one
range need no stitching and never leave their task.

A piece holds at most `limit` tokens when encoded by itself. It ends at the last paragraph end
in its second half, else the last line end there, else sentence end; failing these at any such
end in its first half past the overlap, then at a pretoken, and inside an unbroken run at a
token that ends a character. The next piece starts 32 to 64 tokens earlier.

Why it holds at size: no shuffle for texts of one range; longer ones are spread by range over a
given number of tasks, so a giant text is many tasks of which none holds it, and only one row
for each range meets in the stitching.

Cases. Null, empty and short texts (up to `limit` tokens) give no pieces. A row that occurs
twice gives its pieces twice. An unbroken run of more than JOINED ranges is cut at a fixed place,
so its token total can differ from that of the whole run by the few tokens at the cut. Columns
other than the two named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import DEFAULT_VOCABULARY, Bpe, loaded, vocabulary
from graphloom.llm.scan import SPACE, classes, points, slabs
from graphloom.session import cut

LIMIT, OVERLAP = 512, (32, 64)
#: Bytes of a range; characters of the halo before it, of at most four bytes each.
RANGE, HALO = 1 << 15, 1 << 12
#: Ranges without any boundary that are handled as one.
JOINED = 4
#: An unbroken pretoken is divided into units of at most so many tokens.
UNIT = 16

#: Marks that end a sentence before white space, those that end one anywhere, and closing marks.
ENDS, WIDE_ENDS, CLOSERS = ".!?…", "。！？", "\"')]}»”’"


_BREAKS = [regex.compile(p) for p in (r"(?r)\n[^\S\n]*\n(?=\S)", r"(?r)\n(?=\S)", r"(?r)[.!?。！？](?=\s)", r"(?r)\S(?=\s)")]


def aligned(body: bytes, at: int) -> int:
    """The first place from `at` on at which a character starts."""
    while at < len(body) and body[at] & 0xC0 == 0x80:
        at += 1
    return at


def last_break(body: bytes) -> int | None:
    """The last boundary between pretokens in a stretch of text, of the most natural kind there is; None if there is none."""
    low = aligned(body, 0)
    text = body[low:].decode("utf-8", "surrogateescape")
    for p in _BREAKS:
        if m := p.search(text):
            return low + len(text[: m.end()].encode("utf-8", "surrogateescape"))
    return None


def own_tokens(bpe: Bpe, text: str, after: str) -> int:
    """Tokens of a range as part of its text; after is the character behind it, which white space at its end looks at."""
    starts, counts = bpe.counts(text + after)
    return int(counts[starts < len(text)].sum())


def units(bpe: Bpe, text: str, starts: np.ndarray, counts: np.ndarray, at_cache: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the units of a text, their token counts, and whether a unit starts a pretoken.

    starts, counts and cache positions are those of the pretokens.
    """
    whole = np.ones(len(starts), bool)
    long_ = np.flatnonzero(counts > UNIT)
    if not len(long_):
        return starts, counts, whole
    ends = np.r_[starts[1:], len(text)]
    words = [text[a:b] for a, b in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True)]
    pos, num, new, at = [], [], [], 0
    for k, word, ids in zip(long_.tolist(), words, bpe.cached(None if at_cache is None else at_cache[long_], words), strict=True):
        pos.append(starts[at:k])
        num.append(counts[at:k])
        new.append(whole[at:k])
        cp = points(word).astype(np.int64)
        char_end = np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        token_end = np.cumsum(bpe.token_bytes[ids])
        nearest = np.searchsorted(char_end, token_end)
        clean = np.flatnonzero(char_end[nearest] == token_end)  # tokens that end a character
        step = clean // UNIT
        take = clean[np.r_[step[1:] != step[:-1], True]]
        cuts = np.r_[0, nearest[take] + 1]
        pos.append(starts[k] + cuts[:-1])
        num.append(np.diff(np.r_[-1, take]))
        new.append(np.arange(len(take)) == 0)
        at = k + 1
    return np.concatenate([*pos, starts[at:]]), np.concatenate([*num, counts[at:]]), np.concatenate([*new, whole[at:]])


def _marked(cp: np.ndarray, marks: str) -> np.ndarray:
    out = cp == ord(marks[0])
    for c in marks[1:]:
        out |= cp == ord(c)
    return out


def boundary_kinds(cp: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """3 paragraph end, 2 line end, 1 sentence end, 0 none, for the positions in a text."""
    n = len(cp)
    space = classes()[cp] == SPACE
    line = (cp == 10) | (cp == 0x2028) | (cp == 0x2029)
    line[:-1] |= (cp[:-1] == 13) & (cp[1:] != 10)
    if n:
        line[-1] |= cp[-1] == 13
    lines = np.r_[0, np.cumsum(line)]
    at = np.arange(n)
    word = np.maximum.accumulate(np.where(space, -1, at)) if n else at
    before = np.maximum(pos - 1, 0)
    last = np.where(pos > 0, word[before] if n else 0, -1)  # the last character before that is no white space
    breaks = lines[pos] - lines[last + 1]
    closer = _marked(cp, CLOSERS)
    solid = np.maximum.accumulate(np.where(closer | space, -1, at)) if n else at
    final = np.where(last >= 0, solid[np.maximum(last, 0)], -1)
    mark = np.where(final >= 0, cp[np.maximum(final, 0)], 0)
    gap = np.where(pos < n, space[np.minimum(pos, n - 1)], True) | (last < pos - 1)
    sentence = (_marked(mark, ENDS) & gap) | _marked(mark, WIDE_ENDS)
    kind = np.where(breaks >= 2, 3, np.where(breaks == 1, 2, np.where(sentence, 1, 0)))
    return np.where(pos > 0, kind, 0)


def pieces(
    bpe: Bpe, text: str, halo: int = 0, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, known: tuple[np.ndarray, ...] | None = None
) -> list[tuple[int, int, int, int]]:
    """Start, end, tokens and overlap of the pieces of text[halo:]; the first may start in the halo.

    known: the starts, token counts and cache positions of the text's pretokens, where they were computed before.
    """
    pos, num, whole = units(bpe, text, *(known or bpe.counts(text)))
    m = len(pos)
    cum = np.r_[0, np.cumsum(num)]
    pos = np.r_[pos, len(text)]
    whole = np.r_[whole, True]
    cp = points(text)
    kind = boundary_kinds(cp, pos)
    space = classes()[cp] == SPACE
    # The first unit of the white space that a boundary ends: by itself such a run is one pretoken.
    word_unit = np.maximum.accumulate(np.where(space[pos[:-1]] & space[pos[1:] - 1], -1, np.arange(m)))
    good = np.flatnonzero(kind)

    def back(e: int) -> int:
        """Where the piece after one that ends at e starts."""
        low, high = (int(x) for x in np.searchsorted(cum, (cum[e] - overlap[1], cum[e] - overlap[0] + 1)))
        a, b = (int(x) for x in np.searchsorted(good, (low + 1, high - 1)))
        if a < b:
            return int(good[(a + b) // 2])
        return max(0, min(high - 1, max(low, int(np.searchsorted(cum, cum[e] - sum(overlap) // 2)))))

    def fits(s: int, e: int) -> int:
        """Tokens of the piece by itself."""
        run = int(word_unit[e - 1]) + 1
        if not (whole[s] and whole[e]) or run <= s:
            return len(bpe.encode_batch([text[pos[s] : pos[e]]])[0])
        if run == e:
            return int(cum[e] - cum[s])
        return int(cum[run] - cum[s]) + bpe.count_one(text[pos[run] : pos[e]])

    first = int(np.searchsorted(pos, halo))
    s = back(first) if halo else first
    done = first
    out = []
    while True:
        e = min(m, int(np.searchsorted(cum, cum[s] + limit, "right")) - 1)
        n = fits(s, e)
        while n > limit and e > done + 1:
            e -= 1
            n = fits(s, e)
        if e < m:
            half, floor = (int(x) for x in np.searchsorted(cum, (cum[s] + limit // 2, cum[done] + overlap[1])))
            for low, kinds in ((max(half, done + 1), (3, 2, 1)), (max(floor, done + 1), (1,))):
                window = kind[low : e + 1]
                hit = next((int(w[-1]) + low for k in kinds if len(w := np.flatnonzero(window >= k))), None)
                if hit is not None:
                    e = hit
                    break
            n = fits(s, e)
            while n > limit and e > done + 1:
                e -= 1
                n = fits(s, e)
        out.append((int(pos[s]), int(pos[e]), n, int(cum[done] - cum[s])))
        if e >= m:
            return out
        done = e
        s = max(back(e), s + 1)


def split_oversized(documents: DataFrame, path: str = DEFAULT_VOCABULARY, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, size: int = RANGE) -> DataFrame:
    """doc_id, piece_no, char_start, char_end, n_tokens, overlap_tokens, doc_tokens, text of every piece."""
    body = vocabulary(documents, path)
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") > 0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(body.value)
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in slabs([len(t) for t in texts]):
                rows = []
                for doc, text, *known in zip(docs_[low:high], texts[low:high], *bpe.counts_batch(texts[low:high]), strict=True):
                    if (total := int(known[1].sum())) > limit:
                        rows += [(doc, i, a, b, n, o, total, text[a:b]) for i, (a, b, n, o) in enumerate(pieces(bpe, text, 0, limit, overlap, tuple(known)))]
                yield _batch(rows, _OUT)

    single = docs.where(F.octet_length("text") <= size).mapInArrow(whole, _ddl(_OUT))
    long_ = docs.where(F.octet_length("text") > size)
    return single.unionByName(_over_ranges(long_, body, limit, overlap, size))


def _over_ranges(docs: DataFrame, body, limit: int, overlap: tuple[int, int], size: int) -> DataFrame:
    """split_oversized for texts of several ranges."""
    spark = docs.sparkSession
    back, tail = size // 2 + 4 * HALO, 4
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    raw = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("raw"))
    part = raw.select("row", "doc_id", "raw", F.explode(F.sequence(F.lit(0), F.expr(f"(octet_length(raw) - 1) div {size}"))).alias("no"))
    begin = F.greatest(F.lit(0), F.col("no") * size - back)
    # Offsets count bytes; begin is where the halo starts, and a few bytes more show the character behind.
    part = part.select("row", "doc_id", F.col("no").cast("int").alias("no"), begin.cast("int").alias("begin"), F.substring("raw", begin + 1, (F.col("no") + 1) * size + tail - begin).alias("raw"))
    # A number is given: ranges are small in bytes and long in work.
    ranges = cut(part.repartition(tasks, "row", "no"))

    def breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, no, at, raw_ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                place = no * size - at
                found = last_break(raw_[max(0, place - size // 2) : place])
                rows.append((row, no, 0 if no == 0 else None if found is None else at + max(0, place - size // 2) + found, at + aligned(raw_, place)))
            yield _batch(rows, _BREAK_ROWS)

    table = cut(ranges.select("row", "no", "begin", "raw").mapInArrow(breaks, _ddl(_BREAK_ROWS)))
    w = Window.partitionBy("row").orderBy("no")
    known = table.withColumn("run", F.count("at").over(w))
    # Every JOINED-th place without a boundary is cut where it is.
    nth = F.row_number().over(Window.partitionBy("row", "run").orderBy("no")) - 1
    start = F.coalesce("at", F.when(nth % JOINED == 0, F.col("forced")))
    known = known.withColumn("start", start).select("row", "no", "start")
    known = known.withColumn("range_no", (F.count("start").over(w) - 1).cast("int"))
    heads = known.where("start IS NOT NULL").select("row", "range_no", "start", F.lead("start").over(Window.partitionBy("row").orderBy("range_no")).alias("stop"))
    placed = known.select("row", "no", "range_no").join(heads, ["row", "range_no"])
    grouped = ranges.join(placed, ["row", "no"]).repartition(tasks, "row", "range_no").groupBy("row", "range_no")

    def in_range(group: pa.Table) -> pa.Table:
        bpe = loaded(body.value)
        group = group.sort_by("no")
        row, doc, no, start, stop = (group[c][0].as_py() for c in ("row", "doc_id", "range_no", "start", "stop"))
        begin_, joined = group["begin"][0].as_py(), bytearray()
        for at, raw_ in zip(group["begin"].to_pylist(), group["raw"].to_pylist(), strict=True):
            joined[at - begin_ :] = raw_
        stop = begin_ + len(joined) if stop is None else stop
        low, mid, end = aligned(joined, 0), start - begin_, stop - begin_
        halo = joined[low:mid].decode("utf-8", "replace")[-HALO:]
        core, after = joined[mid:end].decode("utf-8", "replace"), joined[end : end + tail].decode("utf-8", "ignore")[:1]
        total, h = own_tokens(bpe, core, after), len(halo)
        rows = [(row, doc, no, i, a - h, b - h, n, o, total, len(core), (halo + core)[a:b]) for i, (a, b, n, o) in enumerate(pieces(bpe, halo + core, h, limit, overlap))] if core else []
        return pa.Table.from_batches([_batch(rows, _PARTS)])

    parts = cut(grouped.applyInArrow(in_range, _ddl(_PARTS)))
    sums = parts.groupBy("row", "range_no").agg(F.count(F.lit(1)).alias("n"), F.first("range_tokens").alias("tokens"), F.first("range_chars").alias("chars"))
    w = Window.partitionBy("row").orderBy("range_no")
    stitched = sums.select(
        "row",
        "range_no",
        (F.sum("n").over(w) - F.col("n")).cast("int").alias("before"),
        (F.sum("chars").over(w) - F.col("chars")).alias("shift"),
        F.sum("tokens").over(Window.partitionBy("row")).cast("long").alias("doc_tokens"),
    ).where(F.col("doc_tokens") > limit)
    out = parts.join(stitched, ["row", "range_no"])
    place = [(F.col("piece_no") + F.col("before")).cast("int").alias("piece_no"), *((F.col(c) + F.col("shift")).alias(c) for c in ("char_start", "char_end"))]
    return out.select("doc_id", *place, "n_tokens", "overlap_tokens", "doc_tokens", "text")


_OUT = {"doc_id": "bigint", "piece_no": "int", "char_start": "bigint", "char_end": "bigint", "n_tokens": "int", "overlap_tokens": "int", "doc_tokens": "bigint", "text": "string"}
_BREAK_ROWS = {"row": "bigint", "no": "int", "at": "bigint", "forced": "bigint"}
_PARTS = {"row": "bigint", "doc_id": "bigint", "range_no": "int", "piece_no": "int", "char_start": "bigint", "char_end": "bigint", "n_tokens": "int", "overlap_tokens": "int", "range_tokens": "bigint", "range_chars": "bigint", "text": "string"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    arrays = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(a, _ARROW[t]) for a, t in zip(arrays, columns.values(), strict=True)], list(columns))
