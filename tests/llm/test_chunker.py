import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, chunker

BPE = bpe.Bpe(open(bpe.DEFAULT_VOCABULARY, "rb").read())


def total(text):
    return int(BPE.counts(text)[1].sum())


def check(text, found, halo=0, limit=512):
    assert found[-1][1] == len(text)
    before = None
    for a, b, n, o in found:
        assert a < b and n <= limit and n == len(BPE.encode_batch([text[a:b]])[0])
        if before is None:
            assert a <= halo
        else:
            assert a < before < b and 32 <= o <= 64
        before = b


def prose(seed, n):
    rng = random.Random(seed)
    words = "the cursor moves to a later page while callers wait for one more row".split()
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 18))) + rng.choice([". ", ".\n", ".\n\n", "! ", "? ", "\r\n", "。"]))
    return "".join(out)


@pytest.mark.parametrize("text", [prose(1, 400), prose(2, 90), "a" * 6000, "あ漢字" * 1500, "🙂👩‍💻" * 900, " " * 90000, "\n" * 4000, "x " * 3000, "".join(random.Random(3).choice("abcdefgh") for _ in range(9000))])
def test_pieces_cover_fit_and_overlap(text):
    if total(text) > 512:
        check(text, chunker.pieces(BPE, text))


def test_pieces_end_at_paragraphs():
    text = ("one two three four five. " * 30 + "\n\n") * 12
    found = chunker.pieces(BPE, text)
    assert all(text[:b].endswith("\n\n") for _, b, _, _ in found)
    only = "word word word word word. " * 400
    assert all(only[b - 1] == "." for _, b, _, _ in chunker.pieces(BPE, only)[:-1])


def test_breaks_are_certain_boundaries():
    for text in (prose(5, 900), prose(6, 50) * 30):
        raw = text.encode()
        for at in range(1500, len(raw), 997):
            found = chunker.last_break(raw[at - 1000 : at])
            cut = len(raw[: at - 1000 + found].decode())
            assert chunker.own_tokens(BPE, text[:cut], text[cut : cut + 1]) + total(text[cut:]) == total(text)
    assert chunker.last_break(("é" * 500).encode()[1:]) is None


def test_long_texts_of_all_kinds(spark):
    texts = {1: prose(7, 800), 2: "x" * 9000 + " end. " + prose(8, 100), 3: "漢字かな。" * 3000, 4: "🙂" * 5000, 5: prose(9, 60) + "y" * 70_000 + "\n" + prose(10, 60), 6: " " * 30_000, 7: "é" * 2100}
    got = chunker.split_oversized(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=4000).collect()
    for doc, text in texts.items():
        mine = sorted((r["piece_no"], r["char_start"], r["char_end"], r["n_tokens"], r["text"], r["doc_tokens"]) for r in got if r["doc_id"] == doc)
        if total(text) <= 512:
            assert not mine
            continue
        assert [x[0] for x in mine] == list(range(len(mine))) and mine[0][1] == 0 and mine[-1][2] == len(text)
        assert all(x[4] == text[x[1] : x[2]] and x[3] <= 512 and x[3] == len(BPE.encode_batch([x[4]])[0]) for x in mine)
        assert all(x[1] < y[1] < x[2] < y[2] for x, y in zip(mine, mine[1:], strict=False))
        if doc in (1, 2, 7):  # the others hold unbroken runs of more than JOINED ranges
            assert mine[0][5] == total(text)


def test_operator_stitches_ranges(spark):
    long_, mid, short = prose(7, 1500), prose(8, 120), "short. "
    rows = [(1, long_), (2, mid), (3, short), (4, None), (5, ""), (6, " \n "), (1, long_)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("piece_no", F.lit(2))
    got = chunker.split_oversized(df, size=4000).collect()
    assert {r["doc_id"] for r in got} == {1, 2}
    for doc, text, times in ((1, long_, 2), (2, mid, 1)):
        mine = sorted((r["piece_no"], r["char_start"], r["char_end"], r["n_tokens"], r["overlap_tokens"], r["text"]) for r in got if r["doc_id"] == doc)
        one = mine[::times]
        assert mine[:: times] == one and len(mine) == times * len(one)
        assert [x[0] for x in one] == list(range(len(one)))
        assert one[0][1] == 0 and one[-1][2] == len(text)
        for x, y in zip(one, one[1:], strict=False):
            assert x[1] < y[1] < x[2] < y[2]
        assert all(x[5] == text[x[1] : x[2]] and x[3] <= 512 for x in one)
        assert {r["doc_tokens"] for r in got if r["doc_id"] == doc} == {total(text)}
    assert chunker.split_oversized(df.limit(0)).count() == 0
