import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe, scan

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

BODY = open(bpe.DEFAULT_VOCABULARY, "rb").read()
MINE = bpe.Bpe(BODY)
RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in BODY.splitlines() if x)}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(texts):
    ids, at = MINE.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == (THEIRS.encode_ordinary(t) if t else []), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab'strevlmd \n\t\r1 é-　🙂", max_size=80)), max_size=6))
def test_equals_the_public_library(texts):
    same(texts)


def test_long_runs_and_blanks():
    rng = random.Random(4)
    runs = ["a" * 3000, " " * 700, "\n" * 300, "ab" * 900, "あ漢字" * 400, "-" * 999, "🙂" * 200, "".join(rng.choice("abcdef") for _ in range(5000)), "x" + " " * 65 + "y", "<|endoftext|>"]
    same([*runs, None, "", " ", *reversed(runs)])


def test_heap_and_rounds_agree():
    rng = random.Random(5)
    for _ in range(60):
        w = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(65, 400))).encode()
        assert MINE._heap(w).tolist() == MINE._long(w).tolist()


def test_cache_starts_over(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 5)
    small = bpe.Bpe(BODY)
    for t in ("one two three four five six seven", "eight nine ten", "one two"):
        assert small.encode_batch([t])[0].tolist() == THEIRS.encode_ordinary(t)


def test_hash_index_and_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    index = scan.HashIndex(8)
    for part in np.array_split(keys, 7):
        assert (index.get(part) == -1).all()
        index.add(part)
    assert index.get(keys).tolist() == list(range(len(keys)))
    assert (index.get(keys + np.uint64(1)) >= 0).sum() <= np.isin(keys + np.uint64(1), keys).sum()


def test_range_hash_tells_ranges_apart():
    cp = scan.points("abcabcabd" * 50)
    h = scan.RangeHash(cp)
    a = h.of(np.array([0, 3, 6, 0]), np.array([3, 6, 9, 4]))
    assert a[0] == a[1] != a[2] and a[0] != a[3]


def test_operator(spark):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (4, "Hello world", 9), (4, "Hello world", 9), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("lang", F.lit("en"))
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in bpe.encode_documents(df).collect()))
    hello = THEIRS.encode_ordinary("Hello world")
    assert got == [(0, [87]), (1, hello), (2, []), (3, []), (4, hello), (4, hello)]
    assert bpe.encode_documents(df.limit(0)).count() == 0
