import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import leakage

WORDS = [f"w{i}x" for i in range(4000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


FORMS = {
    "plain": lambda w: " ".join(w),
    "upper": lambda w: " ".join(w).upper(),
    "comment": lambda w: "\n".join(f"// {a}," for a in w),
    "html": lambda w: "<p>" + "&nbsp;".join(f"<b>{a}</b>&#44;" for a in w) + "</p>",
    "json": lambda w: "\\u0020".join(w),
    "newlines": lambda w: "\\n".join(w),
    "wide": lambda w: " ".join("".join(chr(ord(c) + 0xFEE0) for c in a) for a in w),
    "hidden": lambda w: " ".join(a[:2] + "​" + a[2:] for a in w),
    "marked": lambda w: " ".join(f"**{a}**" if i % 2 else f"_{a}_" for i, a in enumerate(w)),
    "percent": lambda w: "%20".join(w),
}


FORMS |= {
    "braced": lambda w: "\\u{20}".join(w),
    "octal": lambda w: "\\040".join(w),
    "long tag": lambda w: " ".join(f'<a\n href="{"q" * 500}"\n title=\'x y\'>{a}</a>' for a in w),
    "long comment": lambda w: "<!-- " + " ".join(w) + " " + "z " * 2000 + "-->",
    "character data": lambda w: "<x><![CDATA[" + " ".join(w) + "]]></x>",
    "commands": lambda w: " ".join(f"\\textbf{{{a}}}" for a in w),
    "twice escaped": lambda w: "&amp;nbsp;".join(w) + "&lt;b&gt;",
}


def edit_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(row[-1], most + 1)


def pairs_of(docs, items, n=12, edits=1):
    """The pairs that signatures and verification give, without Spark."""
    walks, _ = leakage.measured(n, leakage.SAMPLES, edits, 0.95)
    plan, known = leakage.Walks(n, leakage.SAMPLES, walks), leakage.Passages(leakage.least_run(n, edits))
    table = {}
    for i, x in items:
        w = leakage.Words([x])
        for s in plan.signatures(w.hash, w.windows(n)).ravel().tolist():
            table.setdefault(s, set()).add((i, x))
    split = lambda t: known.get(t, lambda: (w := leakage.Words([t])).at(0, len(w.start)))
    out = {}
    words = leakage.Words(docs)
    first = words.windows(n)
    sig = plan.signatures(words.hash, first)
    on = np.array([[x in table for x in r] for r in sig.tolist()]) if sig.size else np.zeros(sig.shape, bool)
    hit, low = np.flatnonzero(on.any(axis=0)), 0
    for d, a, b, high in leakage.stretches(words, first, hit, n, 2 * edits):
        some, low = hit[low:high], high
        stretch = " ".join(words.at(a, b - a))
        for i, x in {p for s in sig[:, some].ravel().tolist() for p in table.get(s, ())}:
            ((far, run),) = leakage.verify([(split(stretch), split(x))], n, edits)
            if far <= edits:
                was = out.get((d, i), (99, 0))
                out[d, i] = min(was[0], far), max(was[1], run)
    return out


def whole(docs, items, n=12):
    return {p for p, (_, run) in pairs_of(docs, items, n).items() if run >= n}


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_a_passage(form):
    rng = random.Random(form)
    item = text(rng, 40)
    w = item.split()
    around = lambda body: text(rng, 30) + ".\n" + body + "\n" + text(rng, 30)
    assert whole([around(FORMS[form](w[5:17])), around(FORMS[form](w[5:16])), ""], [(7, item)]) == {(0, 7)}


def test_escape_before_a_letter_that_is_a_digit_too():
    assert leakage.normalize("one\\u0020a two\\u0020bad") == "one a two bad"


def test_against_brute_force():
    rng = random.Random(1)
    few = WORDS[:9]
    items = [(i, " ".join(rng.choice(few) for _ in range(30))) for i in range(40)] + [(99, "too short")]
    docs = [" ".join(rng.choice(few) for _ in range(rng.randrange(5, 60))) for _ in range(80)] + [items[3][1][10:] + " tail", items[5][1]]
    want = set()
    for d, t in enumerate(docs):
        have = {tuple(t.split()[i : i + 6]) for i in range(len(t.split()) - 5)}
        want |= {(d, i) for i, x in items if any(tuple(x.split()[k : k + 6]) in have for k in range(len(x.split()) - 5))}
    assert whole(docs, items, 6) == want


def test_verification_against_brute_force():
    rng = random.Random(4)
    n, most = 6, 1
    known = leakage.Passages(leakage.least_run(n, most))
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(4, 14))] for _ in range(2))
        far = min((edit_distance(b[w : w + n], a[i:j], most) for w in range(len(b) - n + 1) for i in range(len(a)) for j in range(i, len(a) + 1)), default=most + 1)
        run = max((k for k in range(1, 14) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)
        m = leakage.least_run(n, most)
        ((got, longest),) = leakage.verify([(known.get("a" + " ".join(a), lambda a=a: a), known.get("b" + " ".join(b), lambda b=b: b))], n, most)
        assert (got, longest) == (far, run if run >= m else 0)


def test_edits_reach_the_recall():
    rng = random.Random(2)
    items = [(i, text(rng, 12)) for i in range(300)]
    docs = []
    for k, (_, x) in enumerate(items):
        w, at = x.split(), rng.randrange(2, 10)
        w[at : at + 1] = [["changed"], [], ["put", w[at]]][k % 3]
        docs.append(text(rng, 4) + " " + " ".join(w) + " " + text(rng, 4))
    found = pairs_of(docs, items)
    assert len(found) >= 0.93 * len(items) and all(a == b and v[0] == 1 for (a, b), v in found.items())
    assert leakage.measured(12, leakage.SAMPLES, 1, 0.95)[1] >= 0.95


def test_operator(spark):
    rng = random.Random(3)
    a, b = text(rng, 20), text(rng, 20)
    docs = [(1, "x " + a), (1, "x " + a), (2, a + " and " + b), (3, None), (4, ""), (5, text(rng, 50))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("?"))
    i = spark.createDataFrame([(10, a), (11, b), (12, a), (13, None), (10, a)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = {(1, 10), (1, 12), (2, 10), (2, 12), (2, 11)}
    got = [tuple(r) for r in leakage.leaked_items(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaked_items(d, i.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), i).count() == 0


def test_filter_lets_every_signature_through(spark):
    rng = np.random.default_rng(1)
    sig = rng.integers(-(2**63), 2**63, 5000)
    for most in (leakage.FILTER_MOST, 1 << 12):
        old, leakage.FILTER_MOST = leakage.FILTER_MOST, most
        try:
            bits, body = leakage.signature_filter(spark.createDataFrame([(int(x),) for x in sig], "sig long"))
        finally:
            leakage.FILTER_MOST = old
        body = np.frombuffer(body, np.uint8)
        assert bits <= most and len(leakage.passing(sig.view(np.uint64), bits, body)) == len(sig)
    other = rng.integers(-(2**63), 2**63, 5000).view(np.uint64)
    bits, body = leakage.signature_filter(spark.createDataFrame([(int(x),) for x in sig], "sig long"))
    assert len(leakage.passing(other, bits, np.frombuffer(body, np.uint8))) < 50


def test_a_long_stretch_is_cut_and_nothing_is_lost():
    rng = random.Random(8)
    item = text(rng, 40)
    doc = " ".join([item] * 30)
    assert whole([doc], [(1, item)]) == {(0, 1)}
