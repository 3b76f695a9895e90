import random

import numpy as np
import pandas as pd
import pytest
from helpers import RELATIONS, edge, frame
from pyspark.sql import functions as F

from graphloom.operators import hierarchy as H


def contains(spark, pairs):
    return frame(spark, RELATIONS, [edge(a, b, "contains", id=i) for i, (a, b) in enumerate(pairs)])


def brute(pairs):
    """Cycle nodes by reachability, and path and descendants of the rest."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    nodes = {x for p in pairs for x in p}

    def reach(n):
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        return seen

    on = {n for n in nodes if n in reach(n)}
    up = {}
    for a, b in pairs:
        if b not in on:
            up[b] = min(a, up.get(b, a))
    path = {}
    for n in nodes:
        p = [n]
        while p[-1] in up:
            p.append(up[p[-1]])
        path[n] = p[::-1]
    return on, path


def random_pairs(seed, n=60):
    rng = random.Random(seed)
    pairs = {(f"n:{rng.randrange(i)}", f"n:{i}") for i in range(1, n)}
    for _ in range(rng.randrange(6)):
        pairs.add((f"n:{rng.randrange(n)}", f"n:{rng.randrange(n)}"))
    return sorted(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pairs = random_pairs(seed)
    on, path = brute(pairs)
    r = contains(spark, pairs + pairs[:5])
    assert {x["uid"] for x in H.cycle_uids(r).collect()} == on
    for arcs, rows in ((1 << 20, 1 << 16), (20, 16)):
        got = H.hierarchy(r, local_arcs=arcs, sweep_rows=rows).collect()
        assert {x["uid"]: x["path"] for x in got} == path
        below = {u: sum(u in p[:-1] for p in path.values()) for u in path}
        assert {x["uid"]: x["n_descendants"] for x in got} == below
        for x in got:
            assert x["depth"] == len(x["path"]) - 1 and x["root_uid"] == x["path"][0]
            assert x["status"] == ("on_cycle" if x["uid"] in on else "below_cycle" if x["root_uid"] in on else "tree")


def test_distributed_components_equal_local_ones(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("e", "f"), ("r", "a"), ("f", "g")]
    r = contains(spark, [("k:" + a, "k:" + b) for a, b in pairs])
    local = {(x["uid"], x["cycle_uid"]) for x in H.cycle_uids(r).collect()}
    for most in (0, 3):
        assert local == {(x["uid"], x["cycle_uid"]) for x in H.cycle_uids(r, local=most).collect()}
    assert {u for u, _ in local} == {"k:a", "k:b", "k:c", "k:d", "k:e", "k:x"}


def test_long_chains_and_cycles_are_spliced(spark):
    pairs = [(f"n:{i:04}", f"n:{i + 1:04}") for i in range(300)] + [(f"c:{i:03}", f"c:{(i + 1) % 90:03}") for i in range(90)] + [("c:005", "n:0100"), ("d:1", "d:2"), ("d:2", "d:1"), ("d:2", "c:000")]
    r = contains(spark, pairs)
    _, edges = H.encode(H.links(r))
    core, n, spliced = H.peel(edges, 0)
    assert len(spliced) < 40 and n == core.count() < 12
    for local in (0, 20):
        assert {x["uid"]: x["cycle_uid"] for x in H.cycle_uids(r, local=local).collect()} == {f"c:{i:03}": "c:000" for i in range(90)} | {"d:1": "d:1", "d:2": "d:1"}


def test_trees_between_cycles_are_folded(spark):
    down = [(f"d:{i // 2:02}", f"d:{i:02}") for i in range(2, 64)]
    up = [(f"u:{i:02}", f"u:{i // 2:02}") for i in range(2, 64)]
    pairs = [*down, *up, *((f"d:{i}", f"u:{i}") for i in range(32, 64)), ("u:01", "d:01"), ("u:02", "u:02"), ("x:1", "d:05"), ("u:07", "x:2")]
    r = contains(spark, pairs)
    _, edges = H.encode(H.links(r))
    assert H.peel(edges.where("src <> dst"), 0)[1] < 12
    want = {x: "d:01" for p in pairs for x in p if x[0] != "x"}
    assert {x["uid"]: x["cycle_uid"] for x in H.cycle_uids(r, local=0).collect()} == want


def test_sizes_estimated_in_a_loop_stay_small(spark):
    df = H.cut(spark.range(3).withColumn("cycle", F.col("id")))
    for _ in range(6):
        before, after = df.withColumnRenamed("id", "before"), df.withColumnRenamed("id", "after")
        df = H.cut(df.unionByName(before.join(after, "cycle").select(F.col("before").alias("id"), "cycle")).distinct())
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert {(x["id"], x["cycle"]) for x in df.collect()} == {(i, i) for i in range(3)}


def test_stretches_of_a_range():
    x, nxt = np.array([1, 2, 3, 7, 8, 9]), np.array([2, 7, 50, 8, 9, -1])
    at, dist, first = H._chains(x, nxt)
    assert x[at].tolist() == [8, 8, 3, 8, 8, 9] and dist.tolist() == [3, 2, 0, 1, 0, 0] and first.tolist() == [True, False, True, False, False, True]
    got = pd.concat(H._contract(iter([pd.DataFrame({"arc": x, "next": nxt})]))).set_index("arc")
    assert got["next"].tolist() == [9, 9, 50, 9, 9, -1] and got["dist"].tolist() == [4, 3, 1, 2, 1, 0] and got["stays"].tolist() == [True, False, True, False, False, True]


def test_spellings_repeats_nulls_and_other_kinds(spark):
    rows = [edge("file:.\\a", "file:b", "contains", id=1), edge("file:b", "file:./a", "contains", id=2), edge(None, "file:b", "contains", id=3), edge("file:c", "file:c", "calls", id=4), edge("file:b", "file:./a", "contains", id=2)]
    assert {x["uid"] for x in H.cycle_uids(frame(spark, RELATIONS, rows)).collect()} == {"file:a", "file:b"}


def test_empty(spark):
    r = frame(spark, RELATIONS, [])
    assert H.cycle_uids(r).count() == 0
    assert H.hierarchy(r).count() == 0


def test_deep_chain_and_wide_parent(spark):
    pairs = [(f"n:{i:04}", f"n:{i + 1:04}") for i in range(150)] + [("n:0000", f"w:{i:04}") for i in range(400)]
    got = {x["uid"]: x for x in H.hierarchy(contains(spark, pairs), local_arcs=200, sweep_rows=64).collect()}
    assert got["n:0150"]["depth"] == 150 and got["n:0000"]["n_descendants"] == 550 and got["w:0399"]["path"] == ["n:0000", "w:0399"]


def test_local_ranking():
    arcs = pd.DataFrame({"arc": [5, 1, 9, 4, 7], "next": [1, 9, -1, 7, -1], "dist": [1, 1, 1, 2, 1]})
    got = pd.concat(H._rank_local(iter([arcs]))).set_index("arc")
    assert got.loc[[5, 1, 9, 4, 7], "rank"].tolist() == [2, 1, 0, 2, 0]
    assert got.loc[[5, 4], "last"].tolist() == [9, 7]
    assert list(H._rank_local(iter([]))) == [] and np.array_equal(got.index, [1, 4, 5, 7, 9])


def below(pairs):
    """(node, node below it) to the fewest links between them, no link into a cycle being followed."""
    on, _ = brute(pairs)
    out = {}
    for a, b in pairs:
        if b not in on:
            out.setdefault(a, set()).add(b)
    got = {}
    for n in {x for p in pairs for x in p}:
        front, steps = {n}, 0
        while front:
            steps += 1
            front = {y for x in front for y in out.get(x, ()) if (n, y) not in got}
            got |= {(n, y): steps for y in front}
    return got


@pytest.mark.parametrize("pairs", [random_pairs(2), [*random_pairs(3, 40), *((f"n:{i}", f"n:{j}") for i, j in ((1, 20), (20, 30), (5, 39), (30, 39), (2, 20), (0, 39)))], [("a:1", "a:2"), ("a:2", "a:3"), ("a:3", "a:4"), ("b:1", "a:4"), ("b:1", "b:2"), ("b:2", "a:2"), ("a:4", "c:1"), ("a:1", "c:1"), ("z:1", "z:2"), ("z:2", "z:1"), ("z:1", "c:1")]])
def test_descendants_over_all_parents(spark, pairs):
    r, want = contains(spark, pairs), below(pairs)
    for arcs, rows in ((1 << 20, 1 << 16), (20, 16)):
        got = [((x["uid"], x["descendant"]), x["distance"]) for x in H.descendants(r, local_arcs=arcs, sweep_rows=rows).collect()]
        assert len(got) == len(want) and dict(got) == want
    count = {x["uid"]: x["n_descendants"] for x in H.full_hierarchy(r).collect()}
    assert count == {n: sum(a == n for a, _ in want) for n in {x for p in pairs for x in p}}
