from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import VECTORS, day, frame
from pyspark.sql import functions as F

from graphloom.llm import knn
from graphloom.session import checkpoint_root


def clustered(seed, n=1500, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 10):  # every tenth has close neighbors
        x[k + 1 : k + 5] = x[k] + rng.normal(size=(4, dim)) * 0.2
    return x


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def recall(rows, want):
    return np.mean([len(set(r) & set(w)) / len(w) for r, w in zip(rows, want, strict=True)])


def test_factor_one_is_exact_and_less_is_cheaper():
    x = clustered(1)
    want, s = exact(x, 5)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    tree = knn.VpTree(u, leaf=50)
    rows, _, full = tree.search(u, 6, 1.0)
    assert recall(rows, want) > 0.999
    rows, _, spent = tree.search(u, 6, 0.15)
    assert recall(rows, want) >= 0.9 and spent < full
    close = [(i, j) for i in range(len(x)) for j in want[i] if s[i, j] >= 0.9]
    rows, _, spent = tree.search(u, 6, 0.2, 0.9)
    assert np.mean([j in rows[i] for i, j in close]) > 0.99 and spent < 0.5 * full


def table(spark, x, provider="p", **more):
    return [{"uid": f"e:{i:05}", "provider": provider, "vector": [float(v) for v in row], "updated_at": day(1)} | more for i, row in enumerate(x)]


def test_operator_over_shards_equals_brute_force(spark):
    x = clustered(2, 300)
    df = frame(spark, VECTORS, table(spark, x) + table(spark, x[:40], "q"))
    want, s = exact(x, 5)
    got = {}
    for r in knn.most_similar(df, shard_rows=70, query_rows=50).where("provider = 'p'").collect():
        got.setdefault(r["uid"], []).append((r["rank"], r["neighbor"], r["similarity"]))
    assert len(got) == 300
    for i in range(300):
        mine = sorted(got[f"e:{i:05}"])
        assert [n for _, n, _ in mine] == [f"e:{j:05}" for j in want[i]]
        assert np.allclose([v for *_, v in mine], s[i, want[i]], atol=1e-6)
    pairs = {(r["uid_a"], r["uid_b"]) for r in knn.similar_pairs(df.where("provider = 'p'")).collect()}
    assert pairs == {tuple(sorted((f"e:{i:05}", f"e:{j:05}"))) for i in range(300) for j in want[i] if s[i, j] >= 0.9}


def test_what_counts_as_a_vector(spark):
    one, two = [1.0] + [0.0] * 63, [0.9] + [0.1] * 63
    rows = [
        {"uid": "e:a", "provider": "p", "vector": two, "updated_at": day(1)}, {"uid": "e:a", "provider": "p", "vector": one, "updated_at": day(2)},
        {"uid": "e:b", "provider": "p", "vector": one, "updated_at": day(1)}, {"uid": "e:b", "provider": "p", "vector": one, "updated_at": day(1)},
        {"uid": "e:c", "provider": "q", "vector": one, "updated_at": day(1)},
        {"uid": "e:d", "provider": "p", "vector": [0.0] * 64}, {"uid": "e:e", "provider": "p", "vector": []}, {"uid": "e:f", "provider": "p", "vector": [1.0] * 16}, {"uid": "e:g", "provider": "p"},
        {"uid": "e:h", "provider": "p", "vector": [float("nan")] + one[1:]}, {"uid": None, "provider": "p", "vector": one}, {"uid": "e:i", "provider": None, "vector": one},
        {"uid": "e:j", "provider": "p", "vector": one, "updated_at": day(1)}, {"uid": "e:j", "provider": "p", "vector": [], "updated_at": day(2)},
        {"uid": "e:.\\k", "provider": "p", "vector": two, "updated_at": day(1)},
    ]
    df = frame(spark, VECTORS, rows).withColumn("shard", F.lit("x")).withColumn("n", F.lit(1))
    got = {(r["provider"], r["uid"], r["neighbor"]) for r in knn.most_similar(df).collect()}
    assert got == {("p", a, b) for a in ("e:a", "e:b", "e:k") for b in ("e:a", "e:b", "e:k") if a != b}
    assert knn.most_similar(df.limit(0)).count() == 0


def test_many_equal_vectors_keep_k(spark):
    df = frame(spark, VECTORS, table(spark, np.ones((40, 64))))
    got = knn.most_similar(df, shard_rows=15, query_rows=15).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s")).collect()
    assert {r["n"] for r in got} == {5} and min(r["s"] for r in got) == pytest.approx(1)


@pytest.mark.parametrize("least", [None, 0.4])
def test_ties_go_to_the_smaller_uids(least):
    axes = np.eye(64)
    x = np.concatenate([np.ones((300, 64)), axes[:1], axes[:1] + axes[1:41]])  # equal ones, then different ones of equal cosine
    x = x[np.random.default_rng(4).permutation(len(x))]
    equal, mixed = (np.flatnonzero(m) for m in (x.all(axis=1), (x != 0).sum(axis=1) == 2))
    one = int(np.flatnonzero((x != 0).sum(axis=1) == 1)[0])
    at = np.random.default_rng(5).permutation(len(x))  # rows come in any order
    rows = pa.table({"provider": ["p"] * len(x), "uid": [f"e:{i:05}" for i in at], "vector": [x[i].astype(np.float32) for i in at]})
    got = {}
    for r in knn._search_task(5, 64, 1.0, least)(rows, rows).to_pylist():
        got.setdefault(int(r["uid"][2:]), []).append(int(r["neighbor"][2:]))
    assert all(got[i] == [j for j in equal if j != i][:5] for i in equal)
    assert got[one] == mixed[:5].tolist()
    assert all(got[i] == [one, *[j for j in mixed if j != i][:4]] for i in mixed)


def test_vectors_are_copied_once_however_many_shards_there_are(spark):
    def written(shard_rows, query_rows):
        store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        before = store.executorSummary("driver").totalShuffleWrite()
        rows = knn.most_similar(df, shard_rows=shard_rows, query_rows=query_rows).collect()
        sc.listenerBus().waitUntilEmpty()
        return sorted(rows), store.executorSummary("driver").totalShuffleWrite() - before

    df = frame(spark, VECTORS, table(spark, clustered(3, 600)) + table(spark, clustered(6, 90), "q"))
    few, less = written(600, 600)
    many, more = written(25, 100)  # 24 shards and 6 blocks of p
    assert [r[:3] + r[4:] for r in few] == [r[:3] + r[4:] for r in many]
    assert more < 1.5 * less
    folder = Path(checkpoint_root(spark).removeprefix("file:"))
    assert folder.is_dir() and not list(folder.glob("**/vectors-*"))  # the files are gone


def test_neighbors_of_several_shards_are_merged_with_ties():
    x = np.concatenate([np.ones((30, 64)), np.eye(64)[:1], np.eye(64)[:1] + np.eye(64)[1:41]]).astype(np.float32)
    order = np.random.default_rng(6).permutation(len(x))
    rows = pa.table({"provider": ["p"] * len(x), "uid": [f"e:{i:05}" for i in order], "vector": [x[i] for i in order]})
    search = knn._search_task(5, 64, 1.0, None)
    whole = search(rows, rows).to_pylist()
    assert [(r["uid"], r["neighbor"], r["rank"]) for r in search((rows.slice(i, 9) for i in range(0, len(x), 9)), rows).to_pylist()] == [(r["uid"], r["neighbor"], r["rank"]) for r in whole]
    assert [r["neighbor"] for r in whole if r["uid"] == "e:00000"] == [f"e:{i:05}" for i in range(1, 6)]
