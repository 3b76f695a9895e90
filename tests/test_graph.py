"""Replays of small graphs: impact, walks, search, packs, joins, merges, validation."""

from types import SimpleNamespace

import pytest
from helpers import ENTITIES, FILES, RELATIONS, SOURCES, UNRESOLVED, edge, entity, frame
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import contextpack, merge, textsearch, traverse, validate, vector
from graphloom.operators import relational as R
from graphloom.operators.graphview import Graph, current_entities, merged_relations
from graphloom.plans import graph

CALC, INVOICE, ROUTE, TEST = "function:src/billing/calc.ts#calculate", "file:src/billing/invoice.ts", "route:src/api/invoices.ts#/invoices", "test:src/billing/calc.test.ts"


@pytest.fixture(scope="module")
def billing(spark):
    e = frame(spark, ENTITIES, [entity(CALC), entity(INVOICE), entity(ROUTE), entity(TEST)])
    r = frame(spark, RELATIONS, [edge(INVOICE, CALC, "calls"), edge(ROUTE, INVOICE, "depends_on"), edge(TEST, CALC, "tests", 1.0)])
    return current_entities(e).cache(), merged_relations(r).cache()


def test_impact(billing):
    e, r = billing
    assert {(x["uid"], x["depth"]) for x in traverse.impact(r, CALC).collect()} == {(INVOICE, 1), (TEST, 1), (ROUTE, 2)}
    assert {x["uid"] for x in traverse.impact(r, CALC, 1).collect()} == {INVOICE, TEST}
    s = traverse.impact_summary(r, e, CALC).first()
    assert (s["direct"], s["transitive"], s["tests"]) == (2, 1, 1) and abs(s["confidence"] - 0.95) < 1e-9
    nothing = traverse.impact_summary(r, e, ROUTE).first()
    assert (nothing["direct"], nothing["confidence"], nothing["risk"]) == (0, 0.4, "low")
    assert s["risk"] == "medium"  # a test and a route
    public = e.withColumn("is_public", F.col("uid") == CALC)
    assert traverse.impact_summary(r, public, CALC).first()["risk"] == "high"


def test_impact_limits_and_their_reasons(billing):
    _, r = billing
    for limits, n, reason in (({}, 3, None), ({"max_depth": 1}, 2, "maxDepth"), ({"max_depth": 2}, 3, None), ({"max_nodes": 2}, 1, "maxNodes"), ({"max_relations": 1}, 1, "maxRelations"), ({"seconds": 0}, 0, "timeout")):
        rows, why = traverse.impact_within(r, CALC, **limits)
        assert (rows.count(), why) == (n, reason), limits


def test_cycles_of_any_length(spark):
    u = [f"file:{c}" for c in "abcdef"]
    _, r = small(spark, u, [edge(u[0], u[1], "imports"), edge(u[1], u[2], "calls"), edge(u[2], u[0], "imports"), edge(u[2], u[3], "imports"), edge(u[4], u[5], "uses"), edge(u[5], u[4], "contains")])
    assert {(x["uid"], x["cycle_uid"]) for x in traverse.cycles(r).collect()} == {(x, u[0]) for x in u[:3]}


def test_impact_has_no_depth_of_its_own(spark):
    u = [f"file:{i:02}" for i in range(14)]
    e, r = small(spark, u, [edge(b, a, "depends_on") for a, b in zip(u, u[1:], strict=False)])
    want = {(x, i) for i, x in enumerate(u) if i}
    assert {(x["uid"], x["depth"]) for x in traverse.impact(r, u[0]).collect()} == want
    assert {(x["uid"], x["depth"]) for x in graph.g07(SimpleNamespace(relations=r)).collect()} == want
    assert graph.g07s(SimpleNamespace(relations=r, entities=e)).first()["transitive"] == 12


def small(spark, uids, edges):
    return current_entities(frame(spark, ENTITIES, [entity(u) for u in uids])), merged_relations(frame(spark, RELATIONS, edges))


def test_walk_of_a_ring(spark):
    u = [f"file:{c}" for c in "abc"]
    e, r = small(spark, u, [edge(u[i], u[(i + 1) % 3], "depends_on") for i in range(3)])
    hood = traverse.neighborhood(e, r, u[0], traverse.Budget(depth=3))
    assert len(hood["entities"]) == 3 and len(hood["relations"]) == 3


def test_walk_takes_the_best_edges_first(spark):
    u = ["file:root", "file:weak", "file:dependency", "file:direct"]
    e, r = small(spark, u, [edge(u[0], u[1], "imports", 0.7, weight=0.2), edge(u[0], u[2], "depends_on", 0.9, weight=0.85), edge(u[0], u[3], "calls", 1.0, weight=0.95)])
    p = r.select("kind", R.edge_priority(F.col("kind"), F.col("weight"), F.col("confidence")).alias("p"))
    assert {x["kind"]: round(x["p"], 6) for x in p.collect()} == {"imports": 97, "depends_on": 169, "calls": 195}
    hood = traverse.neighborhood(e, r, u[0], traverse.Budget(depth=1, nodes=3, edges=2))
    assert [x["uid"] for x in hood["entities"]] == [u[0], u[3], u[2]]
    assert [x["to_uid"] for x in hood["relations"]] == [u[3], u[2]]


@pytest.mark.parametrize(("budget", "reason"), [({"edges": 1}, "maxRelations"), ({"nodes": 2, "depth": 2}, "maxNodes"), ({}, "maxDepth"), ({"seconds": 0}, "timeout")])
def test_walk_says_why_it_stopped(spark, budget, reason):
    u = ["file:root", "file:first", "file:second"]
    e, r = small(spark, u, [edge(u[0], u[1], "calls"), edge(u[0], u[2], "calls")])
    hood = traverse.neighborhood(e, r, u[0], traverse.Budget(**budget), clock=lambda: 0.0)
    assert hood["truncated"] and hood["reason"] == reason


def test_walk_budgets_that_skip(spark):
    u = ["file:root", "file:child"]
    e, r = small(spark, u, [edge(u[0], u[1], "calls")])
    assert [x["uid"] for x in traverse.neighborhood(e, r, u[0], traverse.Budget(files=1))["entities"]] == [u[0]]
    assert traverse.neighborhood(e, r, u[0], traverse.Budget(tokens=1)) == {"entities": [], "relations": [], "truncated": False, "reason": None}


def test_unbounded_walk_equals_the_closure(billing):
    e, r = billing
    hood = traverse.neighborhood(e, r, CALC, traverse.Budget(depth=9, nodes=99, edges=99))
    both = r.select(F.col("from_uid").alias("src"), F.col("to_uid").alias("dst")).unionByName(r.select(F.col("to_uid").alias("src"), F.col("from_uid").alias("dst")))
    reached = traverse.closure(both, e.where(F.col("uid") == CALC).select("uid"), 9)
    assert {x["uid"] for x in hood["entities"]} == {x["uid"] for x in reached.collect()}


def test_paths_levels_order(spark):
    u = [f"file:{c}" for c in "abcd"]
    e, r = small(spark, u, [edge(u[0], u[1], "calls"), edge(u[1], u[2], "calls"), edge(u[0], u[3], "calls"), edge(u[3], u[2], "calls")])
    edges = r.select(F.col("from_uid").alias("src"), F.col("to_uid").alias("dst"))
    assert traverse.shortest_path(edges, u[0], u[2]) == [u[0], u[1], u[2]]
    assert traverse.shortest_path(edges, u[2], u[0]) == [] and traverse.shortest_path(edges, u[0], u[0]) == [u[0]]
    assert {x["uid"]: x["level"] for x in traverse.levels(edges, e.select("uid")).collect()} == {u[0]: 0, u[1]: 1, u[3]: 1, u[2]: 2}
    rows = [{"uid": "app"}, {"uid": "service"}]
    assert [x["uid"] for x in traverse.edit_order(rows, [{"from_uid": "app", "to_uid": "service", "kind": "depends_on"}])] == ["service", "app"]


def test_search_scores(spark):
    e = current_entities(frame(spark, ENTITIES, [entity("function:src/user.ts#createUser", description="create a user"), entity("function:src/session.ts#createUserSession", description="create a user session")]))
    r = merged_relations(frame(spark, RELATIONS, []))
    got = [(x["uid"].split("#")[1], x["score"]) for x in textsearch.hybrid_search(e, r, "create user", 2).collect()]
    assert got == [("createUser", round(0.9 * 0.85 * 0.65, 6)), ("createUserSession", round(0.55 * 0.85 * 0.65, 6))]
    assert textsearch.hybrid_search(e, r, "", 5).count() == 0
    assert textsearch.bm25(textsearch.postings(e), "session", 5).first()["uid"].endswith("Session")


def test_neighbors_bring_results(spark):
    e = current_entities(frame(spark, ENTITIES, [entity("function:a.ts#login"), entity("function:b.ts#createToken"), entity("file:b.ts")]))
    r = merged_relations(frame(spark, RELATIONS, [edge("function:a.ts#login", "function:b.ts#createToken", "calls")]))
    assert {x["uid"].split("#")[-1] for x in textsearch.hybrid_search(e, r, "token", 5).collect()} == {"login", "createToken"}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0] * 8, [1.0] * 8), ([0.0] * 8, [1.0] * 8), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    keys = df.limit(1).select(vector.bucket_keys(F.col("a"), 8)).first()[0]
    assert len(keys) == 4 and all(k[:3] == f"f{i}:" and len(k) == 15 for i, k in enumerate(keys))
    probes = spark.createDataFrame([("f0:000000000000",)], "k string").select(vector.probe_keys(F.col("k"))).first()[0]
    assert len(set(probes)) == 13 and sorted(p.count("1") for p in probes) == [0] + [1] * 12
    near = spark.createDataFrame([("alpha", [1.0] * 8), ("beta", [1.0] * 7 + [0.9]), ("gamma", [-1.0] * 8)], "uid string, vector array<double>")
    assert [x["uid"] for x in vector.top_k(near, F.array(*[F.lit(1.0)] * 8), 3).collect()] == ["alpha", "beta"]


def test_orphans_dangling_dependencies(spark):
    e, r = small(spark, ["file:a.ts", "file:b.ts", "function:a.ts#linked", "function:a.ts#orphan", "function:b.ts#caller"], [edge("file:a.ts", "function:a.ts#orphan", "contains"), edge("function:b.ts#caller", "function:a.ts#linked", "calls", 0.8), edge("file:b.ts", "file:a.ts", "imports"), edge("file:b.ts", "file:zz.ts", "imports")])
    assert {x["uid"].split("#")[1] for x in R.orphans(e, r).collect()} == {"orphan", "caller"}
    assert [(x["to_uid"], x["from_missing"], x["to_missing"]) for x in R.dangling(r, e).collect()] == [("file:zz.ts", False, True)]
    deps = R.file_dependencies(r, e)
    assert {(x["from_path"], x["to_path"], x["kind"]) for x in deps.collect()} == {("b.ts", "a.ts", "calls"), ("b.ts", "a.ts", "imports"), ("b.ts", "zz.ts", "imports")}
    assert [x["path"] for x in R.reverse_files(deps, spark.createDataFrame([("a.ts",)], "path string")).collect()] == ["b.ts"]


def test_priority_merge_keeps_the_stronger(spark):
    old = current_entities(frame(spark, ENTITIES, [entity("file:a", name="ast", provenance=[("ast", "t", None, 1.0, None)]), entity("file:b", name="human", source_priority=100)]))
    new = current_entities(frame(spark, ENTITIES, [entity("file:a", name="human", source_priority=100, provenance=[("human", "t", None, 1.0, None)]), entity("file:b", name="ast"), entity("file:c", name="new")]))
    got = {x["uid"]: x for x in merge.priority_merge(old, new, ["uid"]).collect()}
    assert {u: x["name"] for u, x in got.items()} == {"file:a": "human", "file:b": "human", "file:c": "new"}
    assert len(got["file:a"]["provenance"]) == 2
    assert len({x["uid"]: x for x in merge.priority_merge(old, new, ["uid"], keep_provenance=False).collect()}["file:a"]["provenance"]) == 1


def test_rename_rewrites_every_uid(spark):
    e, r = small(spark, ["file:old.ts", "function:old.ts#f", "function:x.ts#g"], [edge("function:x.ts#g", "function:old.ts#f", "calls"), edge("file:old.ts", "function:old.ts#f", "contains")])
    e2, r2 = merge.rename_paths(e, r, spark.createDataFrame([("old.ts", "new.ts")], "old string, new string"))
    assert {(x["uid"], x["path"]) for x in e2.collect()} == {("file:new.ts", "new.ts"), ("function:new.ts#f", "new.ts"), ("function:x.ts#g", "x.ts")}
    assert {(x["from_uid"], x["to_uid"]) for x in r2.collect()} == {("function:x.ts#g", "function:new.ts#f"), ("file:new.ts", "function:new.ts#f")}


def test_clear_and_replace(spark):
    e, r = small(spark, ["function:a.ts#f", "function:b.ts#g"], [edge("function:b.ts#g", "function:a.ts#f", "calls")])
    new = current_entities(frame(spark, ENTITIES, [entity("function:a.ts#h")]))
    e2, r2 = merge.replace_files(e, r, new, r.limit(0))
    assert {x["uid"] for x in e2.collect()} == {"function:a.ts#h", "function:b.ts#g"} and r2.count() == 0


def test_validation_and_repair(spark):
    e, r = small(spark, ["file:a.ts", "function:a.ts#f"], [edge("function:a.ts#f", "file:none.ts", "imports", 0.2)])
    u = frame(spark, UNRESOLVED, [{"path": "a.ts", "symbol": "x", "kind": "call"}])
    hashes = spark.createDataFrame([("a.ts", "h1"), ("gone.ts", "h2")], "path string, content_hash string")
    now = spark.createDataFrame([("a.ts", "h9")], "path string, content_hash string")
    found = validate.issues(e, r, u, hashes, now)
    assert sorted(x["kind"] for x in found.collect()) == sorted(["missing_file", "stale_hash", "dangling_relation", "orphan_entity", "low_confidence", "unresolved_reference"])
    assert tuple(validate.summary(found).first()) == (6, 2, 3, 1)
    plan = validate.repair_plan(found)
    assert {x["status"] for x in plan.where("kind in ('orphan_entity', 'low_confidence')").collect()} == {"skipped"}
    after = validate.apply_repairs(plan, e, r, u, hashes)
    assert after["relations"].count() == 0 and after["unresolved"].count() == 0 and after["hashes"].count() == 1 and after["entities"].count() == 2


def test_text_classes(spark):
    rows = [(bytes([0x61, 0, 0x62]), "binary"), (bytes([0xC3, 0x28]), "invalidUtf8"), (b"", "text"), ("é".encode(), "text"), (bytes([1, 2, 3]) + b"abc", "binary"), (b"a\tb\nc\r\n" * 9, "text")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "c binary")
    assert [x[0] for x in df.select(validate.text_class(F.col("c"))).collect()] == [b for _, b in rows]


def test_context_pack_fits_its_budget(spark):
    e = current_entities(frame(spark, ENTITIES, [entity("function:src/auth.ts#login", description="Handles authentication logic", start_line=1, end_line=3), entity("function:src/s.ts#createSession"), entity("function:src/store.ts#saveSession"), entity("test:src/auth.test.ts")]))
    r = merged_relations(frame(spark, RELATIONS, [edge("function:src/auth.ts#login", "function:src/s.ts#createSession", "calls"), edge("function:src/s.ts#createSession", "function:src/store.ts#saveSession", "calls"), edge("test:src/auth.test.ts", "function:src/auth.ts#login", "tests")]))
    s = frame(spark, SOURCES, [{"path": "src/auth.ts", "content": "line\n" * 400}])
    pack = contextpack.build(e, r, s, "authentication login", "balanced", 8000)
    assert "src/store.ts" in pack["files"] and pack["tests"] == ["test:src/auth.test.ts"] and len(pack["relations"]) == 3
    tight = contextpack.build(e, r, s, "authentication login", "balanced", 300)
    assert contextpack.estimate(tight) <= 300


def test_graph_of_a_folder(spark, tmp_path):
    frame(spark, ENTITIES, [entity("file:a"), entity("function:a#f")]).write.parquet(str(tmp_path / "entities.parquet"))
    frame(spark, RELATIONS, [edge("file:a", "function:a#f", "contains")]).write.parquet(str(tmp_path / "relations.parquet"))
    frame(spark, FILES, [{"path": "a", "content_hash": "AB", "run_id": 1}]).write.parquet(str(tmp_path / "file_hashes.parquet"))
    g = Graph(spark, str(tmp_path))
    assert [(x["from_uid"], x["derived"]) for x in g.all_relations.collect()] == [("file:a", False)]
    assert g.contains.count() == 1 and g.files.first()["content_hash"] == "ab"


def test_ann_top_k_ranks_candidates_and_falls_back(spark):
    import math

    near = [(f"n:{i:02}", [math.cos(i / 500), math.sin(i / 500)] * 4) for i in range(13)]  # share their buckets
    rows = [*near, ("z:far", [(-1.0) ** d * (d + 1) for d in range(8)])]  # a bucket of its own
    v = spark.createDataFrame(rows, "uid string, vector array<double>")
    got = {}
    for r in vector.ann_top_k(v, v, 8, 10).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["uid"])
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    assert got["n:00"] == [f"n:{i:02}" for i in range(1, 11)]
    want = sorted(((-cos(rows[-1][1], x), u) for u, x in near if cos(rows[-1][1], x) > 0))[:10]
    assert len(want) == 10 and {u for _, u in want} == set(got["z:far"])


def test_block_search_equals_the_expressions(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows = [(f"v:{i:03}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    rows += [(f"w:{i:03}", rows[i % 3][1]) for i in range(40)]  # ties
    rows += [("x:zero", [0.0] * 8), ("x:short", [1.0] * 7), ("x:null", None), ("x:hole", [1.0, None] * 4), ("x:nan", [float("nan")] * 8), ("x:huge", [1e200] * 8)]
    for name in ("BLOCK_ROWS", "ASK_ROWS", "HELD_ROWS"):
        monkeypatch.setattr(vector, name, 16)
    v = spark.createDataFrame(rows, "uid string, vector array<double>").cache()
    asks = v.where("uid LIKE '%5' OR uid LIKE 'x%' OR uid = 'w:001'")
    pairs = asks.select(F.col("uid").alias("query"), F.col("vector").alias("q")).crossJoin(v).where("query <> uid").select("query", "uid", vector.cosine(F.col("q"), F.col("vector")).alias("similarity"))
    order = lambda rows: {(r["query"], r["rank"], r["uid"], str(r["similarity"] + 0.0)) for r in rows.collect()}
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "uid"))
    assert order(vector.nearest(v, asks, 8, 10)) == order(pairs.withColumn("rank", rank).where("rank <= 10"))
    cand = vector.ann_candidates(v, asks, 8).where("query <> uid").withColumn("n", F.count("uid").over(Window.partitionBy("query")))
    most = pairs.join(cand, ["query", "uid"], "left").withColumn("n", F.coalesce(F.max("n").over(Window.partitionBy("query")), F.lit(0))).join(cand.select("query", "uid", F.lit(1).alias("hit")), ["query", "uid"], "left")
    assert order(vector.ann_top_k(v, asks, 8, 10)) == order(most.where("similarity > 0 AND (hit = 1 OR n < 10)").withColumn("rank", rank).where("rank <= 10"))
    plan = vector.nearest(v, asks, 8, 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan  # no expression for each pair of rows


def test_ann_candidates_probe_every_bit(spark):
    import random

    rng = random.Random(3)
    v = spark.createDataFrame([(f"v:{i:03}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)], "uid string, vector array<double>")
    keys = {r["uid"]: r["k"] for r in v.select("uid", vector.bucket_keys(F.col("vector"), 8).alias("k")).collect()}
    close = lambda a, b: any(sum(x != y for x, y in zip(k, m, strict=True)) <= 1 for k, m in zip(a, b, strict=True))
    want = {(a, b) for a in keys for b in keys if close(keys[a], keys[b])}
    assert {(r["query"], r["uid"]) for r in vector.ann_candidates(v, v, 8).collect()} == want
