"""Registered queries of merging, walking, searching, vectors, validation, sources, sinks and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.keys import sql_norm_path
from graphloom.operators import contextpack, merge, textsearch, traverse, validate, vector
from graphloom.operators import graphview as V
from graphloom.operators import relational as R
from graphloom.operators.graphview import Graph
from graphloom.plans.relational import _E, _FILEDEPS, _TEXT, HUB, NOW, PROVIDER, _refreshed
from graphloom.session import cut, shared_path
from graphloom.sources import extract, indexer, sinks, tree
from graphloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str = "", recursive: bool = False):
    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql:
            SQL[name] = ("WITH " + "RECURSIVE " * recursive + ", ".join(views) + " " if views else "") + sql
        return f

    return register


# ---- merges and deletions

_HUMAN = "(kind = 'class' AND is_public)"


def _overlay(g: Graph) -> DataFrame:
    """Human rows over the public classes: the incoming side of the merge queries."""
    return g.entities.where((F.col("kind") == "class") & F.col("is_public")).withColumns({"name": F.upper("name"), "source_priority": F.lit(100)})


@query("m01_priority_merge", V.ENT, sql=f"SELECT uid, CASE WHEN {_HUMAN} THEN upper(name) ELSE name END AS name, CASE WHEN {_HUMAN} AND 100 >= source_priority THEN 100 ELSE source_priority END AS source_priority FROM ent")
def m01(g: Graph) -> DataFrame:
    keep = ["uid", "name", "source_priority", "provenance", "created_at"]
    return merge.priority_merge(g.entities.select(*keep), _overlay(g).select(*keep), ["uid"]).select("uid", "name", "source_priority")


@query("m02_bulk_merge", sql=f"SELECT uid, source_priority, updated_at FROM (SELECT {V.sql_norm_uid('uid')} AS uid, source_priority, updated_at, row_number() OVER (PARTITION BY {V.sql_norm_uid('uid')} ORDER BY source_priority DESC, updated_at DESC) AS rn FROM entities WHERE uid IS NOT NULL AND source_priority IS NOT NULL AND updated_at IS NOT NULL) WHERE rn = 1")
def m02(g: Graph) -> DataFrame:
    rows = g.raw("entities").where("uid IS NOT NULL AND source_priority IS NOT NULL AND updated_at IS NOT NULL").select(V.normalize_uid(F.col("uid")).alias("uid"), "source_priority", "updated_at")
    return merge.bulk_merge(rows, ["uid"], [F.col("source_priority"), F.col("updated_at")])


@query("m03_relation_merge", V.REL, sql="SELECT from_uid, to_uid, kind, confidence, source_priority FROM rel")
def m03(g: Graph) -> DataFrame:
    return g.relations.select("from_uid", "to_uid", "kind", "confidence", "source_priority")


@query("m05_delete_edges", V.REL, sql=f"SELECT from_uid, to_uid, kind FROM rel WHERE to_uid <> '{HUB}' OR kind <> 'imports'")
def m05(g: Graph) -> DataFrame:
    doomed = g.relations.where((F.col("to_uid") == HUB) & (F.col("kind") == "imports")).select("from_uid", "to_uid", "kind")
    return merge.delete_edges(g.relations.select("from_uid", "to_uid", "kind"), doomed)


@query("m06_cascade_delete", V.ENT, V.REL, sql="SELECT from_uid, to_uid, kind FROM rel WHERE from_uid NOT IN (SELECT uid FROM ent WHERE kind = 'class') AND to_uid NOT IN (SELECT uid FROM ent WHERE kind = 'class')")
def m06(g: Graph) -> DataFrame:
    left = merge.cascade_delete({"entities": g.entities, "relations": g.relations, "vectors": g.vectors}, g.entities.where("kind = 'class'"))
    return left["relations"].select("from_uid", "to_uid", "kind")


_DOOMED = "(SELECT uid FROM ent WHERE source_priority < 100 AND path IN (SELECT path FROM ent WHERE kind = 'route'))"


@query("m07_clear_paths", V.ENT, V.REL, sql=f"SELECT from_uid, to_uid, kind FROM rel WHERE from_uid NOT IN {_DOOMED} AND to_uid NOT IN {_DOOMED}")
def m07(g: Graph) -> DataFrame:
    return merge.clear_paths(g.entities, g.relations, g.entities.where("kind = 'route'").select("path").distinct())[1].select("from_uid", "to_uid", "kind")


@query("m09_rename", V.ENT, V.REL, sql=r"SELECT regexp_replace(from_uid, '^([^:#]*:)([^#]*\.rb)(#|$)', '\1lib/\2\3') AS from_uid, regexp_replace(to_uid, '^([^:#]*:)([^#]*\.rb)(#|$)', '\1lib/\2\3') AS to_uid, kind FROM rel")
def m09(g: Graph) -> DataFrame:
    """Every Ruby file, known or only referred to, moves under lib/."""
    ends = g.relations.select(F.explode(F.array("from_uid", "to_uid")).alias("u")).select(F.regexp_extract("u", "(?s)^[^:#]*:([^#]*)", 1).alias("old"))
    moves = ends.where(F.col("old").endswith(".rb")).distinct().withColumn("new", F.concat(F.lit("lib/"), "old"))
    return merge.rename_paths(g.entities, g.relations, moves)[1].select("from_uid", "to_uid", "kind")


@query("m16_fail_runs", sql=f"SELECT run_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR THEN 'failed' ELSE status END AS status FROM index_runs")
def m16(g: Graph) -> DataFrame:
    runs = g.raw("index_runs")
    return merge.mark_runs_failed(runs, R.abandoned_runs(runs, F.lit(NOW).cast("timestamp_ntz")), "abandoned").select("run_id", "status")


# ---- walks

def _kinds(k: list[str]) -> str:
    return schema.sql_list(k)


_ROOT = "root AS (SELECT from_uid AS uid FROM rel WHERE kind = 'contains' AND from_uid LIKE 'repository:%' GROUP BY from_uid ORDER BY count(*) DESC, from_uid LIMIT 1)"


def _pick(g: Graph) -> str:
    """The target of the impact queries: the entity most depended on, but for the one hub."""
    r = g.relations.where(F.col("kind").isin(schema.IMPACT_KINDS) & (F.col("to_uid") != HUB))
    return r.groupBy("to_uid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "to_uid").first()["to_uid"]


_PICK = f"pick AS (SELECT to_uid AS uid FROM rel WHERE kind IN ({_kinds(schema.IMPACT_KINDS)}) AND to_uid <> '{HUB}' GROUP BY to_uid ORDER BY count(*) DESC, to_uid LIMIT 1)"
_IMPACT = f"seen(uid, depth) USING KEY (uid) AS (SELECT uid, 0 FROM pick UNION SELECT r.from_uid, min(s.depth) + 1 FROM seen s JOIN rel r ON r.to_uid = s.uid LEFT JOIN recurring.seen k ON k.uid = r.from_uid WHERE k.uid IS NULL AND r.kind IN ({_kinds(schema.IMPACT_KINDS)}) GROUP BY r.from_uid)"


@query("g07_impact", V.REL, _PICK, _IMPACT, sql="SELECT uid, min(depth)::INTEGER AS depth FROM seen GROUP BY uid HAVING min(depth) > 0", recursive=True)
def g07(g: Graph) -> DataFrame:
    return traverse.impact(g.relations, _pick(g))


@query(
    "g07_impact_summary", V.ENT, V.REL, _PICK, _IMPACT,
    "hit AS (SELECT s.uid, min(depth) AS depth FROM seen s GROUP BY s.uid HAVING min(depth) > 0)",
    "tot AS (SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(*) FILTER (e.kind = 'test') AS tests, count(*) FILTER (e.kind = 'route') AS routes, count(*) FILTER (e.is_public) AS public, count(DISTINCT e.path) AS files FROM hit LEFT JOIN ent e ON e.uid = hit.uid)",
    sql=f"""SELECT direct, transitive, tests, public, files, (SELECT round(coalesce(greatest(0.1, avg(confidence)), 0.4), 6) FROM rel WHERE to_uid = (SELECT uid FROM pick) AND kind IN ({_kinds(schema.IMPACT_KINDS)})) AS confidence,
  CASE WHEN reasons >= 3 THEN 'high' WHEN reasons >= 1 OR direct > 0 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT *, (tests > 0)::INT + (direct + transitive > 6)::INT + (routes > 0)::INT
  + (coalesce((SELECT max(is_public) FROM ent WHERE uid = (SELECT uid FROM pick)), false) OR EXISTS (SELECT 1 FROM rel WHERE to_uid = (SELECT uid FROM pick) AND kind = 'exports'))::INT AS reasons FROM tot)""",
    recursive=True,
)
def g07s(g: Graph) -> DataFrame:
    return traverse.impact_summary(g.relations, g.entities, _pick(g)).withColumn("confidence", F.round("confidence", 6))


@query("g10_descendants", V.ENT, V.REL, _ROOT, "seen AS (SELECT uid, 0 AS depth FROM root UNION SELECT r.to_uid, s.depth + 1 FROM seen s JOIN rel r ON r.from_uid = s.uid WHERE s.depth < 30 AND r.kind = 'contains')", sql="SELECT uid, min(depth)::INTEGER AS depth FROM seen GROUP BY uid", recursive=True)
def g10(g: Graph) -> DataFrame:
    e = g.relations.where("kind = 'contains'").select(F.col("from_uid").alias("src"), F.col("to_uid").alias("dst"))
    top = e.where("src LIKE 'repository:%'").groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1)
    return traverse.closure(e, top.select(F.col("src").alias("uid")))


@query("g08_path_length", V.REL, _PICK, f"seen AS (SELECT uid, 0 AS depth FROM pick UNION SELECT r.to_uid, s.depth + 1 FROM seen s JOIN rel r ON r.from_uid = s.uid WHERE s.depth < 12 AND r.kind IN ({_kinds(schema.TRAVERSAL_KINDS)}))", sql=f"SELECT coalesce(min(depth), -1)::INTEGER AS steps FROM seen WHERE uid = '{HUB}'", recursive=True)
def g08(g: Graph) -> DataFrame:
    e = g.relations.where(F.col("kind").isin(schema.TRAVERSAL_KINDS)).select(F.col("from_uid").alias("src"), F.col("to_uid").alias("dst"))
    path = traverse.shortest_path(e, _pick(g), HUB)
    return g.spark.createDataFrame([(len(path) - 1,)], "steps int")


@query("g11_two_cycles", V.REL, sql="SELECT DISTINCT a.from_uid AS uid_a, a.to_uid AS uid_b FROM rel a JOIN rel b ON a.from_uid = b.to_uid AND a.to_uid = b.from_uid WHERE a.from_uid < a.to_uid")
def g11(g: Graph) -> DataFrame:
    return traverse.two_cycles(g.relations)


@query("g11_cycles", V.REL, f"link AS (SELECT DISTINCT from_uid AS a, to_uid AS b FROM rel WHERE kind IN ({_kinds(['extends', 'implements', 'imports'])}))", "reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)", sql="SELECT x.a AS uid, min(y.b) AS cycle_uid FROM reach x JOIN reach y ON x.a = y.a JOIN reach z ON z.a = y.b AND z.b = y.a WHERE x.a = x.b GROUP BY x.a", recursive=True)
def g11c(g: Graph) -> DataFrame:
    """Cycles of any length over links of inheritance and import."""
    return traverse.cycles(g.relations, ["extends", "implements", "imports"])


@query("g07_impact_limits", V.REL, _PICK, _IMPACT, "near AS (SELECT uid, depth FROM seen WHERE depth = 1)", sql="SELECT 'maxDepth' AS reason, count(*) AS n FROM near UNION ALL SELECT 'maxNodes', 9 UNION ALL SELECT 'none', count(*) FROM seen WHERE depth > 0", recursive=True)
def g07l(g: Graph) -> DataFrame:
    """What stops a walk of dependents: a depth of one, ten nodes with the target, nothing."""
    out = []
    for limits in ({"max_depth": 1}, {"max_nodes": 10}, {}):
        rows, reason = traverse.impact_within(g.relations, _pick(g), **limits)
        out.append(rows.agg(F.lit(reason or "none").alias("reason"), F.count(F.lit(1)).alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("g12_levels", V.REL, "link AS (SELECT DISTINCT from_uid, to_uid FROM rel WHERE kind IN ('extends', 'implements') AND from_uid < to_uid)", "node AS (SELECT from_uid AS uid FROM link UNION SELECT to_uid FROM link)", "up AS (SELECT uid, 0 AS level FROM node UNION SELECT l.to_uid, u.level + 1 FROM up u JOIN link l ON l.from_uid = u.uid)", sql="SELECT uid, max(level)::INTEGER AS level FROM up GROUP BY uid", recursive=True)
def g12(g: Graph) -> DataFrame:
    """Levels of inheritance links that go upward by uid, which no cycle does."""
    e = g.relations.where(F.col("kind").isin("extends", "implements") & (F.col("from_uid") < F.col("to_uid"))).select(F.col("from_uid").alias("src"), F.col("to_uid").alias("dst"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("uid"))
    return traverse.levels(e, nodes)


@query(
    "g14_incremental", V.ENT, V.REL, _FILEDEPS,
    "seen AS (SELECT DISTINCT path, 0 AS depth FROM ent WHERE kind = 'route' UNION SELECT f.from_path, s.depth + 1 FROM seen s JOIN filedeps f ON f.to_path = s.path WHERE s.depth < 3)",
    sql="SELECT path, depth FROM (SELECT path, min(depth)::INTEGER AS depth FROM seen GROUP BY path HAVING min(depth) > 0 ORDER BY 2, 1 LIMIT 256)", recursive=True,
)
def g14(g: Graph) -> DataFrame:
    return traverse.reverse_dependents(R.file_dependencies(g.relations, g.entities), g.entities.where("kind = 'route'").select("path").distinct())


@query("g02_neighborhood")
def g02(g: Graph) -> DataFrame:
    """The budgeted walk from the impact target, as rows: what was accepted, in order."""
    hood = traverse.neighborhood(g.entities, g.relations, _pick(g), traverse.Budget(depth=2, nodes=60, edges=80))
    rows = [("entity", e["uid"], None, e["depth"]) for e in hood["entities"]] + [("relation", r["from_uid"], r["to_uid"], None) for r in hood["relations"]]
    return g.spark.createDataFrame(rows, "event string, uid string, other string, depth int")


@query("g15_context_pack")
def g15(g: Graph) -> DataFrame:
    pack = contextpack.build(g.entities, g.relations, g.raw("source_files"), "refresh the cursor", "minimal", 4000)
    return g.spark.createDataFrame([(e["uid"], float(e["contextRank"]), contextpack.estimate(pack)) for e in pack["entities"]], "uid string, rank double, tokens int")


# ---- search

_SEARCH = r"lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g'))"
_TOKENS = "list_filter(string_split_regex(trim(" + _SEARCH + "), '\\s+'), lambda t: t <> '')"
_POST = f"post AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest({_TOKENS.format("concat_ws(' ', name, signature, path, description, docstring, array_to_string(tags, ' '))")}) AS term FROM ent) GROUP BY ALL)"


@query("v02_tokens", V.ENT, sql=f"SELECT uid, array_to_string({_TOKENS.format('name')}, ' ') AS tokens FROM ent WHERE name IS NOT NULL")
def v02(g: Graph) -> DataFrame:
    return g.entities.where(F.col("name").isNotNull()).select("uid", F.array_join(textsearch.tokens(F.col("name")), " ").alias("tokens"))


@query("v03_postings", V.ENT, _POST, sql="SELECT * FROM post")
def v03(g: Graph) -> DataFrame:
    return textsearch.postings(g.entities)


@query(
    "o01_bm25", V.ENT, _POST,
    "len AS (SELECT uid, sum(tf) AS dl FROM post GROUP BY uid)", "tot AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM len)",
    "hit AS (SELECT * FROM post WHERE term IN ('refresh', 'cursor', 'token'))", "df AS (SELECT term, count(*) AS df FROM hit GROUP BY term)",
    sql="""SELECT uid, score FROM (SELECT h.uid, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM hit h JOIN df USING (term) JOIN len USING (uid), tot GROUP BY h.uid ORDER BY score DESC, uid LIMIT 100)""",
)
def o01(g: Graph) -> DataFrame:
    return textsearch.bm25(textsearch.postings(g.entities), "refreshCursor token", 100)


@query("v04_hybrid_search")
def v04(g: Graph) -> DataFrame:
    q = g.vectors.where((F.col("provider") == PROVIDER) & (F.size("vector") == 64)).orderBy("uid").limit(1).select(F.col("vector").alias("q"))
    sim = g.vectors.where(F.col("provider") == PROVIDER).crossJoin(F.broadcast(q)).select("uid", vector.cosine(F.col("vector"), F.col("q")).alias("similarity"))
    return textsearch.hybrid_search(g.entities, g.relations, "refresh the cursor", 50, sim)


@query("v04_lexical", V.ENT, sql=f"""SELECT uid, round(least(1.0, 0.55 * (contains(t, 'seal')::INT + contains(t, 'channel')::INT) / 2 + CASE WHEN n = 'seal channel' THEN 0.35 ELSE 0 END + CASE WHEN contains(p, 'seal channel') THEN 0.2 ELSE 0 END + CASE WHEN contains(s, 'seal channel') THEN 0.1 ELSE 0 END), 6) AS score
FROM (SELECT uid, {_SEARCH.format("concat_ws(' ', name, signature, description, docstring)")} AS t, trim({_SEARCH.format("coalesce(name, '')")}) AS n, trim({_SEARCH.format("coalesce(path, '')")}) AS p, trim({_SEARCH.format("coalesce(signature, '')")}) AS s FROM ent)""")
def v04l(g: Graph) -> DataFrame:
    text = textsearch.searchable(F.concat_ws(" ", *textsearch.FIELDS))
    return g.entities.select("uid", F.round(textsearch.lexical_score("sealChannel", F.col("name"), F.col("path"), F.col("signature"), text), 6).alias("score"))


# ---- vectors

_V64 = f"v64 AS (SELECT uid, r.v AS v FROM vec WHERE provider = '{PROVIDER}' AND len(r.v) = 64)"


def _v64(g: Graph) -> DataFrame:
    return g.vectors.where((F.col("provider") == PROVIDER) & (F.size("vector") == 64)).select("uid", "vector")


@query("v05_unit", V.VEC, _V64, sql="SELECT uid, round(sqrt(list_sum(list_transform(v, lambda x: x * x))) , 4) AS norm FROM v64")
def v05(g: Graph) -> DataFrame:
    """The norms of the vectors, by which unit() divides."""
    return _v64(g).select("uid", F.round(F.sqrt(vector.dot(F.col("vector"), F.col("vector"))), 4).alias("norm"))


def _sql_bucket(family: int) -> str:
    bits = []
    for b in range(schema.LSH_BITS):
        signs = ", ".join(f"{vector.projection_sign(family, b, d)}.0" for d in range(64))
        bits.append(f"CASE WHEN list_inner_product(v, [{signs}]::DOUBLE[]) >= 0 THEN '1' ELSE '0' END")
    return f"'f{family}:' || " + " || ".join(bits)


@query("v07_bucket_keys", V.VEC, _V64, sql=f"SELECT uid, {_sql_bucket(0)} AS key0, {_sql_bucket(3)} AS key3 FROM v64")
def v07(g: Graph) -> DataFrame:
    k = vector.bucket_keys(F.col("vector"), 64)
    return _v64(g).select("uid", F.element_at(k, 1).alias("key0"), F.element_at(k, 4).alias("key3"))


@query("v08_probe_keys", V.VEC, _V64, sql=f"SELECT uid, unnest(list_concat([k], list_transform(range(1, 13), lambda i: 'f0:' || substr(k, 4, i - 1) || CASE WHEN substr(k, 3 + i, 1) = '1' THEN '0' ELSE '1' END || substr(k, 4 + i)))) AS key FROM (SELECT uid, {_sql_bucket(0)} AS k FROM v64)")
def v08(g: Graph) -> DataFrame:
    return _v64(g).select("uid", F.explode(vector.probe_keys(F.element_at(vector.bucket_keys(F.col("vector"), 64, families=1), 1))).alias("key"))


@query("v09_cosine_topk", V.VEC, _V64, "q AS (SELECT v AS qv FROM v64 ORDER BY uid LIMIT 1)", sql="SELECT uid, similarity FROM (SELECT uid, round(CASE WHEN list_inner_product(v, v) > 0 THEN list_cosine_similarity(v, qv) ELSE 0 END, 6) AS similarity FROM v64, q) WHERE similarity > 0 ORDER BY similarity DESC, uid LIMIT 20")
def v09(g: Graph) -> DataFrame:
    q = _v64(g).orderBy("uid").first()["vector"]
    return vector.top_k(_v64(g), F.array(*[F.lit(float(x)) for x in q]), 20)


@query("v10_ann_recall")
def v10(g: Graph) -> DataFrame:
    """query, found, exact: those of the index's ten among the ten nearest, for every vector whose uid's hash ends a hundred."""
    v = cut(_v64(g))
    asks = cut(v.where(F.pmod(F.xxhash64("uid"), F.lit(100)) == 0))
    cand = vector.ann_top_k(v, asks, 64, 10).select("query", "uid")
    near = vector.nearest(v, asks, 64, 10)
    return near.join(cand.withColumn("hit", F.lit(1)), ["query", "uid"], "left").groupBy("query").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("exact"))


@query("v12_mock_vector", V.ENT, sql="SELECT uid, round(('0x' || substr(h, 1, 2))::INTEGER / 255 * 2 - 1, 6) AS first, round(('0x' || substr(h, 31, 2))::INTEGER / 255 * 2 - 1, 6) AS last FROM (SELECT uid, sha256(name) AS h FROM ent WHERE name IS NOT NULL)")
def v12(g: Graph) -> DataFrame:
    v = vector.mock_vector(F.col("name"))
    return g.entities.where(F.col("name").isNotNull()).select("uid", F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, 16), 6).alias("last"))


@query("v14_stale_vectors", V.ENT, V.VEC, sql=f"SELECT uid, sha256({_TEXT}) AS content_hash FROM ent e WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.uid = e.uid AND v.provider = '{PROVIDER}' AND (e.kind = 'function' OR v.r.h = sha256({_TEXT})))")
def v14(g: Graph) -> DataFrame:
    return vector.stale_vectors(g.entities, _refreshed(g), PROVIDER, R.semantic_text()).select("uid", "content_hash")


# ---- validation

_PRESENT = f"present AS (SELECT DISTINCT {sql_norm_path('path')} AS path, sha256(content) AS h FROM source_files WHERE content IS NOT NULL)"


def _present(g: Graph) -> DataFrame:
    s = g.raw("source_files").where(F.col("content").isNotNull())
    return s.select(V.normalize_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("content_hash")).distinct()


def _issues(g: Graph) -> DataFrame:
    return validate.issues(g.entities, g.relations, g.unresolved, g.files, _present(g), low=0.55)


_ISSUES = """issues AS (
  SELECT 'missing_file' AS kind, 'error' AS severity, f.path AS subject FROM files f LEFT JOIN present p ON p.path = f.path WHERE p.h IS NULL
  UNION ALL SELECT 'stale_hash', 'warning', f.path FROM files f JOIN present p ON p.path = f.path WHERE p.h <> f.r.content_hash
  UNION ALL SELECT 'dangling_relation', 'error', from_uid || ' ' || kind || ' ' || to_uid FROM rel WHERE from_uid NOT IN (SELECT uid FROM ent) OR to_uid NOT IN (SELECT uid FROM ent)
  UNION ALL SELECT 'orphan_entity', 'info', uid FROM ent WHERE kind NOT IN ('repository', 'directory', 'file') AND uid NOT IN (SELECT to_uid FROM rel WHERE kind <> 'contains')
  UNION ALL SELECT 'low_confidence', 'warning', from_uid || ' ' || kind || ' ' || to_uid FROM rel WHERE kind IN ('imports', 'depends_on', 'calls') AND confidence < 0.55
  UNION ALL SELECT 'unresolved_reference', 'warning', concat_ws(' ', path, symbol) FROM unres WHERE NOT coalesce(resolved, false))"""


@query("c01_issues", V.ENT, V.REL, V.FILES, V.UNRES, _PRESENT, _ISSUES, sql="SELECT kind, severity, subject FROM issues")
def c01(g: Graph) -> DataFrame:
    return _issues(g).select("kind", "severity", "subject")


@query("c02_summary", V.ENT, V.REL, V.FILES, V.UNRES, _PRESENT, _ISSUES, sql="SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info FROM issues")
def c02(g: Graph) -> DataFrame:
    return validate.summary(_issues(g))


@query("c03_repair_plan", V.ENT, V.REL, V.FILES, V.UNRES, _PRESENT, _ISSUES, sql=f"SELECT kind, CASE kind {' '.join(f"WHEN '{k}' THEN '{a}'" for k, a in validate.ACTIONS.items())} END AS action, CASE WHEN kind IN ('orphan_entity', 'low_confidence') THEN 'skipped' ELSE 'planned' END AS status, count(*) AS n FROM issues GROUP BY ALL")
def c03(g: Graph) -> DataFrame:
    return validate.repair_plan(_issues(g)).groupBy("kind", "action", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c04_doctor", V.ENT, V.FILES, V.UNRES, V.VEC,
    sql=f"""SELECT 'orphan_hashes' AS "check", count(*) AS n FROM files WHERE 'file:' || path NOT IN (SELECT uid FROM ent)
UNION ALL SELECT 'orphan_vectors', count(*) FROM vec WHERE uid NOT IN (SELECT uid FROM ent)
UNION ALL SELECT 'unresolved_without_file', count(DISTINCT path) FROM unres WHERE NOT coalesce(resolved, false) AND path IS NOT NULL AND 'file:' || path NOT IN (SELECT uid FROM ent)
UNION ALL SELECT 'abandoned_runs', count(*) FROM index_runs WHERE status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR
UNION ALL SELECT 'repeated_uids', count(*) FROM (SELECT uid FROM ent GROUP BY uid HAVING count(*) > 1)
UNION ALL SELECT 'corrupt_metadata', count(*) FROM ent WHERE metadata IS NOT NULL AND NOT json_valid(metadata)""",
)
def c04(g: Graph) -> DataFrame:
    return validate.doctor(g.entities, g.unresolved, g.files, g.vectors, g.raw("index_runs"), F.lit(NOW).cast("timestamp_ntz"))


# ---- sources, sinks, context, streams

@query("s11_language_routing", V.FILES, sql=r"SELECT path, CASE WHEN regexp_matches(lower(path), '\.(ts|tsx|js|jsx|mjs|cjs)$') THEN 'typescript' WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.rs' OR regexp_matches(path, '(^|/)Cargo\.toml$') THEN 'rust' WHEN lower(path) LIKE '%.rb' OR regexp_matches(path, '(^|/)Gemfile(\.lock)?$') THEN 'ruby' END AS language FROM files")
def s11(g: Graph) -> DataFrame:
    return g.files.select("path", tree.language_of(F.col("path")).alias("language"))


@query("s09_text_class", sql="SELECT path, CASE WHEN contains(substr(content, 1, 4096), chr(0)) THEN 'binary' ELSE 'text' END AS text_class FROM (SELECT DISTINCT path, content FROM source_files WHERE content IS NOT NULL)")
def s09(g: Graph) -> DataFrame:
    s = g.raw("source_files").where(F.col("content").isNotNull()).select("path", "content").distinct()
    return s.select("path", validate.text_class(F.col("content").cast("binary")).alias("text_class"))


_VERSIONS = f"""src AS (SELECT {sql_norm_path('path')} AS path, coalesce(content, '') AS content FROM source_files WHERE path IS NOT NULL),
one AS (SELECT path, min(sha256(content)) AS h FROM src WHERE path NOT LIKE '%.rb' GROUP BY path),
two AS (SELECT CASE WHEN path LIKE '%.rs' THEN 'moved/' || path ELSE path END AS path, min(sha256(CASE WHEN path LIKE '%.ts' THEN content || ' ' ELSE content END)) AS h FROM src WHERE path NOT LIKE '%.py' OR path LIKE '%e%.py' GROUP BY 1),
gone AS (SELECT path, h FROM one WHERE path NOT IN (SELECT path FROM two)), born AS (SELECT path, h FROM two WHERE path NOT IN (SELECT path FROM one)),
ren AS (SELECT count(*) AS n FROM (SELECT h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM gone) a JOIN (SELECT h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM born) b USING (h, k)),
todo AS (SELECT count(*) AS n FROM two LEFT JOIN one USING (path) WHERE one.h IS NULL OR one.h <> two.h)"""


@query(
    "c06_index_runs", _VERSIONS,
    sql="""SELECT 0 AS run, count(*) AS total, count(*) AS indexed, 0 AS cached, 0 AS deleted, 0 AS renamed FROM one
UNION ALL SELECT 1, (SELECT count(*) FROM two), todo.n, (SELECT count(*) FROM two) - todo.n, (SELECT count(*) FROM gone) - ren.n, ren.n FROM todo, ren
UNION ALL SELECT 2, (SELECT count(*) FROM two), 0, (SELECT count(*) FROM two), 0, 0""",
)
def c06(g: Graph) -> DataFrame:
    """Three runs of the index: without Ruby files; then with them, Rust moved, TypeScript edited and a part of Python gone; then unchanged."""
    index = indexer.Indexer(g.spark, shared_path(g.spark, "index"))
    s = g.raw("source_files").select(V.normalize_path(F.col("path")).alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    p = F.col("path")
    two = s.where(~p.endswith(".py") | p.like("%e%.py")).select(F.when(p.endswith(".rs"), F.concat(F.lit("moved/"), p)).otherwise(p).alias("path"), F.when(p.endswith(".ts"), F.concat("content", F.lit(" "))).otherwise(F.col("content")).alias("content"))
    runs = [index.run(f) for f in (s.where(~p.endswith(".rb")), two, two)]
    return g.spark.createDataFrame([(r.number, r.total, r.indexed, r.cached, r.deleted, r.renamed) for r in runs], "run int, total bigint, indexed bigint, cached bigint, deleted bigint, renamed bigint")


@query("s12_extract")
def s12(g: Graph) -> DataFrame:
    """record, kind, source, n: what the four extractors find in all source files."""
    return extract.extract(g.raw("source_files")).groupBy("record", "kind", "source").agg(F.count(F.lit(1)).alias("n"))


@query("j11_canonical_imports")
def j11(g: Graph) -> DataFrame:
    """path, to_uid of the extracted imports, resolved to files that exist where they can be."""
    s = g.raw("source_files")
    found = extract.extract(s).where("record = 'relation' AND kind = 'imports'")
    return extract.canonical_relations(found, s.select(V.normalize_path(F.col("path")).alias("path"))).select("path", "to_uid")


@query("j12_calls_in_files")
def j12(g: Graph) -> DataFrame:
    """from_uid, to_uid of calls bound to a function of the same file."""
    return extract.extract(g.raw("source_files")).where("record = 'relation' AND kind = 'calls'").select("from_uid", "to_uid")


@query("h16_markers", sql=f"SELECT DISTINCT path, i AS line, regexp_extract(l, '@uid\\s+((?:obj|func)-[0-9a-f]{{8}})\\b', 1) AS marker FROM (SELECT path, unnest(string_split_regex(content, '\\r\\n|\\n|\\r')) AS l, generate_subscripts(string_split_regex(content, '\\r\\n|\\n|\\r'), 1)::INTEGER AS i FROM (SELECT path, CASE WHEN path LIKE '%.rs' THEN 'x' || chr(10) || '// @uid func-' || left(sha1(path), 8) || chr(10) || content ELSE content END AS content FROM source_files WHERE content IS NOT NULL)) WHERE regexp_matches(l, '@uid\\s+(?:obj|func)-[0-9a-f]{{8}}\\b')")
def h16(g: Graph) -> DataFrame:
    """With a marker put into the second line of Rust files."""
    s = g.raw("source_files").where(F.col("content").isNotNull())
    marked = F.concat(F.lit("x\n// @uid func-"), F.left(F.sha1("path"), F.lit(8)), F.lit("\n"), "content")
    return extract.markers(s.withColumn("content", F.when(F.col("path").endswith(".rs"), marked).otherwise(F.col("content")))).distinct()


@query("k03_review_lines", V.ENT, V.REL, sql="SELECT 2 AS section, from_uid || ' --' || kind || '--> ' || to_uid AS line FROM rel UNION ALL SELECT 1, uid || ' [' || kind || '] | name=' || coalesce(name, '') || ' | path=' || coalesce(path, '') FROM ent")
def k03(g: Graph) -> DataFrame:
    """Without the confidence, whose two decimals engines round differently."""
    return sinks.review_lines(g.entities, g.relations).withColumn("line", F.regexp_replace("line", r" \| confidence=[0-9.]+$", ""))


@query("k04_protocol", V.ENT, V.REL, sql="""SELECT e.uid, coalesce(description, docstring, signature, kind || ' ' || name) AS purpose, (SELECT count(DISTINCT r.to_uid) FROM rel r JOIN ent t ON t.uid = r.to_uid WHERE r.from_uid = e.uid AND r.kind IN ('imports', 'depends_on', 'calls', 'uses')) AS n_imports, (SELECT count(DISTINCT r.to_uid) FROM rel r JOIN ent t ON t.uid = r.to_uid WHERE r.from_uid = e.uid AND r.kind = 'exports') AS n_shared FROM ent e""")
def k04(g: Graph) -> DataFrame:
    return sinks.protocol_bodies(g.entities, g.relations).select("uid", "purpose", F.size("imports").cast("long").alias("n_imports"), F.size("shared").cast("long").alias("n_shared"))


@query("k02_jsonl_round_trip", V.ENT, V.REL, sql="SELECT 'entities' AS name, count(*) AS rows FROM ent UNION ALL SELECT 'relations', count(*) FROM rel")
def k02(g: Graph) -> DataFrame:
    return sinks.write_jsonl(shared_path(g.spark, "export"), {"entities": g.entities.select(*_E), "relations": g.relations.select("from_uid", "to_uid", "kind")})


@query("k07_marker_plan", V.ENT, sql=f"SELECT DISTINCT e.path, e.start_line AS line FROM ent e JOIN source_files s ON {sql_norm_path('s.path')} = e.path WHERE e.start_line IS NOT NULL AND e.kind NOT IN ('repository', 'directory', 'file', 'module') AND s.content IS NOT NULL")
def k07(g: Graph) -> DataFrame:
    s = g.raw("source_files").select(V.normalize_path(F.col("path")).alias("path"), "content")
    return sinks.marker_plan(g.entities, s).select("path", "line").distinct()


@query("g17_code_slices", V.ENT, "rng AS (SELECT path, greatest(1, min(start_line) - 3) AS a, max(coalesce(end_line, start_line)) + 3 AS b FROM ent WHERE path IS NOT NULL AND start_line IS NOT NULL GROUP BY path)", sql=f"SELECT r.path, a AS first_line, b AS last_line, md5(array_to_string(string_split_regex(content, '\\r\\n|\\n|\\r')[a:b], chr(10))) AS code FROM rng r JOIN (SELECT DISTINCT {sql_norm_path('path')} AS path, content FROM source_files WHERE content IS NOT NULL) s ON s.path = r.path")
def g17(g: Graph) -> DataFrame:
    s = g.raw("source_files").where(F.col("content").isNotNull()).select(V.normalize_path(F.col("path")).alias("path"), "content")
    return contextpack.slices(s, g.entities).withColumn("code", F.md5("code"))


@query("g16_rerank", V.ENT, V.REL, sql=f"""SELECT uid, round(0.45 * s + 0.2 * coalesce(g, 0), 4) AS rank FROM (SELECT uid, confidence AS s FROM ent WHERE confidence IS NOT NULL) LEFT JOIN (SELECT unnest([from_uid, to_uid]) AS gu, least(1.0, (100 * coalesce(weight, confidence) + 10 * confidence + CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in schema.EDGE_WEIGHT.items())} ELSE 0 END) / 200) AS g0 FROM rel) ON gu = uid GROUP BY uid, s, g""".replace("round(0.45 * s + 0.2 * coalesce(g, 0), 4) AS rank", "round(0.45 * s + 0.2 * coalesce(max(g0), 0), 4) AS rank").replace("GROUP BY uid, s, g", "GROUP BY uid, s"))
def g16(g: Graph) -> DataFrame:
    """With the confidence in place of a search score."""
    return contextpack.rerank(g.entities.where(F.col("confidence").isNotNull()).select("uid", F.col("confidence").alias("score")), R.graph_scores(g.relations))


@query("t01_event_windows", sql="SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t01(g: Graph) -> DataFrame:
    return watch.windowed_counts(g.raw("events")).withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("t01_event_stream")
def t01s(g: Graph) -> DataFrame:
    """The same windows as a stream over the event files, drained."""
    events = g.spark.read.parquet(f"{g.folder}/events.parquet")
    staged = shared_path(g.spark, "events")
    events.write.parquet(staged)
    stream = g.spark.readStream.schema(events.schema).parquet(staged)
    name = "events_" + staged.rsplit("-", 1)[1]
    return watch.drain(watch.windowed_counts(stream, late="30 days"), name, "complete", shared_path(g.spark, "offsets"))


@query("t02_listing_watch", sql=f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT {sql_norm_path('path')} AS path, max(content_hash) AS h FROM file_hashes WHERE run_id <= 12 GROUP BY 1) o FULL JOIN (SELECT {sql_norm_path('path')} AS path, max(content_hash) AS h FROM file_hashes WHERE run_id <= 24 GROUP BY 1) n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h")
def t02(g: Graph) -> DataFrame:
    """Two ticks over listings at two runs; the changes of the second."""
    limits, out = iter([12, 24]), {}

    def listing() -> DataFrame:
        return g.raw("file_hashes").where(F.col("run_id") <= next(limits)).groupBy(V.normalize_path(F.col("path")).alias("path")).agg(F.max("content_hash").alias("state"))

    def handle(changes: DataFrame, n: int) -> None:
        changes.write.parquet(out.setdefault(n, shared_path(g.spark, "changes")))

    w = watch.Watcher(g.spark, shared_path(g.spark, "watch"), listing, handle)
    w.tick()
    return g.spark.read.parquet(out[w.tick()])
