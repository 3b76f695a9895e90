"""Registered queries of the relational operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import graphview as V
from graphloom.operators import relational as R
from graphloom.operators.graphview import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The seeds of lookups: the largest hub and two names that every scale has.
HUB = "module:tarnwick/runtime"
PROVIDER = "mock:v1"
NOW = "2025-12-06 04:00:00"


def query(name: str, *views: str, sql: str = ""):
    """Register a query over a Graph, and its SQL over the named views."""

    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql:
            SQL[name] = ("WITH " + ", ".join(views) + " " if views else "") + sql
        return f

    return register


_E = ["uid", "kind", "name", "path"]
_PRIORITY = f"(100 * coalesce(weight, confidence) + 10 * confidence + CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in schema.EDGE_WEIGHT.items())} ELSE 0 END)"


@query("a01_entity_count", V.ENT, sql="SELECT count(*) AS n FROM ent")
def a01(g: Graph) -> DataFrame:
    return g.entities.agg(F.count(F.lit(1)).alias("n"))


@query("a02_counts_by_kind", V.ENT, sql="SELECT kind, count(*) AS n FROM ent WHERE kind <> '' GROUP BY kind")
def a02(g: Graph) -> DataFrame:
    return R.counts_by(g.entities, "kind")


@query("a03_counts_by_language", V.ENT, sql="SELECT language, count(*) AS n FROM ent WHERE language <> '' GROUP BY language")
def a03(g: Graph) -> DataFrame:
    return R.counts_by(g.entities, "language")


@query("a04_vector_counts", V.VEC, sql="SELECT provider, count(*) AS n FROM vec GROUP BY ROLLUP (provider)")
def a04(g: Graph) -> DataFrame:
    return R.vector_counts(g.vectors)


@query("a06_unresolved_count", V.UNRES, sql="SELECT count(*) AS n FROM unres WHERE NOT coalesce(resolved, false)")
def a06(g: Graph) -> DataFrame:
    return g.unresolved.where(~F.coalesce("resolved", F.lit(False))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a07_graph_stats", V.ENT, V.REL, V.CONTAINS, V.UNRES, V.VEC,
    sql="SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM allrel) AS relations, (SELECT count(*) FROM unres WHERE NOT coalesce(resolved, false)) AS unresolved, (SELECT count(*) FROM vec) AS vectors",
)
def a07(g: Graph) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(g.entities, "entities").crossJoin(one(g.all_relations, "relations")).crossJoin(one(g.unresolved.where(~F.coalesce("resolved", F.lit(False))), "unresolved")).crossJoin(one(g.vectors, "vectors"))


_FILEDEPS = f"""filedeps AS (
  SELECT from_path, to_path, kind, max(confidence) AS confidence FROM (
    SELECT coalesce(a.path, CASE WHEN r.from_uid LIKE 'file:%' AND NOT contains(r.from_uid, '#') THEN substr(r.from_uid, 6) END) AS from_path,
      coalesce(b.path, CASE WHEN r.to_uid LIKE 'file:%' AND NOT contains(r.to_uid, '#') THEN substr(r.to_uid, 6) END) AS to_path, r.kind, r.confidence
    FROM rel r LEFT JOIN ent a ON a.uid = r.from_uid LEFT JOIN ent b ON b.uid = r.to_uid WHERE r.kind IN ({schema.sql_list(schema.DEPENDENCY_KINDS)}))
  WHERE from_path IS NOT NULL AND to_path IS NOT NULL AND from_path <> to_path GROUP BY ALL)"""


@query("a08_file_deps", V.ENT, V.REL, _FILEDEPS, sql="SELECT * FROM filedeps")
def a08f(g: Graph) -> DataFrame:
    return R.file_dependencies(g.relations, g.entities)


_SYMBOL = lambda c: f"(contains({c}, '#') OR split_part({c}, ':', 1) NOT IN ('repository', 'directory', 'file'))"


@query("a08_symbol_deps", V.REL, sql=f"SELECT from_uid, to_uid, kind, max(confidence) AS confidence FROM rel WHERE kind IN ({schema.sql_list(schema.DEPENDENCY_KINDS)}) AND {_SYMBOL('from_uid')} AND {_SYMBOL('to_uid')} GROUP BY ALL")
def a08s(g: Graph) -> DataFrame:
    return R.symbol_dependencies(g.relations, g.entities)


_PRIO = "CASE p.source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.SOURCE_PRIORITY.items()) + " ELSE 0 END"


@query("a09_top_priority", V.ENT, sql=f"SELECT uid, coalesce((SELECT max({_PRIO}) FROM unnest(provenance) AS t(p)), 0)::INTEGER AS top FROM ent")
def a09(g: Graph) -> DataFrame:
    return g.entities.select("uid", R.top_priority(F.col("provenance")).alias("top"))


@query("a10_provenance_merge", V.REL, sql="""SELECT from_uid, to_uid, sum(n)::BIGINT AS n FROM (
  SELECT from_uid, to_uid, len(list_distinct(list_transform(flatten(list(provenance)), lambda p: {'s': p.source, 't': p.tool, 'e': p.evidence, 'w': p.timestamp}))) AS n FROM rel WHERE kind IN ('calls', 'uses') GROUP BY from_uid, to_uid) GROUP BY ALL""")
def a10(g: Graph) -> DataFrame:
    """Sizes of the merged provenance of a pair's calls and uses."""
    pick = lambda k: g.relations.where(F.col("kind") == k).select("from_uid", "to_uid", F.col("provenance").alias(k))
    both = pick("calls").join(pick("uses"), ["from_uid", "to_uid"], "full")
    return both.select("from_uid", "to_uid", F.size(R.merge_provenance(F.col("calls"), F.col("uses"))).cast("long").alias("n"))


@query("a14_graph_scores", V.REL, sql=f"SELECT uid, round(max(least(1.0, p / 200)), 6) AS score FROM (SELECT unnest([from_uid, to_uid]) AS uid, {_PRIORITY} AS p FROM rel) GROUP BY uid")
def a14(g: Graph) -> DataFrame:
    return R.graph_scores(g.relations).select("uid", F.round("score", 6).alias("score"))


@query("a15_skip_reasons", sql="""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN content IS NULL OR content = '' THEN 'empty' WHEN size_bytes > 4096 THEN 'tooLarge' WHEN language IS NULL THEN 'unsupported' END AS reason FROM (SELECT DISTINCT path, content, size_bytes, language FROM source_files)) WHERE reason IS NOT NULL GROUP BY reason""")
def a15(g: Graph) -> DataFrame:
    reason = F.when(F.coalesce("content", F.lit("")) == "", "empty").when(F.col("size_bytes") > 4096, "tooLarge").when(F.col("language").isNull(), "unsupported")
    rows = g.raw("source_files").select("path", "content", "size_bytes", "language").distinct()
    return R.counts_by(rows.select(reason.alias("reason")), "reason")


@query("a16_largest_files", V.FILES, sql="SELECT path, r.size_bytes AS size_bytes FROM files ORDER BY r.size_bytes DESC NULLS LAST, path LIMIT 10")
def a16(g: Graph) -> DataFrame:
    return R.keep_newest(g.files.select("path", "size_bytes"), [F.desc_nulls_last("size_bytes"), F.col("path")], 10)


@query("a18_line_ranges", V.ENT, sql="SELECT path, greatest(1, min(start_line) - 3) AS first_line, max(coalesce(end_line, start_line)) + 3 AS last_line FROM ent WHERE path IS NOT NULL AND start_line IS NOT NULL GROUP BY path")
def a18(g: Graph) -> DataFrame:
    return R.line_ranges(g.entities)


@query("a19_coverage", sql=f"""SELECT round(count(*) FILTER (NOT skipped) / count(*), 6) AS coverage FROM (
  SELECT {V.sql_norm_path('path')} AS path, min((coalesce(content, '') = '' OR coalesce(size_bytes > 4096, false) OR language IS NULL)::INT)::BOOLEAN AS skipped FROM source_files WHERE path IS NOT NULL GROUP BY 1)""")
def a19(g: Graph) -> DataFrame:
    """Indexed files out of all, a file being skipped if each of its rows is, for the reasons of a15."""
    skipped = (F.coalesce("content", F.lit("")) == "") | F.coalesce(F.col("size_bytes") > 4096, F.lit(False)) | F.col("language").isNull()
    files = g.raw("source_files").where(F.col("path").isNotNull()).groupBy(V.normalize_path(F.col("path")).alias("path")).agg(F.min(skipped).alias("skipped"))
    return files.agg(F.round(F.try_divide(F.count_if(~F.col("skipped")), F.count(F.lit(1))), 6).alias("coverage"))


@query("a21_percentile", V.REL, sql="SELECT list_sort(list(confidence))[(floor(count(*) * 0.95))::BIGINT + 1] AS value FROM rel WHERE confidence IS NOT NULL")
def a21(g: Graph) -> DataFrame:
    return R.nearest_rank(g.relations, "confidence", 0.95)


@query("g04_edge_priority", V.REL, sql=f"SELECT from_uid, to_uid, kind, round({_PRIORITY}, 6) AS priority FROM rel")
def g04(g: Graph) -> DataFrame:
    p = R.edge_priority(F.col("kind"), F.col("weight"), F.col("confidence"))
    return g.relations.select("from_uid", "to_uid", "kind", F.round(p, 6).alias("priority"))


@query("id_p05_uid_or_path", V.UNRES, sql="SELECT symbol, CASE WHEN contains(symbol, ':') OR regexp_matches(symbol, '^(obj|func)-[0-9a-f]{8}$') THEN symbol ELSE 'file:' || symbol END AS uid FROM unres WHERE symbol IS NOT NULL")
def p05(g: Graph) -> DataFrame:
    return g.unresolved.where(F.col("symbol").isNotNull()).select("symbol", R.by_uid_or_path(F.col("symbol")).alias("uid"))


@query("id_p06_ordered_lookup", V.ENT, V.REL, sql="SELECT r.id AS pos, e.uid, e.kind, e.name FROM rel r JOIN ent e ON e.uid = r.to_uid WHERE r.kind IN ('routes_to', 'tests')")
def p06(g: Graph) -> DataFrame:
    """Uids asked for in the order of relation ids, with repetitions."""
    wanted = g.relations.where("kind IN ('routes_to', 'tests')").select(F.col("id").alias("pos"), F.col("to_uid").alias("uid"))
    return R.lookup_ordered(g.entities, wanted).select("pos", "uid", "kind", "name").orderBy("pos")


@query("id_p07_machine_rows", V.ENT, sql="SELECT uid, kind, name, path FROM ent WHERE source_priority < 100 AND path IS NOT NULL")
def p07(g: Graph) -> DataFrame:
    return g.entities.where((F.col("source_priority") < 100) & F.col("path").isNotNull()).select(*_E)


@query("id_p08_suffix_lookup", V.ENT, "pick AS (SELECT upper(regexp_extract(min(path), '[^/]+$')) AS p FROM ent WHERE kind = 'file')", sql="SELECT uid, kind, name, path FROM ent, pick WHERE path = p OR ends_with(lower(path), '/' || lower(p))")
def p08(g: Graph) -> DataFrame:
    """The last part of the first file's path, in capitals."""
    name = g.entities.where("kind = 'file'").agg(F.min("path")).first()[0].rsplit("/", 1)[-1].upper()
    return R.path_suffix(g.entities, name).select(*_E)


@query("id_p10_incoming", V.ENT, V.REL, V.CONTAINS, sql=f"SELECT from_uid, to_uid, kind, derived FROM allrel WHERE to_uid = '{HUB}'")
def p10(g: Graph) -> DataFrame:
    return g.all_relations.where(F.col("to_uid") == HUB).select("from_uid", "to_uid", "kind", "derived")


@query("id_p11_touching", V.ENT, V.REL, sql="SELECT from_uid, to_uid, kind FROM rel WHERE from_uid IN (SELECT uid FROM ent WHERE kind = 'route') OR to_uid IN (SELECT uid FROM ent WHERE kind = 'route')")
def p11(g: Graph) -> DataFrame:
    return R.touching(g.relations, g.entities.where("kind = 'route'").select("uid")).select("from_uid", "to_uid", "kind")


@query("id_p12_touching_endpoints", V.ENT, V.REL, sql="SELECT uid, kind, name, path FROM ent WHERE uid IN (SELECT unnest([from_uid, to_uid]) FROM rel WHERE from_uid IN (SELECT uid FROM ent WHERE kind = 'route') OR to_uid IN (SELECT uid FROM ent WHERE kind = 'route'))")
def p12(g: Graph) -> DataFrame:
    return R.endpoints_of(R.touching(g.relations, g.entities.where("kind = 'route'").select("uid")), g.entities).select(*_E)


@query("id_p13_low_confidence", V.REL, sql="SELECT from_uid, to_uid, kind, confidence FROM rel WHERE kind IN ('imports', 'depends_on', 'calls') AND confidence < 0.55")
def p13(g: Graph) -> DataFrame:
    """With the threshold at 0.55, since the data holds no critical edge below the default."""
    return R.low_confidence(g.relations, 0.55).select("from_uid", "to_uid", "kind", "confidence")


@query("id_p15_abandoned_runs", sql=f"SELECT run_id, mode, started_at FROM index_runs WHERE status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR")
def p15(g: Graph) -> DataFrame:
    return R.abandoned_runs(g.raw("index_runs"), F.lit(NOW).cast("timestamp_ntz")).select("run_id", "mode", "started_at")


@query("id_p16_corrupt_json", V.ENT, sql="SELECT uid FROM (SELECT uid, CASE WHEN kind = 'method' THEN left(metadata, length(metadata) - 1) ELSE metadata END AS m FROM ent) WHERE m IS NOT NULL AND NOT json_valid(m)")
def p16(g: Graph) -> DataFrame:
    """With the last character of the metadata of methods lost."""
    cut = F.when(F.col("kind") == "method", F.substring("metadata", F.lit(1), F.length("metadata") - 1)).otherwise(F.col("metadata"))
    return R.corrupt_json(g.entities.withColumn("metadata", cut), "metadata").select("uid")


@query("id_p18_unchanged_files", V.FILES, "now AS (SELECT path, r.size_bytes + CASE WHEN path LIKE '%e.%' THEN 1 ELSE 0 END AS size_bytes, r.mtime_ms + CASE WHEN path LIKE '%.ts' THEN 1 ELSE 0 END AS mtime_ms FROM files)", sql="SELECT path FROM files JOIN now USING (path) WHERE files.r.size_bytes = now.size_bytes AND files.r.mtime_ms = now.mtime_ms")
def p18(g: Graph) -> DataFrame:
    """Against a listing in which TypeScript files have another time and some files another size."""
    now = g.files.select("path", (F.col("size_bytes") + F.col("path").like("%e.%").cast("int")).alias("size_bytes"), (F.col("mtime_ms") + F.col("path").endswith(".ts").cast("int")).alias("mtime_ms"))
    return R.unchanged_files(g.files, now)


@query("id_p19_test_paths", V.FILES, sql=r"SELECT path FROM (SELECT regexp_replace(regexp_replace(path, 'e\.py$', 'e_test.py'), '(t\.ts)$', 'x.spec.ts') AS path FROM files) WHERE regexp_matches(path, '/tests?/|\.(test|spec)\.[jt]sx?$|_test\.(py|rs|rb|go)$|_spec\.rb$|(^|/)test_[^/]*\.py$')")
def p19(g: Graph) -> DataFrame:
    """With some Python and TypeScript files renamed to tests."""
    return _tested(g).where(R.is_test_path(F.col("path"))).select("path")


def _tested(g: Graph) -> DataFrame:
    return g.files.select(F.regexp_replace(F.regexp_replace("path", r"e\.py$", "e_test.py"), r"(t\.ts)$", "x.spec.ts").alias("path"))


@query("id_p20_high_signal", V.ENT, V.REL, sql=f"SELECT from_uid, to_uid, kind FROM rel WHERE kind IN ({schema.sql_list(schema.HIGH_SIGNAL_KINDS)}) AND NOT coalesce(is_synthetic, false) AND from_uid NOT IN (SELECT uid FROM ent WHERE kind IN ('file', 'directory')) AND to_uid NOT IN (SELECT uid FROM ent WHERE kind IN ('file', 'directory'))")
def p20(g: Graph) -> DataFrame:
    return R.high_signal(g.relations, g.entities).select("from_uid", "to_uid", "kind")


@query("id_p21_markable", V.ENT, sql="SELECT uid, kind, name, path FROM ent WHERE path IS NOT NULL AND start_line IS NOT NULL AND kind NOT IN ('repository', 'directory', 'file', 'module')")
def p21(g: Graph) -> DataFrame:
    return g.entities.where(F.col("path").isNotNull() & F.col("start_line").isNotNull() & ~F.col("kind").isin("repository", "directory", "file", "module")).select(*_E)


@query("j01_orphan_hashes", V.ENT, V.FILES, sql="SELECT path FROM files WHERE 'file:' || path NOT IN (SELECT uid FROM ent)")
def j01(g: Graph) -> DataFrame:
    return R.missing_parent(g.files, F.concat(F.lit("file:"), "path"), g.entities).select("path")


@query("j02_orphan_vectors", V.ENT, V.VEC, sql="SELECT uid, provider FROM vec WHERE uid NOT IN (SELECT uid FROM ent WHERE kind <> 'method')")
def j02(g: Graph) -> DataFrame:
    """With the methods gone."""
    return R.missing_parent(g.vectors, F.col("uid"), g.entities.where("kind <> 'method'")).select("uid", "provider")


@query("j03_stale_sources", V.FILES, sql=f"SELECT DISTINCT {V.sql_norm_path('path')} AS path FROM source_files WHERE {V.sql_norm_path('path')} NOT IN (SELECT path FROM files WHERE path NOT LIKE '%.rb')")
def j03(g: Graph) -> DataFrame:
    """With the observations of Ruby files gone."""
    return g.raw("source_files").select(V.normalize_path(F.col("path")).alias("path")).distinct().join(g.files.where("path NOT LIKE '%.rb'").select("path"), "path", "left_anti")


@query("j04_unresolved_without_file", V.ENT, V.UNRES, sql="SELECT DISTINCT path FROM unres WHERE NOT coalesce(resolved, false) AND path IS NOT NULL AND 'file:' || path NOT IN (SELECT uid FROM ent WHERE uid NOT LIKE '%.ts')")
def j04(g: Graph) -> DataFrame:
    """With the TypeScript files gone."""
    u = g.unresolved.where(~F.coalesce("resolved", F.lit(False)) & F.col("path").isNotNull()).select("path").distinct()
    return R.missing_parent(u, F.concat(F.lit("file:"), "path"), g.entities.where("uid NOT LIKE '%.ts'"))


@query("j05_orphan_entities", V.ENT, V.REL, sql="SELECT uid, kind, name, path FROM ent WHERE kind NOT IN ('repository', 'directory', 'file') AND uid NOT IN (SELECT to_uid FROM rel WHERE kind <> 'contains')")
def j05(g: Graph) -> DataFrame:
    return R.orphans(g.entities, g.relations).select(*_E)


@query("j06_dangling_relations", V.ENT, V.REL, sql="SELECT from_uid, to_uid, kind, from_missing, to_missing FROM (SELECT r.*, a.uid IS NULL AS from_missing, b.uid IS NULL AS to_missing FROM rel r LEFT JOIN ent a ON a.uid = r.from_uid LEFT JOIN ent b ON b.uid = r.to_uid) WHERE from_missing OR to_missing")
def j06(g: Graph) -> DataFrame:
    return R.dangling(g.relations, g.entities).select("from_uid", "to_uid", "kind", "from_missing", "to_missing")


@query("j09_contains_view", V.ENT, V.REL, V.CONTAINS, sql="SELECT from_uid, to_uid FROM derived")
def j09(g: Graph) -> DataFrame:
    return g.contains.select("from_uid", "to_uid")


@query("j10_union_precedence", V.ENT, V.REL, V.CONTAINS, sql="SELECT kind, derived, count(*) AS n FROM allrel GROUP BY ALL")
def j10(g: Graph) -> DataFrame:
    return g.all_relations.groupBy("kind", "derived").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j14_neighbor_slice", V.REL,
    sql=f"""SELECT DISTINCT uid, neighbor, direction FROM (
  SELECT from_uid AS uid, to_uid AS neighbor, 'out' AS direction, row_number() OVER (PARTITION BY from_uid ORDER BY {_PRIORITY} DESC, to_uid, kind) AS k FROM rel
  UNION ALL SELECT to_uid, from_uid, 'in', row_number() OVER (PARTITION BY to_uid ORDER BY {_PRIORITY} DESC, from_uid, kind) FROM rel) WHERE k <= 5""",
)
def j14(g: Graph) -> DataFrame:
    return R.neighbor_slice(g.relations)


_TEXT = "concat_ws(chr(10), name, signature, description, docstring)"


@query("j15_versioned_vectors", V.ENT, V.VEC, sql=f"SELECT e.uid FROM ent e JOIN vec v ON v.uid = e.uid AND v.provider = '{PROVIDER}' AND (e.kind = 'function' OR v.r.h = sha256({_TEXT}))")
def j15(g: Graph) -> DataFrame:
    return R.versioned_vectors(g.entities, _refreshed(g), PROVIDER).select("uid")


def _refreshed(g: Graph) -> DataFrame:
    """The vectors as if those of functions had been made from the text of now."""
    now = g.entities.where("kind = 'function'").select("uid", F.sha2(R.semantic_text(), 256).alias("now"))
    return g.vectors.join(now, "uid", "left").withColumn("content_hash", F.coalesce("now", "content_hash")).drop("now")


_API = "SELECT path, sha256(string_agg(item, chr(10) ORDER BY item)) AS fingerprint FROM (SELECT path, uid || '|' || kind || '|' || name || '|' || coalesce(signature, '') AS item FROM {0} WHERE is_public AND path IS NOT NULL) GROUP BY path"


@query("j17_public_api", V.ENT, sql=_API.format("ent"))
def j17(g: Graph) -> DataFrame:
    return R.public_api(g.entities)


@query("j17_api_changes", V.ENT, sql=f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_API.format("(SELECT * FROM ent WHERE created_at < TIMESTAMP '2025-06-01')")}) o FULL JOIN ({_API.format('ent')}) n ON o.path = n.path WHERE o.fingerprint IS DISTINCT FROM n.fingerprint")
def j17c(g: Graph) -> DataFrame:
    """The public interface before June against the present one."""
    old = g.entities.where(F.col("created_at") < F.lit("2025-06-01").cast("timestamp_ntz"))
    return R.api_changes(R.public_api(old), R.public_api(g.entities))


@query("o04_keep_newest", V.FILES, sql=f"SELECT path, content_hash FROM (SELECT path, r.content_hash AS content_hash, r.indexed_at AS indexed_at FROM files WHERE r.indexed_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY ORDER BY indexed_at DESC, path LIMIT 20000)")
def o04(g: Graph) -> DataFrame:
    fresh = g.files.where(F.col("indexed_at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL {schema.CACHE_DAYS} DAYS"))
    return R.keep_newest(fresh.select("path", "content_hash", "indexed_at"), [F.desc("indexed_at"), F.col("path")], schema.CACHE_ROWS).select("path", "content_hash")


_SNAP = lambda limit: f"(SELECT {V.sql_norm_path('path')} AS path, arg_max(lower(content_hash), struct_pack(a := indexed_at, b := run_id, c := lower(content_hash))) AS h FROM file_hashes WHERE run_id <= {limit} GROUP BY ALL)"


@query("o07_snapshot_diff", sql=f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_SNAP(20)} o FULL JOIN {_SNAP(40)} n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h")
def o07(g: Graph) -> DataFrame:
    def upto(run: int) -> DataFrame:
        f = g.raw("file_hashes").where(F.col("run_id") <= run)
        return f.groupBy(V.normalize_path(F.col("path")).alias("path")).agg(F.max(F.struct("indexed_at", "run_id", F.lower("content_hash").alias("h"))).alias("r")).select("path", F.col("r.h").alias("h"))

    return R.snapshot_difference(upto(20), upto(40), "path", "h")


@query("o09_reverse_files", V.ENT, V.REL, _FILEDEPS, sql="SELECT DISTINCT from_path AS path FROM filedeps WHERE to_path IN (SELECT path FROM ent WHERE kind = 'route')")
def o09(g: Graph) -> DataFrame:
    return R.reverse_files(R.file_dependencies(g.relations, g.entities), g.entities.where("kind = 'route'").select("path").distinct())


@query("o10_reverse_symbols", V.ENT, V.REL, sql=f"SELECT DISTINCT from_uid AS uid FROM rel WHERE kind IN ({schema.sql_list(schema.DEPENDENCY_KINDS)}) AND {_SYMBOL('from_uid')} AND {_SYMBOL('to_uid')} AND to_uid IN (SELECT uid FROM ent WHERE kind = 'route')")
def o10(g: Graph) -> DataFrame:
    deps = R.symbol_dependencies(g.relations, g.entities)
    return deps.join(g.entities.where("kind = 'route'").select(F.col("uid").alias("to_uid")), "to_uid", "left_semi").select(F.col("from_uid").alias("uid")).distinct()


@query("c13_directory_entities", V.FILES, sql="SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM files, unnest(range(1, len(string_split(path, '/')))) AS t(i) WHERE contains(path, '/')")
def c13(g: Graph) -> DataFrame:
    return R.directory_entities(g.files.select("path"))


@query("k05_short_ids", V.ENT, sql="SELECT uid, CASE WHEN regexp_matches(uid, '^(obj|func)-[0-9a-f]{8}$') THEN uid ELSE (CASE WHEN kind IN ('function', 'method', 'route', 'test') THEN 'func-' ELSE 'obj-' END) || substr(sha1(uid), 1, 8) END AS short_id FROM ent")
def k05(g: Graph) -> DataFrame:
    from graphloom.functions.keys import short_id

    return g.entities.select("uid", short_id(F.col("kind"), F.col("uid")).alias("short_id"))


@query("s29_cache_misses", V.FILES, sql=f"SELECT path FROM files f WHERE NOT EXISTS (SELECT 1 FROM file_hashes h WHERE {V.sql_norm_path('h.path')} = f.path AND h.run_id <= 40 AND lower(h.content_hash) = f.r.content_hash)")
def s29(g: Graph) -> DataFrame:
    """Present files whose content was not yet seen by run 40: the work of a parse cache filled then."""
    cache = g.raw("file_hashes").where("run_id <= 40").select(V.normalize_path(F.col("path")).alias("path"), F.lower("content_hash").alias("content_hash"))
    return g.files.join(cache, ["path", "content_hash"], "left_anti").select("path")


@query("s31_ordered_entities", V.ENT, sql="SELECT uid, kind, name, path FROM ent")
def s31(g: Graph) -> DataFrame:
    return g.entities.select(*_E).orderBy("uid")


@query("s32_ordered_relations", V.ENT, V.REL, V.CONTAINS, sql="SELECT from_uid, to_uid, kind, confidence, derived FROM allrel")
def s32(g: Graph) -> DataFrame:
    return g.all_relations.orderBy("from_uid", "to_uid", "kind")


@query("s34_unresolved_scan", V.UNRES, sql="SELECT path, kind, symbol, from_uid FROM unres WHERE NOT coalesce(resolved, false)")
def s34(g: Graph) -> DataFrame:
    return g.unresolved.where(~F.coalesce("resolved", F.lit(False))).select("path", "kind", "symbol", "from_uid").orderBy("path", "kind", "symbol", "from_uid")


@query("h09_semantic_text", V.ENT, sql=f"SELECT uid, {_TEXT} AS text FROM ent")
def h09(g: Graph) -> DataFrame:
    return g.entities.select("uid", R.semantic_text().alias("text"))


@query("h24_public_by_name", V.ENT, sql="SELECT uid FROM ent WHERE language IN ('python', 'ruby') AND name NOT LIKE '\\_%' ESCAPE '\\'")
def h24(g: Graph) -> DataFrame:
    return g.entities.where(F.col("language").isin("python", "ruby") & ~F.col("name").startswith("_")).select("uid")


@query("a23_manifest_hash", V.FILES, sql="SELECT sha256(string_agg(part || h, chr(10) ORDER BY part || h)) AS manifest FROM (SELECT substr(sha256(path), 1, 2) AS part, sha256(string_agg(path, chr(10) ORDER BY path)) AS h FROM (SELECT DISTINCT path FROM files) GROUP BY 1)")
def a23(g: Graph) -> DataFrame:
    return R.manifest_hash(g.files)
