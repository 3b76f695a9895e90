"""Registered queries of the general problems (2, 3, 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import sql_norm_path, sql_norm_uid
from graphloom.operators import hierarchy, incremental, refcheck
from graphloom.session import shared_path, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return refcheck.orphan_endpoints(table(spark, d, "relations"), table(spark, d, "entities"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return refcheck.orphan_report(table(spark, d, "relations"), table(spark, d, "unresolved"), table(spark, d, "entities"))


def p2_orders(spark: SparkSession, d: str) -> DataFrame:
    """Integer keys: order keys that lineitem refers to and a reduced orders table lacks."""
    kept = table(spark, d, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("code"))
    return refcheck.orphan_codes(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("code")), kept).select(F.col("code").alias("l_orderkey"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    feed = incremental.ChangeFeed(spark, shared_path(spark, "feed"))
    feed.advance(table(spark, d, "file_hashes"), table(spark, d, "index_runs"))
    return feed.changes().select("path", "run_id")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """The committed state after two calls with different upper limits."""
    feed = incremental.ChangeFeed(spark, shared_path(spark, "feed"))
    files, runs = table(spark, d, "file_hashes"), table(spark, d, "index_runs")
    feed.advance(files, runs, upper=20)
    feed.advance(files, runs)
    return feed.state().select("path", F.col("state.hash").alias("content_hash"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_uids(table(spark, d, "relations")).select("uid")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.full_hierarchy(table(spark, d, "relations"))
    return h.select("uid", "root_uid", "depth", F.array_join("path", " > ").alias("path"), "n_descendants", "n_parents", "status")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """uid, descendant, distance: every pair of a node and a node below it."""
    return hierarchy.descendants(table(spark, d, "relations"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_orders": p2_orders, "p3_found": p3_found, "p3_state": p3_state, "p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}

_RECORDS = f"""records AS (
  SELECT uid, deleted, born FROM (
    SELECT {sql_norm_uid('uid')} AS uid, coalesce(json_extract_string(metadata, '$.deleted') = 'true', false) AS deleted,
      min(created_at) OVER (PARTITION BY {sql_norm_uid('uid')}) AS born,
      row_number() OVER (PARTITION BY {sql_norm_uid('uid')} ORDER BY updated_at DESC NULLS LAST, coalesce(json_extract_string(metadata, '$.deleted') = 'true', false)) AS rn
    FROM entities WHERE uid IS NOT NULL) WHERE rn = 1)"""

_STATE = f"""obs AS (
  SELECT {sql_norm_path('path')} AS path, run_id, indexed_at, lower(content_hash) AS h FROM file_hashes
  WHERE path IS NOT NULL AND run_id IS NOT NULL AND content_hash IS NOT NULL AND indexed_at IS NOT NULL),
seen AS (SELECT o.*, (SELECT min(r.run_id) FROM index_runs r WHERE r.status = 'completed' AND r.run_id >= o.run_id) AS epoch FROM obs o),
best AS (SELECT path, epoch, max(struct_pack(t := indexed_at, r := run_id, h := h)) AS s FROM seen WHERE epoch IS NOT NULL GROUP BY path, epoch),
state AS (SELECT path, epoch, max(s) OVER (PARTITION BY path ORDER BY epoch) AS s FROM best)"""

_LINKS = f"""link AS (
  SELECT DISTINCT {sql_norm_uid('from_uid')} AS a, {sql_norm_uid('to_uid')} AS b FROM relations
  WHERE kind = 'contains' AND from_uid IS NOT NULL AND to_uid IS NOT NULL),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
on_cycle AS (SELECT DISTINCT a AS uid FROM reach WHERE a = b)"""

_FOREST = f"""{_LINKS},
up AS (SELECT b AS uid, min(a) AS parent, count(*) AS n_parents FROM link GROUP BY b),
node AS (
  SELECT n.uid, CASE WHEN c.uid IS NULL THEN u.parent END AS parent, coalesce(u.n_parents, 0) AS n_parents, c.uid IS NOT NULL AS on_cycle
  FROM (SELECT a AS uid FROM link UNION SELECT b FROM link) n LEFT JOIN up u ON n.uid = u.uid LEFT JOIN on_cycle c ON n.uid = c.uid),
walk AS (
  SELECT uid, uid AS root_uid, 0 AS depth, uid AS path FROM node WHERE parent IS NULL
  UNION ALL SELECT n.uid, w.root_uid, w.depth + 1, w.path || ' > ' || n.uid FROM walk w JOIN node n ON n.parent = w.uid),
followed AS (SELECT a, b FROM link WHERE b NOT IN (SELECT uid FROM on_cycle)),
ways AS (SELECT a, b, 1 AS steps FROM followed UNION SELECT w.a, f.b, w.steps + 1 FROM ways w JOIN followed f ON w.b = f.a),
pairs AS (SELECT a AS uid, b AS descendant, min(steps) AS distance FROM ways GROUP BY a, b)"""

SQL = {
    "p2_found": f"""WITH {_RECORDS},
refs AS (
  SELECT id, 'from' AS endpoint, {sql_norm_uid('from_uid')} AS key FROM relations WHERE from_uid IS NOT NULL
  UNION SELECT id, 'to', {sql_norm_uid('to_uid')} FROM relations WHERE to_uid IS NOT NULL)
SELECT DISTINCT id, endpoint FROM refs WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.uid = refs.key AND NOT r.deleted)""",
    "p2_report": f"""WITH {_RECORDS},
refs AS (
  SELECT 'relations' AS table_name, id::VARCHAR AS ref, 'from' AS endpoint, {sql_norm_uid('from_uid')} AS key, provenance[1].timestamp AS seen_at FROM relations WHERE from_uid IS NOT NULL
  UNION SELECT 'relations', id::VARCHAR, 'to', {sql_norm_uid('to_uid')}, provenance[1].timestamp FROM relations WHERE to_uid IS NOT NULL
  UNION SELECT 'unresolved', coalesce(path, '~') || chr(1) || coalesce(symbol, '~') || chr(1) || coalesce(kind, '~'), 'from', {sql_norm_uid('from_uid')}, created_at FROM unresolved WHERE from_uid IS NOT NULL),
named AS (SELECT refs.*, r.uid IS NULL OR r.deleted AS lost, coalesce(r.deleted, false) AS gone, r.born FROM refs LEFT JOIN records r ON r.uid = refs.key)
SELECT table_name, endpoint, strftime(seen_at, '%Y-%m') AS month, count(*) AS "references", count(*) FILTER (lost) AS orphans, count(*) FILTER (lost AND NOT gone) AS missing,
  count(*) FILTER (lost AND gone) AS deleted, count(*) FILTER (NOT lost AND coalesce(born > seen_at, false)) AS late
FROM named GROUP BY ALL""",
    "p2_orders": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "p3_found": f"""WITH {_STATE}
SELECT path, epoch AS run_id FROM (SELECT path, epoch, s.h AS h, lag(s.h) OVER (PARTITION BY path ORDER BY epoch) AS was FROM state) WHERE was IS NULL OR h <> was""",
    "p3_state": f"""WITH {_STATE}
SELECT path, arg_max(s.h, epoch) AS content_hash FROM state GROUP BY path""",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT uid FROM on_cycle",
    "p4_hierarchy": f"""WITH RECURSIVE {_FOREST}
SELECT w.uid, w.root_uid, w.depth::INTEGER AS depth, w.path, (SELECT count(*) FROM pairs p WHERE p.uid = w.uid)::BIGINT AS n_descendants, n.n_parents::BIGINT AS n_parents,
  CASE WHEN n.on_cycle THEN 'on_cycle' WHEN w.root_uid IN (SELECT uid FROM on_cycle) THEN 'below_cycle' ELSE 'tree' END AS status
FROM walk w JOIN node n ON n.uid = w.uid""",
    "p4_descendants": f"WITH RECURSIVE {_FOREST} SELECT uid, descendant, distance::INTEGER AS distance FROM pairs",
}
