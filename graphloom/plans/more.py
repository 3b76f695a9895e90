"""Registered queries of upkeep: caches, fingerprints, batches, prefixes, upserts, candidate sets, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import graphview as V
from graphloom.operators import merge, textsearch, traverse
from graphloom.operators import relational as R
from graphloom.operators.graphview import Graph
from graphloom.plans.graph import _TOKENS, _pick
from graphloom.plans.relational import PROVIDER, _tested

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str = ""):
    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql:
            SQL[name] = ("WITH " + ", ".join(views) + " " if views else "") + sql
        return f

    return register


@query("a05_table_counts", sql=" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("file_hashes", "index_runs", "entity_vectors", "unresolved")))
def a05(g: Graph) -> DataFrame:
    parts = [g.raw(t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("file_hashes", "index_runs", "entity_vectors", "unresolved")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("a17_first_skipped", sql=f"SELECT DISTINCT {V.sql_norm_path('path')} AS path, 'empty' AS reason FROM source_files WHERE coalesce(content, '') = '' ORDER BY 1 LIMIT 20")
def a17(g: Graph) -> DataFrame:
    s = g.raw("source_files").where(F.coalesce("content", F.lit("")) == "")
    return s.select(V.normalize_path(F.col("path")).alias("path"), F.lit("empty").alias("reason")).distinct().orderBy("path").limit(20)


def byte_chunks(files: DataFrame, budget: int, partitions: int = 16) -> DataFrame:
    """part, chunk, n_files, bytes: consecutive files in path order, as many as the budget holds; a larger file stands alone.

    The running sum starts over at the budget, so it is a fold; it runs within each range of paths.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = n = held = 0
        part = None
        for f in frames:
            out = []
            for p, size in zip(f["part"].tolist(), f["size_bytes"].tolist(), strict=True):
                part = p
                if n and held + size > budget:
                    out.append((part, chunk, n, held))
                    chunk, n, held = chunk + 1, 0, 0
                n, held = n + 1, held + size
            yield pd.DataFrame(out, columns=["part", "chunk", "n_files", "bytes"])
        if n:
            yield pd.DataFrame([(part, chunk, n, held)], columns=["part", "chunk", "n_files", "bytes"])

    ranged = files.where(F.col("size_bytes").isNotNull()).select("path", "size_bytes").repartitionByRange(partitions, "path").sortWithinPartitions("path").select(F.spark_partition_id().alias("part"), "size_bytes")
    return ranged.mapInPandas(fold, "part int, chunk int, n_files int, bytes bigint")


@query("a20_byte_chunks")
def a20(g: Graph) -> DataFrame:
    return byte_chunks(g.files, 128 << 10)


def recall_at_k(results: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """recall: the share of golden queries (query, expected) with an expected item among the first k results (query, item, rank)."""
    hit = golden.join(results.where(F.col("rank") <= k).select("query", F.col("item").alias("expected")).distinct(), ["query", "expected"], "left_semi").select("query").distinct()
    return golden.select("query").distinct().join(hit.withColumn("hit", F.lit(1)), "query", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


@query("a22_recall")
def a22(g: Graph) -> DataFrame:
    """The share of three golden queries with a symbol of that very name among the ten first by text rank."""
    index = textsearch.postings(g.entities)
    asked = ["refresh cursor", "seal channel", "merge ledger"]
    ranked = [textsearch.bm25(index, q, 10).select(F.lit(q).alias("query"), F.col("uid").alias("item"), F.row_number().over(Window.orderBy(F.desc("score"), "uid")).alias("rank")) for q in asked]  # ten rows each
    results = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    named = F.array_join(textsearch.tokens(F.col("name")), " ")
    golden = g.entities.select(named.alias("query"), F.col("uid").alias("expected")).where(F.col("query").isin(asked))
    return recall_at_k(results, golden, 10)


@query("s04_fingerprint", V.FILES, sql="SELECT top, sha256(string_agg(path || ':' || r.content_hash, chr(10) ORDER BY path || ':' || r.content_hash)) AS fingerprint FROM (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS top, path, r FROM files WHERE r.content_hash IS NOT NULL) GROUP BY top")
def s04(g: Graph) -> DataFrame:
    """A fingerprint of each second-level folder over its files' states."""
    item = F.concat("path", F.lit(":"), "content_hash")
    top = F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)))
    return g.files.where(F.col("content_hash").isNotNull()).groupBy(top.alias("top")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(item))), 256).alias("fingerprint"))


@query("s10_prefix_read", sql="SELECT DISTINCT path, substr(content, 1, 120) AS head, length(content) > 120 AS truncated FROM source_files WHERE content IS NOT NULL")
def s10(g: Graph) -> DataFrame:
    s = g.raw("source_files").where(F.col("content").isNotNull())
    return s.select("path", F.substring("content", 1, 120).alias("head"), (F.length("content") > 120).alias("truncated")).distinct()


@query("h15_file_entities", V.FILES, sql="SELECT 'file:' || path AS uid, string_split(path, '/')[-1] AS name, path FROM files")
def h15(g: Graph) -> DataFrame:
    return g.files.select(F.concat(F.lit("file:"), "path").alias("uid"), F.element_at(F.split("path", "/"), -1).alias("name"), "path")


@query("h07_vectors_by_provider", V.VEC, sql=f"SELECT uid, len(r.v)::INTEGER AS dim FROM vec WHERE provider = '{PROVIDER}'")
def h07(g: Graph) -> DataFrame:
    return g.vectors.where(F.col("provider") == PROVIDER).select("uid", F.size("vector").alias("dim"))


@query("h13_runs_by_id", V.FILES, sql="SELECT run_id, mode, status FROM index_runs WHERE run_id IN (SELECT r.run_id FROM files)")
def h13(g: Graph) -> DataFrame:
    return g.raw("index_runs").join(g.files.select("run_id").distinct(), "run_id", "left_semi").select("run_id", "mode", "status").orderBy("run_id")


_UPTO = lambda cond: f"SELECT {V.sql_norm_path('path')} AS path, lower(content_hash) AS content_hash, indexed_at, run_id FROM file_hashes WHERE {cond}"


@query("m11_hash_upsert", sql=f"SELECT path, arg_max(content_hash, struct_pack(a := indexed_at, b := run_id, c := content_hash)) AS content_hash FROM ({_UPTO('run_id <= 40')}) GROUP BY path")
def m11(g: Graph) -> DataFrame:
    """The states of run 24 with the observations of runs 25 to 40 merged in."""
    f = g.raw("file_hashes").select(V.normalize_path(F.col("path")).alias("path"), F.lower("content_hash").alias("content_hash"), "indexed_at", "run_id")
    order = [F.col("indexed_at"), F.col("run_id"), F.col("content_hash")]
    old = merge.bulk_merge(f.where("run_id <= 24"), ["path"], order)
    return merge.bulk_merge(old.unionByName(f.where("run_id > 24 AND run_id <= 40")), ["path"], order).select("path", "content_hash")


@query("m12_bulk_delete", V.ENT, V.FILES, sql="SELECT path FROM files WHERE path NOT IN (SELECT path FROM ent WHERE kind = 'class' AND path IS NOT NULL)")
def m12(g: Graph) -> DataFrame:
    return g.files.join(g.entities.where("kind = 'class'").select("path"), "path", "left_anti").select("path")


@query("m13_append_unresolved", V.UNRES, sql="SELECT path, from_uid, symbol, kind FROM unres")
def m13(g: Graph) -> DataFrame:
    """The table appended to itself: rows without a key are made distinct over all columns."""
    return g.unresolved.unionByName(g.unresolved).distinct().select("path", "from_uid", "symbol", "kind")


@query("m20_schema_migration", V.ENT, sql="SELECT uid, kind, NULL::VARCHAR AS owner FROM ent WHERE kind = 'class' UNION ALL SELECT uid, kind, 'team' FROM ent WHERE kind = 'route'")
def m20(g: Graph) -> DataFrame:
    old = g.entities.where("kind = 'class'").select("uid", "kind")
    return old.unionByName(g.entities.where("kind = 'route'").select("uid", "kind", F.lit("team").alias("owner")), allowMissingColumns=True)


@query("o06_candidates", V.ENT, V.REL, f"hit AS (SELECT uid FROM ent WHERE list_contains({_TOKENS.format('name')}, 'cursor'))", sql="SELECT uid, min(pos)::INTEGER AS pos FROM (SELECT uid, 0 AS pos FROM hit UNION ALL SELECT to_uid, 1 FROM rel WHERE from_uid IN (SELECT uid FROM hit) UNION ALL SELECT from_uid, 2 FROM rel WHERE to_uid IN (SELECT uid FROM hit)) GROUP BY uid")
def o06(g: Graph) -> DataFrame:
    """Text hits and their neighbors, with the first place each came from."""
    hit = g.entities.where(F.array_contains(textsearch.tokens(F.col("name")), "cursor")).select("uid")
    out = g.relations.join(hit.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").select(F.col("to_uid").alias("uid"), F.lit(1).alias("pos"))
    into = g.relations.join(hit.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi").select(F.col("from_uid").alias("uid"), F.lit(2).alias("pos"))
    return hit.withColumn("pos", F.lit(0)).unionByName(out).unionByName(into).groupBy("uid").agg(F.min("pos").alias("pos"))


@query("o08_checkpoint", V.FILES, sql=f"SELECT path FROM files INTERSECT SELECT {V.sql_norm_path('path')} FROM source_files")
def o08(g: Graph) -> DataFrame:
    """Completed paths that are still in the manifest."""
    return g.files.select("path").intersect(g.raw("source_files").select(V.normalize_path(F.col("path")).alias("path")))


@query("g13_multi_seed")
def g13(g: Graph) -> DataFrame:
    """seed, uid: the slices of three seeds with a shared edge budget."""
    first = _pick(g)
    seeds = [first, *(r["uid"] for r in g.entities.where((F.col("kind") == "class") & (F.col("uid") != first)).orderBy("uid").limit(2).collect())]
    left, rows = 60, []
    for s in seeds:
        hood = traverse.neighborhood(g.entities, g.relations, s, traverse.Budget(depth=1, edges=left), kinds=schema.TRAVERSAL_KINDS)
        left -= len(hood["relations"])
        rows += [(s, e["uid"]) for e in hood["entities"]]
        if left <= 0:
            break
    return g.spark.createDataFrame(rows, "seed string, uid string")


@query("j07_relation_count", V.ENT, V.REL, V.CONTAINS, sql="SELECT count(*) AS n FROM allrel")
def j07(g: Graph) -> DataFrame:
    return g.all_relations.agg(F.count(F.lit(1)).alias("n"))


@query("c14_test_entities", V.FILES, sql=r"SELECT 'test:' || path AS uid, 'file:' || path AS from_uid FROM (SELECT regexp_replace(regexp_replace(path, 'e\.py$', 'e_test.py'), '(t\.ts)$', 'x.spec.ts') AS path FROM files) WHERE regexp_matches(path, '/tests?/|\.(test|spec)\.[jt]sx?$|_test\.(py|rs|rb|go)$|_spec\.rb$|(^|/)test_[^/]*\.py$')")
def c14(g: Graph) -> DataFrame:
    return _tested(g).where(R.is_test_path(F.col("path"))).select(F.concat(F.lit("test:"), "path").alias("uid"), F.concat(F.lit("file:"), "path").alias("from_uid"))


@query("h18_alias_index", V.FILES, sql=r"SELECT path, path AS alias FROM files UNION SELECT path, regexp_replace(path, '\.[A-Za-z0-9]+$', '') FROM files UNION SELECT path, regexp_replace(path, '/(index\.[jt]sx?|mod\.rs)$', '') FROM files")
def h18(g: Graph) -> DataFrame:
    """path, alias: the path, the path without extension, the folder of an index file."""
    a = F.array("path", F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""), F.regexp_replace("path", r"/(index\.[jt]sx?|mod\.rs)$", ""))
    return g.files.select("path", F.explode(F.array_distinct(a)).alias("alias"))
