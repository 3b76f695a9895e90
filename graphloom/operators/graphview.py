"""The graph that the other operators read: current entities, merged relations, derived containment.

Raw tables hold repetitions, older observations, tombstones and several spellings of a key. The
views here are the tables after normalization, one row a key. Each is a group-by on the key with
a map-side part; nothing is broadcast and nothing collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_path, normalize_uid, sql_norm_path, sql_norm_uid
from graphloom.session import table

_ENTITY = ["kind", "name", "path", "language", "signature", "start_line", "end_line", "description", "docstring", "tags", "metadata", "is_public", "provenance", "confidence", "source_priority", "created_at", "updated_at"]


def current_entities(entities: DataFrame) -> DataFrame:
    """The latest row of each uid that is no tombstone, with normalized uid and path and lower-case language."""
    order = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.coalesce("source_priority", F.lit(0)), F.coalesce("confidence", F.lit(0.0)), F.coalesce("docstring", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("signature", F.lit("")))
    row = F.struct(*_ENTITY)
    latest = entities.where(F.col("uid").isNotNull()).groupBy(normalize_uid(F.col("uid")).alias("uid")).agg(F.max_by(row, order).alias("r")).select("uid", "r.*")
    alive = ~F.coalesce(F.get_json_object("metadata", "$.deleted") == "true", F.lit(False))
    return latest.where(alive).withColumns({"path": normalize_path(F.col("path")), "language": F.lower("language")})


def merged_relations(relations: DataFrame) -> DataFrame:
    """One row for each (from_uid, to_uid, kind): the observation of highest priority, then confidence, then id."""
    order = F.struct(F.coalesce("source_priority", F.lit(0)), F.coalesce("confidence", F.lit(0.0)), "id", F.coalesce("weight", F.lit(-1.0)), F.coalesce("reason", F.lit("")))
    row = F.struct("id", "reason", "weight", "confidence", "provenance", "is_synthetic", "source_priority")
    return (
        relations.where(F.col("from_uid").isNotNull() & F.col("to_uid").isNotNull() & F.col("kind").isNotNull())
        .groupBy(normalize_uid(F.col("from_uid")).alias("from_uid"), normalize_uid(F.col("to_uid")).alias("to_uid"), "kind")
        .agg(F.max_by(row, order).alias("r"))
        .select("from_uid", "to_uid", "kind", "r.*")
    )


class Graph:
    """The tables of a folder and the views over them, each built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def entities(self) -> DataFrame:
        return current_entities(self.raw("entities"))

    @cached_property
    def relations(self) -> DataFrame:
        return merged_relations(self.raw("relations"))

    @cached_property
    def contains(self) -> DataFrame:
        """Derived containment: the file entity of a path contains each machine-made entity with that path."""
        files = self.entities.where("kind = 'file'").select(F.col("uid").alias("from_uid"))
        inner = self.entities.where((~F.col("kind").isin("file", "directory", "repository")) & F.col("path").isNotNull() & (F.col("path") != "") & (F.col("source_priority") < 100))
        return inner.select(F.concat(F.lit("file:"), "path").alias("from_uid"), F.col("uid").alias("to_uid"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence")).join(files, "from_uid", "left_semi")

    @cached_property
    def all_relations(self) -> DataFrame:
        """Stored relations and the derived containment that is not stored; stored rows win."""
        stored = self.relations.select("from_uid", "to_uid", "kind", "confidence", F.lit(False).alias("derived"))
        extra = self.contains.withColumn("derived", F.lit(True)).join(self.relations.where("kind = 'contains'").select("from_uid", "to_uid"), ["from_uid", "to_uid"], "left_anti")
        return stored.unionByName(extra)

    @cached_property
    def files(self) -> DataFrame:
        """The latest observation of each path: path, content_hash (lower case), indexed_at, mtime_ms, size_bytes, run_id."""
        row = F.struct("indexed_at", F.col("run_id"), F.lower("content_hash").alias("content_hash"), "mtime_ms", "size_bytes")
        f = self.raw("file_hashes").where(F.col("path").isNotNull())
        return f.groupBy(normalize_path(F.col("path")).alias("path")).agg(F.max(row).alias("r")).select("path", "r.*")

    @cached_property
    def unresolved(self) -> DataFrame:
        u = self.raw("unresolved")
        return u.withColumns({"path": normalize_path(F.col("path")), "from_uid": normalize_uid(F.col("from_uid"))}).distinct()

    @cached_property
    def vectors(self) -> DataFrame:
        """The latest vector of each (uid, provider), as doubles."""
        row = F.struct("updated_at", "content_hash", F.col("vector").cast("array<double>").alias("vector"))
        v = self.raw("entity_vectors").where(F.col("uid").isNotNull() & F.col("provider").isNotNull())
        return v.groupBy(normalize_uid(F.col("uid")).alias("uid"), "provider").agg(F.max(row).alias("r")).select("uid", "provider", "r.*")


#: The same views as SQL.
ENT = f"""ent AS (
  SELECT * EXCLUDE (rn) REPLACE ({sql_norm_uid('uid')} AS uid, {sql_norm_path('path')} AS path, lower(language) AS language) FROM (
    SELECT *, row_number() OVER (PARTITION BY {sql_norm_uid('uid')} ORDER BY updated_at DESC NULLS LAST, coalesce(source_priority, 0) DESC, coalesce(confidence, 0) DESC, coalesce(docstring, '') DESC, coalesce(description, '') DESC, coalesce(signature, '') DESC) AS rn
    FROM entities WHERE uid IS NOT NULL)
  WHERE rn = 1 AND NOT coalesce(json_extract_string(metadata, '$.deleted') = 'true', false))"""
REL = f"""rel AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT id, {sql_norm_uid('from_uid')} AS from_uid, {sql_norm_uid('to_uid')} AS to_uid, kind, reason, weight, confidence, provenance, is_synthetic, source_priority,
      row_number() OVER (PARTITION BY {sql_norm_uid('from_uid')}, {sql_norm_uid('to_uid')}, kind ORDER BY coalesce(source_priority, 0) DESC, coalesce(confidence, 0) DESC, id DESC, coalesce(weight, -1) DESC, coalesce(reason, '') DESC) AS rn
    FROM relations WHERE from_uid IS NOT NULL AND to_uid IS NOT NULL AND kind IS NOT NULL) WHERE rn = 1)"""
CONTAINS = """derived AS (
  SELECT 'file:' || path AS from_uid, uid AS to_uid, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM ent
  WHERE kind NOT IN ('file', 'directory', 'repository') AND path IS NOT NULL AND path <> '' AND source_priority < 100 AND 'file:' || path IN (SELECT uid FROM ent WHERE kind = 'file')),
allrel AS (
  SELECT from_uid, to_uid, kind, confidence, false AS derived FROM rel
  UNION ALL SELECT *, true FROM derived d WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.from_uid = d.from_uid AND r.to_uid = d.to_uid AND r.kind = 'contains'))"""
FILES = f"""files AS (
  SELECT {sql_norm_path('path')} AS path, max(struct_pack(indexed_at := indexed_at, run_id := run_id, content_hash := lower(content_hash), mtime_ms := mtime_ms, size_bytes := size_bytes)) AS r
  FROM file_hashes WHERE path IS NOT NULL GROUP BY ALL)"""
UNRES = f"""unres AS (SELECT DISTINCT * REPLACE ({sql_norm_path('path')} AS path, {sql_norm_uid('from_uid')} AS from_uid) FROM unresolved)"""
VEC = f"""vec AS (
  SELECT {sql_norm_uid('uid')} AS uid, provider, max(struct_pack(t := updated_at, h := content_hash, v := vector::DOUBLE[])) AS r
  FROM entity_vectors WHERE uid IS NOT NULL AND provider IS NOT NULL GROUP BY ALL)"""
