"""Merges, deletions and rewrites of graph tables: each is a new table, computed from the old one.

Parquet tables know no row updates, so an operation is an anti join or a keyed group-by, and the
caller writes the result as a new version. Keys are unique in every result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators.relational import merge_provenance


def priority_merge(old: DataFrame, new: DataFrame, keys: list[str], keep_provenance: bool = True) -> DataFrame:
    """old with new merged in: a row of at least the old one's source_priority replaces it.

    created_at stays the old one. Provenance is that of both (keep_provenance), or the winner's.
    old and new each have one row a key and the same columns.
    """
    data = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*data).alias("o"))
    n = new.select(*keys, F.struct(*data).alias("n"))
    wins = F.col("o").isNull() | (F.col("n").isNotNull() & (F.col("n.source_priority") >= F.col("o.source_priority")))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()

    def column(c: str) -> Column:
        pick = F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c == "created_at":
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        if c == "provenance" and keep_provenance:
            return F.when(both, merge_provenance(F.col(f"o.{c}"), F.col(f"n.{c}"))).otherwise(pick).alias(c)
        return pick.alias(c)

    return o.join(n, keys, "full").select(*keys, *map(column, data))


def bulk_merge(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order, by a keyed group-by with a map-side part."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def delete_edges(relations: DataFrame, doomed: DataFrame) -> DataFrame:
    """relations without those whose (from_uid, to_uid[, kind]) is in doomed."""
    return relations.join(doomed, doomed.columns, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], uids: DataFrame) -> dict[str, DataFrame]:
    """Entities, relations and vectors without the uids; edges go with either endpoint."""
    u = uids.select("uid")
    r = tables["relations"].join(u.withColumnRenamed("uid", "from_uid"), "from_uid", "left_anti").join(u.withColumnRenamed("uid", "to_uid"), "to_uid", "left_anti")
    return tables | {"entities": tables["entities"].join(u, "uid", "left_anti"), "relations": r, "vectors": tables["vectors"].join(u, "uid", "left_anti")}


def clear_paths(entities: DataFrame, relations: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the machine-made entities of the paths and every edge that touches them, inbound ones included."""
    gone = entities.where(F.col("source_priority") < 100).join(paths, "path", "left_semi").select("uid")
    left = cascade_delete({"entities": entities, "relations": relations, "vectors": entities.select("uid")}, gone)
    return left["entities"], left["relations"]


def replace_files(entities: DataFrame, relations: DataFrame, new_entities: DataFrame, new_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clear_paths for the new entities' paths, then the new rows."""
    e, r = clear_paths(entities, relations, new_entities.select("path").distinct())
    return e.unionByName(new_entities), r.unionByName(new_relations)


def rewrite_uid(uid: Column, old: Column, new: Column) -> Column:
    """kind:old[#symbol] as kind:new[#symbol]; other uids as they are."""
    kind, rest = F.split_part(uid, F.lit(":"), F.lit(1)), F.substring(uid, F.instr(uid, ":") + 1, F.lit(1 << 20))
    path = F.split_part(rest, F.lit("#"), F.lit(1))
    tail = F.when(F.instr(rest, "#") > 0, F.substring(rest, F.instr(rest, "#"), F.lit(1 << 20))).otherwise("")
    return F.when(path == old, F.concat(kind, F.lit(":"), new, tail)).otherwise(uid)


def rename_paths(entities: DataFrame, relations: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations after files moved; moves has old and new. Joins on the path part, one key each."""
    part = lambda c: F.regexp_extract(c, "(?s)^[^:#]*:([^#]*)", 1)

    def moved(df: DataFrame, column: str) -> DataFrame:
        m = moves.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        j = df.withColumn("_old", part(F.col(column))).join(m, "_old", "left")
        return j.withColumn(column, F.when(F.col("_new").isNotNull(), rewrite_uid(F.col(column), F.col("_old"), F.col("_new"))).otherwise(F.col(column))).drop("_old", "_new")

    e = moved(entities, "uid").join(moves.select(F.col("old").alias("path"), F.col("new").alias("_new")), "path", "left")
    e = e.withColumn("path", F.coalesce("_new", "path")).drop("_new")
    return e, moved(moved(relations, "from_uid"), "to_uid")


def mark_runs_failed(runs: DataFrame, ids: DataFrame, reason: str) -> DataFrame:
    """The run log with the given runs failed and the reason merged into their metadata."""
    f = ids.select("run_id", F.lit(True).alias("_f"))
    old = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != "error"), F.create_map(F.lit("error"), F.lit(reason))))
    return runs.join(f, "run_id", "left").withColumns({"status": F.when(F.col("_f"), "failed").otherwise(F.col("status")), "metadata": F.when(F.col("_f"), merged).otherwise(F.col("metadata"))}).drop("_f")


def manual_entity(spark, kind: str, name: str, path: str, symbol: str | None, now: str) -> DataFrame:
    """A human-made entity as a one-row frame for priority_merge."""
    uid = f"{kind if kind in schema.ENTITY_KINDS else 'function'}:{path}" + (f"#{symbol}" if symbol else "")
    return spark.createDataFrame([(uid, kind, name, path)], "uid string, kind string, name string, path string").withColumns(
        {"confidence": F.lit(1.0), "source_priority": F.lit(schema.SOURCE_PRIORITY["human"]), "created_at": F.lit(now).cast("timestamp_ntz"), "updated_at": F.lit(now).cast("timestamp_ntz")}
    )
