"""References to records that do not exist (problem 2).

Method. Every key has an integer code: integer keys are their own, string keys take a hash of 63
bits, each side by itself. The codes of the existing records alone are sorted and compressed
into runs of consecutive integers, and a run keeps the keys behind its codes. Each referenced
code is matched as-of to the run that starts at or before it; a code beyond that run's end, or
before the first run, refers to no record, and one inside the run does only if its key is among
the run's keys with that code, so that codes shared by chance decide nothing.

Why it holds at size: references are reduced to distinct keys on the map side before anything
moves, so a target that a third of all rows refer to is one key; the as-of match is a window
over blocks of codes with equal high bits, never over the whole key space; and the list of keys
that stand out is broadcast only after its size was measured. Beyond the bound the join goes by
key, where adaptive execution splits a hot one.

Cases. Null keys are not references and are left out. A repeated reference row gives its
case once. An empty parent side makes every reference an orphan; an empty reference side
gives no rows. A record is present if its latest row by updated_at (ties: the row that
says it is alive) is not a tombstone; unreadable metadata counts as alive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_uid
from graphloom.session import broadcast_if_small, cut

#: Codes with equal bits above these are one block; hashed codes have 63 bits.
HASH_BLOCK, INTEGER_BLOCK = 46, 20


def current_records(entities: DataFrame) -> DataFrame:
    """One row per normalized uid: uid, deleted, first_seen (earliest created_at), from the latest row."""
    deleted = F.coalesce(F.get_json_object("metadata", "$.deleted") == "true", F.lit(False))
    return (
        entities.where(F.col("uid").isNotNull())
        .select(normalize_uid(F.col("uid")).alias("uid"), "updated_at", "created_at", deleted.alias("deleted"))
        .groupBy("uid")
        .agg(
            F.max(F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), ~F.col("deleted"))).alias("last"),
            F.min("created_at").alias("first_seen"),
        )
        .select("uid", (~F.col("last.col2")).alias("deleted"), "first_seen")
    )


def hash_code(key: Column) -> Column:
    """A code of 63 bits, so that differences of codes and ranks never overflow."""
    return F.shiftright(F.xxhash64(key), 1)


def compress_runs(codes: DataFrame, block_bits: int) -> DataFrame:
    """Runs (block, run_start, run_end, entries) of consecutive integers in the column code; entries are the rows of each.

    A run never crosses a block, the range of codes with equal high bits, so blocks are independent. Of rows
    that have a code only, runs keep no entries.
    """
    w = Window.partitionBy("block").orderBy("code")
    more = [c for c in codes.columns if c != "code"]
    island = (codes if more else codes.distinct()).withColumn("block", F.shiftright("code", block_bits))
    entries = F.collect_list(F.struct("code", *more)) if more else F.lit(None).cast("array<struct<code: bigint>>")
    return (
        island.withColumn("island", F.col("code") - F.dense_rank().over(w))
        .groupBy("block", "island")
        .agg(F.min("code").alias("run_start"), F.max("code").alias("run_end"), entries.alias("entries"))
        .select("block", "run_start", "run_end", "entries")
    )


def preceding_run(refs: DataFrame, runs: DataFrame, block_bits: int) -> DataFrame:
    """refs (with a column code) and run, the last run that starts at or before the code, null before the first."""
    ref = F.struct(*refs.columns)
    run = F.struct("run_start", "run_end", "entries")
    line = runs.select("block", F.col("run_start").alias("at"), run.alias("run")).withColumn("ref", F.lit(None).cast(refs.select(ref).schema[0].dataType)).unionByName(
        refs.select(F.shiftright("code", block_bits).alias("block"), F.col("code").alias("at"), F.lit(None).cast(runs.select(run).schema[0].dataType).alias("run"), ref.alias("ref"))
    )
    w = Window.partitionBy("block").orderBy("at", F.col("ref").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("run", F.last("run", ignorenulls=True).over(w)).where(F.col("ref").isNotNull()).select("ref.*", "run")


def orphan_codes(refs: DataFrame, parents: DataFrame, block_bits: int = INTEGER_BLOCK) -> DataFrame:
    """Integer keys: the distinct codes of refs (column code) without a row in parents (column code)."""
    codes = lambda df: df.where(F.col("code").isNotNull()).select(F.col("code").cast("long"))
    at = preceding_run(codes(refs).distinct(), compress_runs(codes(parents), block_bits), block_bits)
    return at.where(F.col("run").isNull() | (F.col("code") > F.col("run.run_end"))).select("code")


def match_keys(refs: DataFrame, parents: DataFrame, code: Callable[[Column], Column] = hash_code, block_bits: int = HASH_BLOCK) -> DataFrame:
    """refs (distinct keys, column key) and found, the row of parents (distinct keys) with that key, null if there is none."""
    coded = lambda df: df.withColumn("code", code(F.col("key")))
    at = preceding_run(coded(refs), compress_runs(coded(parents), block_bits), block_bits)
    inside = F.filter("run.entries", lambda e: (e["code"] == F.col("code")) & (e["key"] == F.col("key")))
    found = F.when(F.col("code") <= F.col("run.run_end"), F.get(inside, F.lit(0)))
    return at.select(*refs.columns, found.alias("found"))


def orphan_keys(refs: DataFrame, parents: DataFrame, **more) -> DataFrame:
    """The distinct keys (column key) that refs hold and parents do not."""
    key = lambda df: df.select("key").where(F.col("key").isNotNull()).distinct()
    return match_keys(key(refs), key(parents), **more).where("found IS NULL").select("key")


def endpoints(relations: DataFrame) -> DataFrame:
    """id, endpoint, key, at: two rows for each relation."""
    at = F.get(F.col("provenance"), F.lit(0))["timestamp"]
    return (
        relations.select(
            "id",
            at.alias("at"),
            F.explode(
                F.array(
                    F.struct(F.lit("from").alias("endpoint"), F.col("from_uid").alias("key")),
                    F.struct(F.lit("to").alias("endpoint"), F.col("to_uid").alias("key")),
                )
            ).alias("e"),
        )
        .select("id", "at", "e.endpoint", normalize_uid(F.col("e.key")).alias("key"))
        .where(F.col("key").isNotNull())
    )


def orphan_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """id, endpoint of every relation endpoint whose key names no present record."""
    refs = endpoints(relations)
    alive = current_records(entities).where(~F.col("deleted")).select(F.col("uid").alias("key"))
    lost = cut(orphan_keys(refs.select("key"), alive))
    return refs.join(broadcast_if_small(lost), "key", "left_semi").select("id", "endpoint").distinct()


def orphan_report(relations: DataFrame, unresolved: DataFrame, entities: DataFrame) -> DataFrame:
    """table_name, endpoint, month, references, orphans, missing, deleted, late: counts of distinct reference rows.

    missing and deleted split the orphans; late counts references to records that do exist but
    were created after the reference (no orphans). A reference without a time has a null month.
    """
    refs = (
        endpoints(relations)
        .select(F.lit("relations").alias("table_name"), F.col("id").cast("string").alias("ref"), "endpoint", "key", "at")
        .unionByName(
            unresolved.where(F.col("from_uid").isNotNull()).select(
                F.lit("unresolved").alias("table_name"),
                F.to_json(F.struct("path", "symbol", "kind", "created_at")).alias("ref"),
                F.lit("from").alias("endpoint"),
                normalize_uid(F.col("from_uid")).alias("key"),
                F.col("created_at").alias("at"),
            )
        )
    )
    records = cut(current_records(entities))
    alive = records.where(~F.col("deleted")).select(F.col("uid").alias("key"), "first_seen")
    # Only keys that are lost, or whose record is younger than some reference, stand out; all others are counted as they are.
    keys = match_keys(refs.groupBy("key").agg(F.min("at").alias("first_at")), alive)
    born = F.col("found.first_seen")
    apart = cut(keys.where(F.col("found").isNull() | (born > F.col("first_at"))).select("key", F.col("found").isNull().alias("lost"), born.alias("born")))
    gone = records.where("deleted").select(F.col("uid").alias("key")).join(broadcast_if_small(apart.where("lost").select("key")), "key", "left_semi")
    apart = cut(apart.join(gone.withColumn("gone", F.lit(True)), "key", "left"))
    is_lost, is_gone = F.coalesce("lost", F.lit(False)), F.coalesce("gone", F.lit(False))
    late = (~is_lost) & F.coalesce(F.col("born") > F.col("at"), F.lit(False))
    total = lambda c, name: F.count_if(c).alias(name)
    return (
        refs.distinct()
        .join(broadcast_if_small(apart), "key", "left")
        .groupBy("table_name", "endpoint", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("references"),
            total(is_lost, "orphans"),
            total(is_lost & ~is_gone, "missing"),
            total(is_lost & is_gone, "deleted"),
            total(late, "late"),
        )
    )
