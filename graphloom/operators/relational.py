"""Lookups, joins, counts, snapshots and set operations over the graph's views.

Every function takes DataFrames and returns one; keys that a caller asks for are a DataFrame too,
so that nothing depends on how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.session import cut


# ---- lookups and filters

def lookup_ordered(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities in the order asked for: wanted has pos and uid; missing ones drop, repeated ones repeat."""
    return wanted.join(entities, "uid")


def by_uid_or_path(text: Column) -> Column:
    """The uid that a user's text means: a uid, a short id, or the path of a file."""
    return F.when(text.contains(":") | text.rlike("^(obj|func)-[0-9a-f]{8}$"), text).otherwise(F.concat(F.lit("file:"), text))


def path_suffix(entities: DataFrame, path: str) -> DataFrame:
    """Entities at a path or at any path that ends in it after a slash, without regard to case."""
    p = F.lower(F.col("path"))
    return entities.where((F.col("path") == path) | p.endswith("/" + path.lower()))


def touching(relations: DataFrame, uids: DataFrame) -> DataFrame:
    """Relations with either endpoint among the uids; two semi joins, since one join on OR has no key."""
    out = relations.join(uids.select(F.col("uid").alias("from_uid")), "from_uid", "left_semi")
    into = relations.join(uids.select(F.col("uid").alias("to_uid")), "to_uid", "left_semi")
    return out.unionByName(into).dropDuplicates(["from_uid", "to_uid", "kind"])


def endpoints_of(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities at either end of the relations."""
    ends = relations.select(F.explode(F.array("from_uid", "to_uid")).alias("uid")).distinct()
    return entities.join(ends, "uid", "left_semi")


def low_confidence(relations: DataFrame, below: float = schema.LOW_CONFIDENCE) -> DataFrame:
    return relations.where(F.col("kind").isin(schema.CRITICAL_KINDS) & (F.col("confidence") < below))


def high_signal(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of the ten high-signal kinds, not synthetic, with neither endpoint a file or directory; unknown ends stay."""
    dull = entities.where(F.col("kind").isin("file", "directory")).select("uid")
    r = relations.where(F.col("kind").isin(schema.HIGH_SIGNAL_KINDS) & ~F.coalesce("is_synthetic", F.lit(False)))
    return r.join(dull.select(F.col("uid").alias("from_uid")), "from_uid", "left_anti").join(dull.select(F.col("uid").alias("to_uid")), "to_uid", "left_anti")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"/tests?/|\.(test|spec)\.[jt]sx?$|_test\.(py|rs|rb|go)$|_spec\.rb$|(^|/)test_[^/]*\.py$")


def corrupt_json(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text in the column is no JSON."""
    return df.where(F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull())


def unchanged_files(files: DataFrame, now: DataFrame) -> DataFrame:
    """path of the files whose size and time of change are what they were; a null says nothing."""
    new = now.select("path", F.col("size_bytes").alias("new_bytes"), F.col("mtime_ms").alias("new_ms"))
    return files.join(new, "path").where((F.col("size_bytes") == F.col("new_bytes")) & (F.col("mtime_ms") == F.col("new_ms"))).select("path")


def edge_priority(kind: Column, weight: Column, confidence: Column) -> Column:
    """100 x (weight or confidence) + 10 x confidence + the kind's weight."""
    table = F.create_map(*[F.lit(x) for kv in schema.EDGE_WEIGHT.items() for x in kv])
    return 100 * F.coalesce(weight, confidence) + 10 * confidence + F.coalesce(table[kind], F.lit(0))


def abandoned_runs(runs: DataFrame, now: Column, hours: int = schema.RUN_ABANDONED_HOURS) -> DataFrame:
    return runs.where((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {hours} HOURS")))


# ---- joins

def missing_parent(child: DataFrame, key: Column, parents: DataFrame) -> DataFrame:
    """Rows of child whose computed key is no uid of the parents."""
    return child.withColumn("_key", key).join(parents.select(F.col("uid").alias("_key")), "_key", "left_anti").drop("_key")


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with a missing endpoint, and which: both sides are joined on a single key each."""
    known = entities.select(F.col("uid"), F.lit(True).alias("there"))
    r = relations.join(known.select(F.col("uid").alias("from_uid"), F.col("there").alias("from_there")), "from_uid", "left").join(known.select(F.col("uid").alias("to_uid"), F.col("there").alias("to_there")), "to_uid", "left")
    return r.where(F.col("from_there").isNull() | F.col("to_there").isNull()).withColumns({"from_missing": F.col("from_there").isNull(), "to_missing": F.col("to_there").isNull()}).drop("from_there", "to_there")


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities, other than repositories, directories and files, that no relation but containment points at."""
    pointed = relations.where("kind <> 'contains'").select(F.col("to_uid").alias("uid")).distinct()
    return entities.where(~F.col("kind").isin(schema.STRUCTURE_KINDS)).join(pointed, "uid", "left_anti")


def neighbor_slice(relations: DataFrame, n: int = 5) -> DataFrame:
    """uid, neighbor, direction: the n best neighbors of each node in each direction, by edge priority."""
    p = edge_priority(F.col("kind"), F.col("weight"), F.col("confidence"))
    r = relations.withColumn("p", p)
    w = lambda own, other: Window.partitionBy(own).orderBy(F.desc("p"), other, "kind")
    out = r.withColumn("k", F.row_number().over(w("from_uid", "to_uid"))).where(F.col("k") <= n).select(F.col("from_uid").alias("uid"), F.col("to_uid").alias("neighbor"), F.lit("out").alias("direction"))
    into = r.withColumn("k", F.row_number().over(w("to_uid", "from_uid"))).where(F.col("k") <= n).select(F.col("to_uid").alias("uid"), F.col("from_uid").alias("neighbor"), F.lit("in").alias("direction"))
    return out.unionByName(into).distinct()


def versioned_vectors(entities: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """The entities' vectors of a provider, only where the vector was made from the entity's present text."""
    text = F.sha2(semantic_text(), 256)
    return entities.select("uid", text.alias("content_hash")).join(vectors.where(F.col("provider") == provider), ["uid", "content_hash"])


def semantic_text() -> Column:
    """Name, signature, description and docstring, one a line; absent ones drop."""
    return F.concat_ws("\n", "name", "signature", "description", "docstring")


def public_api(entities: DataFrame) -> DataFrame:
    """path, fingerprint: a hash over the public entities of each file."""
    item = F.concat_ws("|", "uid", "kind", "name", F.coalesce("signature", F.lit("")))
    return entities.where(F.col("is_public") & F.col("path").isNotNull()).groupBy("path").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(item))), 256).alias("fingerprint"))


def api_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two fingerprint tables."""
    o, n = old.withColumnRenamed("fingerprint", "o"), new.withColumnRenamed("fingerprint", "n")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return o.join(n, "path", "full").where(~F.col("o").eqNullSafe(F.col("n"))).select("path", change.alias("change"))


# ---- aggregates

def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def vector_counts(vectors: DataFrame) -> DataFrame:
    """provider, n, with a null provider for the total: both in one pass."""
    return vectors.rollup("provider").agg(F.count(F.lit(1)).alias("n"))


def file_of(uid: Column, path: Column) -> Column:
    """The file of an endpoint: its entity's path, else the path in a file uid."""
    return F.coalesce(path, F.when(uid.startswith("file:") & ~uid.contains("#"), F.substring(uid, 6, 1 << 20)))


def file_dependencies(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """from_path, to_path, kind, confidence: the best edge between two files, self loops dropped."""
    e = entities.select("uid", "path")
    r = relations.where(F.col("kind").isin(schema.DEPENDENCY_KINDS))
    r = r.join(e.select(F.col("uid").alias("from_uid"), F.col("path").alias("fp")), "from_uid", "left").join(e.select(F.col("uid").alias("to_uid"), F.col("path").alias("tp")), "to_uid", "left")
    r = r.select(file_of(F.col("from_uid"), F.col("fp")).alias("from_path"), file_of(F.col("to_uid"), F.col("tp")).alias("to_path"), "kind", "confidence")
    return r.where("from_path IS NOT NULL AND to_path IS NOT NULL AND from_path <> to_path").groupBy("from_path", "to_path", "kind").agg(F.max("confidence").alias("confidence"))


def symbol_dependencies(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """from_uid, to_uid, kind, confidence between symbols: uids with '#', or of no structural kind."""
    symbol = lambda c: F.col(c).contains("#") | ~F.split_part(F.col(c), F.lit(":"), F.lit(1)).isin(schema.STRUCTURE_KINDS)
    return relations.where(F.col("kind").isin(schema.DEPENDENCY_KINDS) & symbol("from_uid") & symbol("to_uid")).groupBy("from_uid", "to_uid", "kind").agg(F.max("confidence").alias("confidence"))


def top_priority(provenance: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in schema.SOURCE_PRIORITY.items() for x in kv])
    return F.coalesce(F.array_max(F.transform(provenance, lambda p: F.coalesce(table[p["source"]], F.lit(0)))), F.lit(0))


def merge_provenance(old: Column, new: Column) -> Column:
    """Elements of both, by (source, tool, evidence, timestamp), new ones winning, in order of time."""
    none = F.array().cast("array<struct<source:string,tool:string,timestamp:timestamp_ntz,confidence:double,evidence:string>>")
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & a["tool"].eqNullSafe(b["tool"]) & a["evidence"].eqNullSafe(b["evidence"]) & a["timestamp"].eqNullSafe(b["timestamp"])
    o, n = F.coalesce(old, none), F.coalesce(new, none)
    kept = F.concat(F.filter(o, lambda a: ~F.exists(n, lambda b: same(a, b))), n)
    return F.array_sort(kept, lambda a, b: F.when(a["timestamp"] < b["timestamp"], -1).when(a["timestamp"] > b["timestamp"], 1).otherwise(0))


def nearest_rank(values: DataFrame, column: str, share: float, partitions: int = 64) -> DataFrame:
    """One row: the value at position floor(n x share) in order. Ranges are counted first; only the one that holds it is ranked."""
    v = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ranged = cut(v.repartitionByRange(partitions, "value").withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("c").alias("n")).collect())  # one row a range
    total = sum(n for _, n in sums)
    left, part = min(total - 1, int(total * share)), -1
    for part, n in sums:
        if left < n:
            break
        left -= n
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("value"))
    return ranged.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") > left).orderBy("value").limit(1).select("value")


def line_ranges(entities: DataFrame, margin: int = 3) -> DataFrame:
    """path, first_line, last_line: the span of a file's entities and a margin."""
    e = entities.where(F.col("path").isNotNull() & F.col("start_line").isNotNull())
    return e.groupBy("path").agg(F.greatest(F.lit(1), F.min("start_line") - margin).alias("first_line"), (F.max(F.coalesce("end_line", "start_line")) + margin).alias("last_line"))


def graph_scores(relations: DataFrame) -> DataFrame:
    """uid, score: the best edge at a node, as min(1, priority / 200)."""
    p = F.least(F.lit(1.0), edge_priority(F.col("kind"), F.col("weight"), F.col("confidence")) / 200)
    return relations.select(F.explode(F.array("from_uid", "to_uid")).alias("uid"), p.alias("p")).groupBy("uid").agg(F.max("p").alias("score"))


def manifest_hash(paths: DataFrame) -> DataFrame:
    """A hash over the sorted distinct paths: hashes of hash ranges first, so no task holds the whole list."""
    part = F.substring(F.sha2("path", 256), 1, 2)
    per = paths.select("path").distinct().groupBy(part.alias("part")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("path"))), 256).alias("h"))
    return per.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat("part", "h")))), 256).alias("manifest"))


# ---- set operations, top-k, eviction

def keep_newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows in an order: a top-k, not a window over one partition."""
    return df.orderBy(*order).limit(n)


def snapshot_difference(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """key, change (added, removed, changed) between two states."""
    o, n = old.select(key, F.col(state).alias("o")), new.select(key, F.col(state).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return o.join(n, key, "full").where(~F.col("o").eqNullSafe(F.col("n"))).select(key, change.alias("change"))


def reverse_files(file_deps: DataFrame, paths: DataFrame) -> DataFrame:
    """path: the files that depend on any of the paths."""
    return file_deps.join(paths.select(F.col("path").alias("to_path")), "to_path", "left_semi").select(F.col("from_path").alias("path")).distinct()


def directory_entities(paths: DataFrame) -> DataFrame:
    """path: every directory above the paths."""
    parts = F.split("path", "/")
    return (
        paths.where(F.col("path").contains("/"))
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"))
        .where("path <> ''")
        .distinct()
    )
