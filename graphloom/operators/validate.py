"""Validation of a graph, repair plans, and the health report: unions of issue frames of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import relational as R

#: Issue kind -> the repair it calls for; the last three only where asked for.
ACTIONS = {
    "missing_file": "remove_path",
    "stale_hash": "reindex_path",
    "dangling_relation": "remove_relation",
    "unresolved_reference": "remove_unresolved",
    "binary_file": "skip_path",
    "invalid_utf8": "skip_path",
    "orphan_entity": "remove_entity",
    "low_confidence": "review_relation",
}
OPT_IN = ("orphan_entity", "low_confidence")


def text_class(content: Column) -> Column:
    """empty, binary, invalidUtf8 or text of binary content: NUL in the first 4096 bytes, a tenth of control bytes, bad UTF-8."""
    head = F.substring(F.hex(content), 1, 8192)
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    nul = pairs.rlike("(^| )00 ")
    control = F.regexp_count(pairs, F.lit("(?:^|(?<= ))(?:0[1-8BE-F]|1[0-9A-F]|7F) "))
    share = control / F.greatest(F.length(head) / 2, F.lit(1))
    return F.when(F.octet_length(content) == 0, "text").when(nul | (share > 0.1), "binary").when(~F.is_valid_utf8(content.cast("string")) | F.try_to_binary(F.hex(content), F.lit("hex")).isNull(), "invalidUtf8").otherwise("text")


def issue(df: DataFrame, kind: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(schema.SEVERITY[kind]).alias("severity"), subject.alias("subject"), detail.cast("string").alias("detail"))


def issues(entities: DataFrame, relations: DataFrame, unresolved: DataFrame, hashes: DataFrame, present: DataFrame, deep: bool = True, low: float = schema.LOW_CONFIDENCE) -> DataFrame:
    """kind, severity, subject, detail. hashes: path, content_hash as recorded; present: path, content_hash as found."""
    found = present.select("path", F.col("content_hash").alias("now"))
    joined = hashes.select("path", "content_hash").join(found, "path", "left")
    out = [
        issue(joined.where(F.col("now").isNull()), "missing_file", F.col("path"), F.lit(None)),
        issue(joined.where(F.col("now").isNotNull() & (F.col("now") != F.col("content_hash"))), "stale_hash", F.col("path"), F.col("now")),
    ]
    if deep:
        edge = F.concat_ws(" ", "from_uid", "kind", "to_uid")
        out += [
            issue(R.dangling(relations, entities), "dangling_relation", edge, F.when(F.col("from_missing") & F.col("to_missing"), "both").when(F.col("from_missing"), "from").otherwise("to")),
            issue(R.orphans(entities, relations), "orphan_entity", F.col("uid"), F.col("kind")),
            issue(R.low_confidence(relations, low), "low_confidence", edge, F.round("confidence", 4)),
            issue(unresolved.where(~F.coalesce("resolved", F.lit(False))), "unresolved_reference", F.concat_ws(" ", "path", "symbol"), F.col("kind")),
        ]
    return reduce(DataFrame.unionByName, out)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("info"))


def repair_plan(found: DataFrame, opt_in: tuple[str, ...] = ()) -> DataFrame:
    """kind, subject, action, status: planned, or skipped where the repair is opt-in and not asked for."""
    table = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    off = [k for k in OPT_IN if k not in opt_in]
    status = F.when(F.col("kind").isin(off), "skipped").otherwise("planned") if off else F.lit("planned")
    return found.select("kind", "subject", table[F.col("kind")].alias("action"), status.alias("status"))


def apply_repairs(plan: DataFrame, entities: DataFrame, relations: DataFrame, unresolved: DataFrame, hashes: DataFrame) -> dict[str, DataFrame]:
    """The tables after the planned removals."""
    todo = plan.where("status = 'planned'")
    of = lambda action, name: todo.where(F.col("action") == action).select(F.col("subject").alias(name)).distinct()
    edge, ref = F.concat_ws(" ", "from_uid", "kind", "to_uid"), F.concat_ws(" ", "path", "symbol")
    return {
        "relations": relations.withColumn("_k", edge).join(of("remove_relation", "_k"), "_k", "left_anti").drop("_k"),
        "unresolved": unresolved.withColumn("_k", ref).join(of("remove_unresolved", "_k"), "_k", "left_anti").drop("_k"),
        "hashes": hashes.join(of("remove_path", "path"), "path", "left_anti"),
        "entities": entities.join(of("remove_entity", "uid"), "uid", "left_anti").join(of("remove_path", "path"), "path", "left_anti"),
    }


def doctor(entities: DataFrame, unresolved: DataFrame, hashes: DataFrame, vectors: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """check, n: what a health report counts, and repeated keys in place of a physical check."""
    one = lambda df, name: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    u = unresolved.where(~F.coalesce("resolved", F.lit(False)) & F.col("path").isNotNull()).select("path").distinct()
    parts = [
        one(R.missing_parent(hashes, F.concat(F.lit("file:"), "path"), entities), "orphan_hashes"),
        one(R.missing_parent(vectors, F.col("uid"), entities), "orphan_vectors"),
        one(R.missing_parent(u, F.concat(F.lit("file:"), "path"), entities), "unresolved_without_file"),
        one(R.abandoned_runs(runs, now), "abandoned_runs"),
        one(entities.groupBy("uid").count().where("count > 1"), "repeated_uids"),
        one(entities.where(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull()), "corrupt_metadata"),
    ]
    return reduce(DataFrame.unionByName, parts)
