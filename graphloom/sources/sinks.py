"""Writing a graph: JSON lines with a manifest, one JSON document, review text, protocol bodies; and reading snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import short_id


def write_jsonl(root: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A folder of JSON lines for each table, and manifest: name, rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}.jsonl")
    counts = [spark.read.text(f"{root}/{n}.jsonl").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in tables]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.json(f"{root}/manifest")


def read_jsonl(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of write_jsonl by their schemas; repeated rows go, since unresolved rows have no key."""
    return {n: spark.read.schema(s).json(f"{root}/{n}.jsonl").distinct() for n, s in schemas.items()}


def review_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """section, line: a line for each entity and relation, for reading and diffing."""
    e = entities.select(F.lit(1).alias("section"), F.concat_ws("", "uid", F.lit(" ["), "kind", F.lit("] | name="), F.coalesce("name", F.lit("")), F.lit(" | path="), F.coalesce("path", F.lit("")), F.lit(" | confidence="), F.format_string("%.2f", "confidence")).alias("line"))
    r = relations.select(F.lit(2).alias("section"), F.concat_ws("", "from_uid", F.lit(" --"), "kind", F.lit("--> "), "to_uid").alias("line"))
    return e.unionByName(r)


def protocol_bodies(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """short_id, purpose, imports, shared: the body of each entity in the protocol export, lists in order."""
    ids = entities.select("uid", short_id(F.col("kind"), F.col("uid")).alias("short_id"))
    to = relations.where(F.col("kind").isin("imports", "depends_on", "calls", "uses")).join(ids.select(F.col("uid").alias("to_uid"), F.col("short_id").alias("to_id")), "to_uid")
    imports = to.groupBy(F.col("from_uid").alias("uid")).agg(F.array_sort(F.collect_set("to_id")).alias("imports"))
    shared = relations.where("kind = 'exports'").join(ids.select(F.col("uid").alias("to_uid"), F.col("short_id").alias("to_id")), "to_uid").groupBy(F.col("from_uid").alias("uid")).agg(F.array_sort(F.collect_set("to_id")).alias("shared"))
    purpose = F.coalesce("description", "docstring", "signature", F.concat_ws(" ", "kind", "name"))
    return entities.select("uid", purpose.alias("purpose")).join(ids, "uid").join(imports, "uid", "left").join(shared, "uid", "left").select("short_id", "uid", "purpose", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"), F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def marker_plan(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """path, line, marker: the comment to put before each symbol that has none in the three lines above."""
    sym = entities.where(F.col("path").isNotNull() & F.col("start_line").isNotNull() & ~F.col("kind").isin("repository", "directory", "file", "module"))
    lines = F.split("content", "\r\n|\n|\r")
    text = sources.select("path", lines.alias("lines")).dropDuplicates(["path"])
    above = F.array_join(F.slice("lines", F.greatest(F.lit(1), F.col("start_line") - 3), F.least(F.lit(3), F.greatest(F.lit(0), F.col("start_line") - 1))), "\n")
    comment = F.when(F.col("path").rlike(r"\.(py|rb)$"), "#").otherwise("//")
    return (
        sym.join(text, "path")
        .where(~above.contains("@uid "))
        .select("path", F.col("start_line").alias("line"), F.concat(comment, F.lit(" @uid "), short_id(F.col("kind"), F.col("uid"))).alias("marker"))
    )
