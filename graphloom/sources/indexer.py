"""The index of a tree, kept up over runs: what changed is read again, everything else is taken from the run before.

A run compares the listing (path, content hash) with that of the last completed run. New and
changed files are extracted, in batches of files in path order that are written one by one: a run
that dies leaves its batches, and the next run takes from them what still has the same content.
Renamed files (one path gone, another new, same content, each the first by path of its like) are
told apart from deleted ones. Rows of unchanged files are not touched. A run becomes visible
with one small file that names its tables; the run log says of every run what it did.

Layout: runs/<n>.json (the log), gen-<n>/{files,records}, pending/<batch> of a run not yet completed.

Cases. Null paths are no files; null contents count as empty; repeated paths count once, by the
least content hash. A run without changes writes its log entry only. Files without a known
language are listed and skipped, with the reason.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_path
from graphloom.session import commit_file, list_files, read_file_text, remove
from graphloom.sources.extract import ROWS, extract
from graphloom.sources.tree import language_of

_FILES = "path string, content_hash string, indexed boolean"


@dataclass
class Run:
    """One entry of the log; data is the folder of the tables that hold after it."""

    number: int
    status: str
    started_at: float
    ended_at: float
    data: str | None
    total: int = 0
    indexed: int = 0
    cached: int = 0
    resumed: int = 0
    skipped: int = 0
    deleted: int = 0
    renamed: int = 0


class Indexer:
    def __init__(self, spark: SparkSession, root: str, batch_files: int = 4096):
        self.spark, self.root, self.batch_files = spark, root.rstrip("/"), batch_files

    def log(self) -> list[Run]:
        names = [n for n in list_files(self.spark, f"{self.root}/runs") if n.endswith(".json")]
        return [Run(**json.loads(read_file_text(self.spark, f"{self.root}/runs/{n}"))) for n in sorted(names)]

    def files(self, run: Run | None = None) -> DataFrame:
        data = run.data if run else self._data()
        return self.spark.read.schema(_FILES).parquet(f"{data}/files") if data else self.spark.createDataFrame([], _FILES)

    def records(self) -> DataFrame:
        """Entity, relation and unresolved rows of all files, as extract gives them."""
        data = self._data()
        return self.spark.read.schema(ROWS).parquet(f"{data}/records") if data else self.spark.createDataFrame([], ROWS)

    def _data(self) -> str | None:
        return next((r.data for r in reversed(self.log()) if r.data), None)

    def pending(self) -> DataFrame | None:
        """Rows that a run which did not complete has extracted: its rows with the content hash of their file."""
        names = list_files(self.spark, f"{self.root}/pending")
        done = [n for n in names if list_files(self.spark, f"{self.root}/pending/{n}") and "_SUCCESS" in list_files(self.spark, f"{self.root}/pending/{n}")]
        return self.spark.read.schema("content_hash string, " + ROWS).parquet(*[f"{self.root}/pending/{n}" for n in done]) if done else None

    def run(self, files: DataFrame) -> Run:
        """Brings the index up to the listing files (path, content)."""
        started, log = time.time(), self.log()
        number = len(log)
        target = f"{self.root}/gen-{number:06d}"
        path = normalize_path(F.col("path"))
        text = files.where(F.col("path").isNotNull()).select(path.alias("path"), F.coalesce("content", F.lit("")).alias("content"))
        text = text.withColumn("content_hash", F.sha2("content", 256))
        listed = text.groupBy("path").agg(F.min("content_hash").alias("content_hash")).withColumn("indexed", language_of(F.col("path")).isNotNull())
        listed.write.mode("overwrite").parquet(f"{target}/files")
        now, old = self.spark.read.schema(_FILES).parquet(f"{target}/files"), self.files()
        before = old.select("path", F.col("content_hash").alias("was"))
        todo = now.where("indexed").join(before, "path", "left").where("was IS NULL OR was <> content_hash").select("path", "content_hash")
        kept = self.pending()
        part = F.pmod(F.xxhash64("path"), F.lit(max(1, -(-todo.count() // self.batch_files))))
        fresh = todo
        if kept is not None:
            have = kept.where("record = 'entity' AND kind = 'file'").select("path", "content_hash").distinct()
            fresh = todo.join(have, ["path", "content_hash"], "left_anti")
        # The number of a batch goes by path, and a batch is written whole or not at all.
        batches = [r["batch"] for r in fresh.select(part.alias("batch")).distinct().orderBy("batch").collect()]
        for b in batches:
            self._extract(text, fresh.where(part == b), f"{self.root}/pending/{number:06d}-{b:06d}")
        got = self.pending()
        unchanged = now.where("indexed").join(before, "path").where("was = content_hash").select("path")
        rows = self.records().join(unchanged, "path", "left_semi")
        if got is not None:
            rows = rows.unionByName(got.join(todo, ["path", "content_hash"], "left_semi").drop("content_hash").distinct())
        rows.write.mode("overwrite").parquet(f"{target}/records")
        counts = now.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("indexed")).alias("skipped")).first()
        n_todo, n_fresh, n_renamed = todo.count(), fresh.count(), self.renames(old, now).count()
        gone = old.join(now, "path", "left_anti").count()
        run = Run(number, "completed", started, time.time(), target, counts["total"], n_todo, counts["total"] - counts["skipped"] - n_todo, n_todo - n_fresh, counts["skipped"], gone - n_renamed, n_renamed)
        commit_file(self.spark, f"{self.root}/runs/{number:06d}.json", json.dumps(asdict(run)))
        remove(self.spark, f"{self.root}/pending")
        return run

    def _extract(self, text: DataFrame, todo: DataFrame, target: str) -> None:
        found = extract(text.join(todo, ["path", "content_hash"], "left_semi"))
        found.join(todo, "path").select("content_hash", *found.columns).write.mode("overwrite").parquet(target)

    @staticmethod
    def renames(old: DataFrame, now: DataFrame) -> DataFrame:
        """old_path, path: paths gone and new with the same content, paired in order of path."""
        nth = F.expr("row_number() OVER (PARTITION BY content_hash ORDER BY path)")
        gone = old.join(now.select("path"), "path", "left_anti").select("content_hash", F.col("path").alias("old_path"), nth.alias("nth"))
        new = now.join(old.select("path"), "path", "left_anti").select("content_hash", "path", nth.alias("nth"))
        return gone.join(new, ["content_hash", "nth"]).select("old_path", "path")
