"""Processing only new or changed records (problem 3).

Method. A high watermark on the monotonic commit sequence (run_id). One call fixes its upper
limit at the start, reads the rows whose sequence lies in (watermark, upper], and commits the
changes, the touched state and the new watermark by the appearance of one small file. A call
that dies before that leaves nothing that a later call reads; a call after it starts from the
new watermark. So no record is skipped and none is delivered twice.

The upper limit stays below the least run that is still open, since that one may deliver more. A
run that has been open for OPEN_HOURS at the time of the log's newest entry counts as abandoned
and holds nothing up; its number goes into the commit, and its rows are read again by every call
until one has seen it closed. What it delivered late counts from that call's first run on.

State is the observation with the latest indexed_at among the rows up to a run. Observations
of failed runs count from the next completed run on, since only completed runs are compared.
Within a call all completed runs of the range are handled in one pass and one job: rows are
reduced to one per path and completed run on the map side (so a path with a third of all rows is
pre-aggregated before the shuffle), a running maximum over the runs of a path gives its state after each, and a change
is a state other than the one before.

Cases. Rows with a null path, hash, time or run are not observations and are left out; hashes
compare without letter case; equal indexed_at within a path is settled by the higher run_id,
then the greater hash; repeated rows change nothing; without a completed run in the range, or
with empty tables, nothing comes out and the watermark stays. Columns beyond those named are
ignored.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.keys import normalize_path
from graphloom.session import commit_file, list_files, read_file_text

_STATE = "path string, state struct<indexed_at: timestamp_ntz, run_id: bigint, hash: string>"
#: A run open for so long counts as abandoned.
OPEN_HOURS = schema.RUN_ABANDONED_HOURS
#: Commits after which the whole state is written once more.
COMPACT = 16


def observations(file_hashes: DataFrame) -> DataFrame:
    """path, run_id, state of each usable observation."""
    return file_hashes.select(
        normalize_path(F.col("path")).alias("path"),
        F.col("run_id").cast("long").alias("run_id"),
        F.struct(F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"), F.col("run_id").cast("long").alias("run_id"), F.lower("content_hash").alias("hash")).alias("state"),
    ).where(F.col("path").isNotNull() & F.col("run_id").isNotNull() & F.col("state.hash").isNotNull() & F.col("state.indexed_at").isNotNull())


def steps_between(obs: DataFrame, completed: list[int], before: DataFrame | None = None) -> DataFrame:
    """path, run_id, state, changed, last: the states of a path after completed runs that changed it, and after the last one that touched it.

    before is the state committed earlier, which is what the last completed run showed. Runs are few (the run log), so they are a literal here.
    """
    runs = F.array(*[F.lit(int(r)).cast("long") for r in sorted(completed)])
    visible = F.get(F.filter(runs, lambda r: r >= F.col("run_id")), F.lit(0))
    seen = obs.withColumn("epoch", visible).where(F.col("epoch").isNotNull())
    steps = seen.groupBy("path", "epoch").agg(F.max("state").alias("state"))
    if before is not None:
        steps = steps.unionByName(before.select("path", F.lit(-(2**62)).cast("long").alias("epoch"), "state"))
    w = Window.partitionBy("path").orderBy("epoch")
    run = steps.withColumn("now", F.max("state").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("was", F.lag("now").over(w)).withColumn("last", F.lead("epoch").over(w).isNull())
    changed = (F.col("epoch") > -(2**62)) & ~F.col("now.hash").eqNullSafe(F.col("was.hash"))
    return run.select("path", F.col("epoch").alias("run_id"), F.col("now").alias("state"), changed.alias("changed"), "last").where("changed OR last")


def run_states(index_runs: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """Completed, open and abandoned runs; of several entries of a run completed counts before failed, and that before open."""
    log = index_runs.where(F.col("run_id").isNotNull()).select(F.col("run_id").cast("long").alias("run_id"), "status", "started_at", "ended_at")
    done, failed, opened = set(), set(), {}
    newest = None
    for r in log.collect():  # the run log
        (done if r["status"] == "completed" else failed if r["status"] == "failed" else opened.setdefault(r["run_id"], set())).add(r["run_id"] if r["status"] in ("completed", "failed") else r["started_at"])
        newest = max((t for t in (newest, r["started_at"], r["ended_at"]) if t is not None), default=None)
    still = {r: max((t for t in at if t is not None), default=None) for r, at in opened.items() if r not in done | failed}
    old = {r for r, at in still.items() if at is not None and newest - at >= timedelta(hours=OPEN_HOURS)}
    return sorted(done), sorted(set(still) - old), sorted(old)


@dataclass
class Commit:
    """late: abandoned runs up to the watermark, to be read again; whole: the data holds the whole state, not only what was touched."""

    sequence: int
    watermark: int
    data: str
    late: list[int] = field(default_factory=list)
    whole: bool = False


class ChangeFeed:
    """A durable feed of changes in a shared folder.

    Layout: data-<sequence>-<attempt>/steps, at every COMPACT-th commit data-.../whole, and commits/<sequence>.json.
    The json names the watermark and its data folder; its appearance is the commit. Two writers cannot both win:
    the file is put in place by a call that fails where one exists, a hard link on a local file system and a
    rename without overwriting elsewhere.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[Commit]:
        names = [n for n in list_files(self.spark, f"{self.root}/commits") if n.endswith(".json")]
        return [Commit(**json.loads(read_file_text(self.spark, f"{self.root}/commits/{n}"))) for n in names]

    def watermark(self) -> int | None:
        done = self.commits()
        return done[-1].watermark if done else None

    def advance(self, file_hashes: DataFrame, index_runs: DataFrame, upper: int | None = None) -> Commit | None:
        """One run of the pipeline: everything after the watermark up to the last completed run.

        upper is fixed here, before any row is read; rows that arrive meanwhile wait for the next call.
        """
        done = self.commits()
        low, late = (done[-1].watermark, done[-1].late) if done else (None, [])
        ended, opened, abandoned = run_states(index_runs)
        bound = [r - 1 for r in opened if low is None or r > low] + ([upper] if upper is not None else [])
        completed = [r for r in ended if (low is None or r > low) and all(r <= b for b in bound)]
        if not completed:
            return None
        high = completed[-1]
        fresh = F.col("run_id") <= high
        fresh = fresh if low is None else (fresh & (F.col("run_id") > low)) | F.col("run_id").isin(late)
        obs = observations(file_hashes.where(fresh))
        before = self.state().join(obs.select("path").distinct(), "path", "left_semi") if done else None
        seq = done[-1].sequence + 1 if done else 0
        target = f"{self.root}/data-{seq:08d}-{uuid.uuid4().hex}"
        steps_between(obs, completed, before).write.parquet(f"{target}/steps")
        c = Commit(seq, high, target, [r for r in abandoned if r <= high], seq % COMPACT == COMPACT - 1)
        if c.whole:
            self._states([*done, c], whole=False).write.parquet(f"{target}/whole")
        self._commit(c)
        return c

    def _commit(self, c: Commit) -> None:
        try:
            commit_file(self.spark, f"{self.root}/commits/{c.sequence:08d}.json", json.dumps(c.__dict__))
        except FileExistsError as e:
            raise RuntimeError(f"commit {c.sequence} was made by another writer") from e

    def changes(self) -> DataFrame:
        """All committed changes: path, run_id, content_hash."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], "path string, run_id bigint, content_hash string")
        steps = self.spark.read.parquet(*[f"{c.data}/steps" for c in done])
        return steps.where("changed").select("path", "run_id", F.col("state.hash").alias("content_hash"))

    def state(self) -> DataFrame:
        """The latest committed state of each path: the last whole state and what was touched since."""
        done = self.commits()
        return self._states(done) if done else self.spark.createDataFrame([], _STATE)

    def _states(self, done: list[Commit], whole: bool = True) -> DataFrame:
        last = max((i for i, c in enumerate(done) if c.whole and (whole or i < len(done) - 1)), default=None)
        since = done if last is None else done[last + 1 :]
        delta = self.spark.createDataFrame([], _STATE)
        if since:
            delta = self.spark.read.parquet(*[f"{c.data}/steps" for c in since]).where("last").select("path", "state")
        if last is not None:
            delta = delta.unionByName(self.spark.read.parquet(f"{done[last].data}/whole"))
        return delta.groupBy("path").agg(F.max("state").alias("state"))
