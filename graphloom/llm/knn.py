"""Most similar vectors for every vector (problem 5).

Method. The vectors of a provider are spread over shards of bounded size. A task takes one block
of queries past all shards, one after the other: a vantage-point tree is built over a shard (a
vantage point, the median distance to it, the nearer half inside and the farther half outside), every query first
falls to its own leaf for a starting radius, and then descends to all children that the
triangle inequality cannot rule out. The radius in that test is multiplied by `relax`: factor
one restores exact search, smaller ones skip children that hold neighbors only rarely. Whole
groups of queries go down together, so a leaf is one matrix product. The best candidates are
scored again in double precision and merged with those of the shards before.

Vectors are compared by cosine, as Euclidean distance between unit vectors, which is a metric.
With `least` given, only neighbors of at least that cosine are sought, and the radius starts
there.

Why it holds at size: every vector is written once, into files of the shared folder that tasks read
shard by shard, so disk grows with the rows; shards and query blocks are of fixed size and a task
holds one of each, so its memory does not grow. Its time does, with the number of shards. All rows
are indexed and searched. Work on data without structure grows with the square of the rows whatever the
tree does; `relax` buys it back only where neighbors are much nearer than the average.

Cases. The row with the latest updated_at counts for each (uid, provider), ties going to the
greater vector. Null, empty, zero, non-finite vectors and vectors of another length than `dim`
are left out, as are null uids and providers. Equal similarity is settled by the smaller uid,
however many share it: equal vectors of a shard are searched as one and expanded by uid, and a
query whose list is full of cosines that float32 cannot tell from the k-th is done again over the
whole shard in double precision.
A provider with fewer than k + 1 vectors gives what there is. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_uid
from graphloom.session import cut, remove, shared_folder

K = 5
DIM = 64
SHARD_ROWS = 1 << 15
QUERY_ROWS = 1 << 14
LEAF_ROWS = 256
#: Rows of a provider in one batch of a file, and of all providers in a file.
BATCH_ROWS = 1 << 12
FILE_ROWS = 1 << 16
#: Blocks get a task each up to so many, whatever their size.
FEW_TASKS = 64
#: Candidates kept beyond k until they are scored in double precision.
SPARE = 8
#: More than float32 errs by in a cosine; more than that makes of a distance.
ERROR = 5e-6
SLACK = np.float32(1e-3)
#: Cosines held at once when queries are done again.
AGAIN_CELLS = 1 << 22


def usable_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """provider, uid, vector: the latest row of each key, if it can be compared."""
    latest = (
        vectors.where(F.col("uid").isNotNull() & F.col("provider").isNotNull())
        .select(normalize_uid(F.col("uid")).alias("uid"), "provider", F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.col("vector").alias("v")).alias("row"))
        .groupBy("uid", "provider")
        .agg(F.max("row").alias("row"))
        .select("provider", "uid", F.col("row.v").cast("array<float>").alias("vector"))
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return latest.where((F.size("vector") == dim) & ~bad & F.exists("vector", lambda x: x != 0))


class VpTree:
    """A vantage-point tree over unit vectors; leaves are rows of one matrix."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(unit))
        self.points, self.radius = [], []
        self.nodes: list[tuple] = []  # ("leaf", low, high) or (vantage number, inside node, outside node)
        self._unit = unit
        self.root = self._build(0, len(unit), leaf, rng)
        self.rows = unit[self.order]
        self.vantage = np.array(self.points, np.float32).reshape(-1, unit.shape[1])

    def _build(self, low: int, high: int, leaf: int, rng: np.random.Generator) -> int:
        if high - low <= leaf:
            self.nodes.append(("leaf", low, high))
            return len(self.nodes) - 1
        own = self.order[low:high]
        point = self._unit[own[rng.integers(len(own))]]
        far = _distance(self._unit[own] @ point)
        half = len(own) // 2
        split = np.argpartition(far, half)
        self.order[low:high] = own[split]
        number = len(self.points)
        self.points.append(point)
        self.radius.append(float(far[split[half]]))
        inside = self._build(low, low + half, leaf, rng)
        outside = self._build(low + half, high, leaf, rng)
        self.nodes.append((number, inside, outside))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, k: int, relax: float, least: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and cosines of the k best of each query (-1 where there are fewer), and the products computed."""
        n = len(queries)
        best = np.full((n, k), -2.0 if least is None else np.float32(least) - np.float32(1e-5), np.float32)
        rows = np.full((n, k), -1, np.int64)
        away = _distance(queries @ self.vantage.T) if len(self.vantage) else np.zeros((n, 0), np.float32)
        home = np.full(n, -1)
        work = [(self.root, np.arange(n))]
        spent = 0
        while work:
            node, who = work.pop()
            number, a, b = self.nodes[node]
            if number == "leaf":
                home[who] = node
                spent += self._leaf(queries, who, a, b, best, rows)
                continue
            near = away[who, number] < self.radius[number]
            work += [(child, part) for child, part in ((a, who[near]), (b, who[~near])) if len(part)]
        work = [(self.root, np.arange(n))]
        while work:
            node, who = work.pop()
            number, a, b = self.nodes[node]
            if number == "leaf":
                spent += self._leaf(queries, who[home[who] != node], a, b, best, rows)
                continue
            far = away[who, number]
            reach = relax * _distance(best[who].min(axis=1)) + SLACK
            inside, outside = far - reach <= self.radius[number], far + reach >= self.radius[number]
            own = far < self.radius[number]  # its own half is always searched
            work += [(child, part) for child, part in ((a, who[inside | own]), (b, who[outside | ~own])) if len(part)]
        return rows, best, spent

    def _leaf(self, queries: np.ndarray, who: np.ndarray, low: int, high: int, best: np.ndarray, rows: np.ndarray) -> int:
        if not len(who):
            return 0
        cos = queries[who] @ self.rows[low:high].T
        better = np.flatnonzero(cos.max(axis=1) > best[who].min(axis=1))
        if len(better):
            k = best.shape[1]
            all_ = np.concatenate([best[who[better]], cos[better]], axis=1)
            top = np.argpartition(-all_, k - 1, axis=1)[:, :k]
            number = np.concatenate([rows[who[better]], np.broadcast_to(self.order[low:high], (len(better), high - low))], axis=1)
            best[who[better]] = np.take_along_axis(all_, top, axis=1)
            rows[who[better]] = np.take_along_axis(number, top, axis=1)
        return len(who) * (high - low)


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0), dtype=np.float32)


def _matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    flat = table[name].combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(flat.chunks).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Targets:
    """The vectors of a shard in order of uid, equal ones as one."""

    def __init__(self, names: np.ndarray, data: np.ndarray, k: int):
        order = np.argsort(names.astype(str), kind="stable")
        self.names, self.k, data = names[order], k, data[order] + 0.0
        _, first, group = np.unique(data.view(np.dtype((np.void, data.shape[1] * data.itemsize))).ravel(), return_index=True, return_inverse=True)
        self.unit, self.members = data[first], np.argsort(group, kind="stable")
        self.start = np.searchsorted(group[self.members], np.arange(len(first)))
        self.many = np.minimum(np.bincount(group, minlength=len(first)), k + 1)  # of equal ones only the first k + 1 can count

    def best(self, ask: np.ndarray, own: np.ndarray, who: np.ndarray, to: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and cosine of the k best neighbors of each query among the distinct vectors given for it."""
        sim = np.einsum("ij,ij->i", ask[who], self.unit[to])
        if least is not None:
            keep = sim >= least
            who, to, sim = who[keep], to[keep], sim[keep]
        many = self.many[to]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        who, sim, row = np.repeat(who, many), np.repeat(sim, many), self.members[np.repeat(self.start[to], many) + step]
        keep = own[who] != self.names[row]
        who, row, sim = who[keep], row[keep], sim[keep]
        order = np.lexsort((row, -sim, who))
        who, row, sim = who[order], row[order], sim[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        return who[keep], row[keep], sim[keep]

    def again(self, ask: np.ndarray, own: np.ndarray, which: np.ndarray, least: float | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """best for some queries, over all vectors."""
        out, step, last = [], max(1, AGAIN_CELLS // len(self.unit)), max(0, len(self.unit) - self.k - 1)
        for i in range(0, len(which), step):
            some = which[i : i + step]
            cos = ask[some] @ self.unit.T
            who, to = np.nonzero(cos >= np.partition(cos, last, axis=1)[:, last, None] - 1e-12)
            out.append(self.best(ask, own, some[who], to, least))
        return out


def _search_shard(shard: pa.Table, ask: np.ndarray, own: np.ndarray, k: int, relax: float, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, name and cosine of the k best neighbors of each query in a shard."""
    targets = _Targets(shard["uid"].to_numpy(), _matrix(shard, "vector", ask.shape[1]), k)
    rows, cos, _ = VpTree(targets.unit.astype(np.float32)).search(ask.astype(np.float32), k + 1 + SPARE, relax, least)
    who, col = np.nonzero(rows >= 0)
    who, to, sim = targets.best(ask, own, who, rows[who, col], least)
    worst = np.full(len(own), np.inf)  # of k neighbors; fewer in a full list were under the least
    np.minimum.at(worst, who, sim)
    worst[np.bincount(who, minlength=len(own)) < k] = -np.inf if least is None else least
    unsure = (rows >= 0).all(axis=1) & (cos.min(axis=1) >= worst - ERROR)
    keep = ~unsure[who]
    parts = [(who[keep], to[keep], sim[keep]), *targets.again(ask, own, np.flatnonzero(unsure), least)]
    who, to, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
    return who, targets.names[to], sim


class _Best:
    """The k best neighbors so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.who, self.name, self.sim = k, np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        self.worst = np.full(n, -np.inf)  # the k-th, once there are k

    def add(self, who: np.ndarray, name: np.ndarray, sim: np.ndarray) -> None:
        keep = sim >= self.worst[who]
        who, name, sim = who[keep], name[keep], sim[keep]
        touched = np.zeros(len(self.worst), bool)
        touched[who] = True
        old = touched[self.who]
        who, name, sim = np.concatenate([self.who[old], who]), np.concatenate([self.name[old], name]), np.concatenate([self.sim[old], sim])
        order = np.lexsort((np.unique(name, return_inverse=True)[1], -sim, who))
        who, name, sim = who[order], name[order], sim[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last, keep = place == self.k - 1, place < self.k
        self.worst[who[last]] = sim[last]
        self.who, self.name, self.sim = np.concatenate([self.who[~old], who[keep]]), np.concatenate([self.name[~old], name[keep]]), np.concatenate([self.sim[~old], sim[keep]])


def _search_task(k: int, dim: int, relax: float, least: float | None):
    schema = pa.schema([("provider", pa.string()), ("uid", pa.string()), ("neighbor", pa.string()), ("similarity", pa.float64()), ("rank", pa.int32())])

    def run(shards: pa.Table | Iterable[pa.Table], queries: pa.Table) -> pa.Table:
        ask, own, best = _matrix(queries, "vector", dim), queries["uid"].to_numpy(), _Best(queries.num_rows, k)
        for shard in [shards] if isinstance(shards, pa.Table) else shards:
            best.add(*_search_shard(shard, ask, own, k, relax, least))
        order = np.argsort(best.who, kind="stable")
        who, name, sim = best.who[order], best.name[order], best.sim[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
        provider = queries["provider"].to_numpy()[who]
        return pa.table([pa.array(provider, pa.string()), pa.array(own[who], pa.string()), pa.array(name, pa.string()), pa.array(sim, pa.float64()), pa.array(rank, pa.int32())], schema=schema)

    return run


def _store_task(address: str, batch_rows: int):
    """Writes provider, uid, vector into files; gives provider, file, batch and rows of what each batch of a file holds."""

    def write(held: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
        files, folder = FileSystem.from_uri(address)
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table["provider"])).combine_chunks()
        runs = pc.run_end_encode(table["provider"].combine_chunks())
        out = []
        with files.open_output_stream(f"{folder}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as file:
            low = 0
            for provider, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                for at in range(low, high, batch_rows):
                    rows = min(batch_rows, high - at)
                    (batch,) = table.slice(at, rows).to_batches()
                    file.write_batch(batch)
                    out.append((provider, name, len(out), rows))
                low = high
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["provider", "file", "batch", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is run again writes files of its own; those of the first are in no list. The order of names is that of the rows.
        part, number, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, FILE_ROWS):
                held.append(batch.slice(at, FILE_ROWS))
                if sum(b.num_rows for b in held) >= FILE_ROWS:
                    yield write(held, f"{part:08}-{number:06}-{uuid.uuid4().hex}")
                    number, held = number + 1, []
        if held:
            yield write(held, f"{part:08}-{number:06}-{uuid.uuid4().hex}")

    return run


def _block_task(address: str, k: int, dim: int, relax: float, least: float | None):
    """For each provider and block the neighbors of the block's vectors, read with the shards from the files of _store_task."""
    search = _search_task(k, dim, relax, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = FileSystem.from_uri(address)

        def read(places: pa.Table) -> pa.Table:
            out = []
            for name in sorted(set(places["file"].to_pylist())):
                with files.open_input_file(f"{folder}/{name}") as source:
                    file = pa.ipc.open_file(source)
                    out += [file.get_batch(i) for i in sorted(places.filter(pc.field("file") == name)["batch"].to_pylist())]
            return pa.Table.from_batches(out)

        for batch in batches:
            for task in batch.to_pylist():
                places = pq.read_table(f"{folder}/places", filesystem=files, filters=pc.field("provider") == task["provider"])
                shards = sorted(set(places["shard"].to_pylist()))
                queries = read(places.filter(pc.field("block") == task["block"]))
                yield from search((read(places.filter(pc.field("shard") == s)) for s in shards), queries).to_batches(BATCH_ROWS)

    return run


def most_similar(
    vectors: DataFrame, k: int = K, dim: int = DIM, relax: float = 1.0, least: float | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """provider, uid, neighbor, similarity, rank: the k most similar vectors of every usable vector."""
    spark = vectors.sparkSession
    folder, address = shared_folder(spark, "vectors")
    try:
        store = _store_task(address, min(BATCH_ROWS, shard_rows, query_rows))
        stored = cut(usable_vectors(vectors, dim).mapInArrow(store, "provider string, file string, batch int, rows long"))
        own = Window.partitionBy("provider")
        before, n = F.sum("rows").over(own.orderBy("file", "batch")) - F.col("rows"), F.sum("rows").over(own)
        part = lambda size: F.floor(before * F.ceil(n / size) / n)
        stored.select("provider", "file", "batch", "rows", part(shard_rows).alias("shard"), part(query_rows).alias("block")).write.parquet(f"{folder}/places")
        tasks = cut(spark.read.parquet(f"{folder}/places").groupBy("provider", "block").agg(F.sum("rows").alias("rows")))
        sizes = tasks.agg(F.count(F.lit(1)).alias("tasks"), F.sum("rows").alias("rows")).first()
        spread = tasks.coalesce(1).repartition(max(1, min(sizes["tasks"], FEW_TASKS + 2 * (sizes["rows"] or 0) // query_rows)))  # small providers share tasks
        return cut(spread.mapInArrow(_block_task(address, k, dim, relax, least), "provider string, uid string, neighbor string, similarity double, rank int"))
    finally:
        remove(spark, folder)


def similar_pairs(vectors: DataFrame, least: float = 0.9, k: int = K, relax: float = 1.0) -> DataFrame:
    """uid_a, uid_b (uid_a < uid_b): pairs of at least that cosine in which one is among the k best of the other."""
    near = most_similar(vectors, k=k, relax=relax, least=least)
    return near.select(F.least("uid", "neighbor").alias("uid_a"), F.greatest("uid", "neighbor").alias("uid_b")).distinct()
