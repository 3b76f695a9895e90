"""Vector operators of the graph: normalization, cosine, hyperplane buckets with probes, top-k, mock vectors.

Searches for many queries pack queries and vectors into blocks; every pair of blocks is scored in one task as a matrix,
which keeps the k best of each query over all the blocks it meets, so only those are shuffled. Sums run in the order of
the column expressions, so that similarities and sides of hyperplanes are equal to theirs to the bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.session import BROADCAST_BYTES, cut

#: Vectors and queries of one block, and rows that a task holds before it gives them on.
BLOCK_ROWS = 1 << 12
ASK_ROWS = 1 << 10
HELD_ROWS = 1 << 18
#: More than a matrix product errs by in a cosine.
ERROR = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """v at length one; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def projection_sign(family: int, bit: int, dim: int) -> int:
    """A sign from a 32-bit mix of the three numbers: the same on every machine."""
    x = (family * 0x9E3779B1 + bit * 0x85EBCA77 + dim * 0xC2B2AE3D + 0x27D4EB2F) & 0xFFFFFFFF
    for shift, mult in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        x = ((x ^ (x >> shift)) * mult) & 0xFFFFFFFF
    return 1 if (x ^ (x >> 15)) & 1 else -1


def bucket_keys(v: Column, dim: int, bits: int = schema.LSH_BITS, families: int = schema.LSH_FAMILIES) -> Column:
    """f<family>:<bits> for each family: the sides of random hyperplanes."""
    keys = []
    for f in range(families):
        signs = [F.when(dot(v, F.array(*[F.lit(float(projection_sign(f, b, d))) for d in range(dim)])) >= 0, "1").otherwise("0") for b in range(bits)]
        keys.append(F.concat(F.lit(f"f{f}:"), *signs))
    return F.array(*keys)


def probe_keys(key: Column, bits: int = schema.LSH_BITS) -> Column:
    """A key and its one-bit neighbors."""
    head, tail = F.split_part(key, F.lit(":"), F.lit(1)), F.split_part(key, F.lit(":"), F.lit(2))
    flip = lambda i: F.concat(F.substring(tail, F.lit(1), i - 1), F.when(F.substring(tail, i, F.lit(1)) == "1", "0").otherwise("1"), F.substring(tail, i + 1, F.lit(bits)))
    return F.concat(F.array(key), F.transform(F.sequence(F.lit(1), F.lit(bits)), lambda i: F.concat(head, F.lit(":"), flip(i))))


def top_k(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """uid, similarity: the k vectors most similar to one query, exactly; negative ones do not count."""
    s = vectors.select("uid", F.round(cosine(F.col("vector"), query), 6).alias("similarity"))
    return s.where("similarity > 0").orderBy(F.desc("similarity"), "uid").limit(k)


def ann_candidates(vectors: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """query, uid: vectors that share a bucket with a query's key or a one-bit neighbor of it."""
    buckets = vectors.select("uid", F.explode(bucket_keys(F.col("vector"), dim)).alias("key"))
    # A function of two parameters would get the position as the second: bits must not be one here.
    asks = queries.select(F.col("uid").alias("query"), F.explode(F.flatten(F.transform(bucket_keys(F.col("vector"), dim), lambda key: probe_keys(key)))).alias("key"))
    return asks.join(buckets, "key").select("query", "uid").distinct()


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and which have the length and no null; the others are zero."""
    rows = column.to_pylist()
    good = np.array([v is not None and len(v) == dim and None not in v for v in rows], bool)
    return np.array([v if ok else [0.0] * dim for v, ok in zip(rows, good, strict=True)], np.float64).reshape(-1, dim), good


def _codes(x: np.ndarray, good: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The bits of bucket_keys as a number for each family (signs: family, bit, dim); then 1 for a good vector."""
    families, bits, dim = signs.shape
    at = np.zeros((len(x), families * bits))
    for d in range(dim):
        at += x[:, d, None] * signs[:, :, d].ravel()
    side = ~(at < 0) & good[:, None]  # not a number counts as the greater side
    return np.column_stack([side.reshape(len(x), families, bits) @ (1 << np.arange(bits)[::-1]), good]).astype(np.int64)


def _blocks(vectors: DataFrame, rows: int, dim: int, families: int, prefix: str) -> DataFrame:
    """Blocks of vectors (uid, vector): their uids, numbers and codes."""
    signs = np.array([[[projection_sign(f, b, d) for d in range(dim)] for b in range(schema.LSH_BITS)] for f in range(families)], np.float64).reshape(families, schema.LSH_BITS, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                x, good = _matrix(part.column(1), dim)
                codes = _codes(x, good, signs)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.string())), pa.array([x.tobytes()]), pa.array([codes.tobytes()])], [prefix + c for c in ("uids", "x", "codes")])

    return vectors.where(F.col("uid").isNotNull()).select("uid", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"{prefix}uids array<string>, {prefix}x binary, {prefix}codes binary")


def _norm(x: np.ndarray) -> np.ndarray:
    n = np.zeros(len(x))
    for d in range(x.shape[1]):
        n += x[:, d] * x[:, d]
    return np.sqrt(n)


def _cosines(q: np.ndarray, v: np.ndarray, who: np.ndarray, to: np.ndarray, good: np.ndarray) -> np.ndarray:
    """cosine of pairs of rows; 0 for those that are not good."""
    s, n = np.zeros(len(who)), _norm(q)[who] * _norm(v)[to]
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(v.T), strict=True):
        s += a[who] * b[to]
    none = (n == 0) | ~good
    return np.where(none, 0.0, s / np.where(none, 1.0, n))


def _near(asks: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether a query (column) probes a bucket of a vector (row)."""
    near = np.zeros((len(codes), len(asks)), bool)
    for f in range(asks.shape[1] - 1):
        probed = np.zeros((1 << schema.LSH_BITS, len(asks)), bool)
        for flip in (0, *(1 << b for b in range(schema.LSH_BITS))):
            probed[asks[:, f] ^ flip, np.arange(len(asks))] = True
        near |= probed[codes[:, f]]
    return near


def _best(who: np.ndarray, sim: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: by similarity, not a number first, then by uid."""
    key = np.where(np.isnan(sim), np.inf, sim)
    order = np.lexsort((-key, who))
    who, sim, uids, key = who[order], sim[order], uids[order], key[order]
    first, end = np.searchsorted(who, who), np.searchsorted(who, who, "right")
    keep = key >= key[np.minimum(first + k, end) - 1]
    who, sim, uids, key = who[keep], sim[keep], uids[keep], key[keep]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    if (place >= k).any():  # equal ones at the end
        order = np.lexsort((uids.astype(str), -key, who))
        who, sim, uids = who[order], sim[order], uids[order]
        who, sim, uids = who[place < k], sim[place < k], uids[place < k]
    return who, sim, uids


def _search(dim: int, k: int, families: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """query, uid, similarity of the k best of each query among the blocks of a task, and a row without uid for the number of its candidates."""
        held: dict[tuple[str, ...], tuple] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for names, (who, sim, uids, seen) in held.items():
                names_ = np.array(names, object)
                m = len(who)
                sims = pa.array(np.concatenate([sim, np.zeros(len(names))]), mask=np.arange(m + len(names)) >= m, from_pandas=False)
                query, uid = np.concatenate([names_[who], names_]), np.concatenate([uids, np.full(len(names), None, object)])
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.string()), pa.array(uid, pa.string()), sims, pa.array(np.concatenate([np.zeros(m, np.int64), seen]))], ["query", "uid", "similarity", "n"])
            held.clear()

        def meet(names: tuple[str, ...], q: np.ndarray, asks: np.ndarray, uids: np.ndarray, v: np.ndarray, codes: np.ndarray) -> None:
            who0, sim0, uid0, seen = held.get(names) or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(len(names), np.int64))
            names_ = np.array(names, object)
            if families:
                to, who = np.nonzero(_near(asks, codes))
            else:
                n = np.outer(_norm(v), _norm(q))
                s = np.where(n == 0, 0.0, (v @ q.T) / np.where(n == 0, 1.0, n))
                odd = ~np.isfinite(s)
                s[odd] = -np.inf
                # One more than k, since a query's own row does not count.
                least = np.partition(s, len(v) - k - 1, axis=0)[len(v) - k - 1] if len(v) > k else np.full(len(names), -np.inf)
                full = np.bincount(who0, minlength=len(names)) >= k
                worst = np.full(len(names), np.inf)
                np.minimum.at(worst, who0, np.where(np.isnan(sim0), np.inf, sim0))
                least = np.where(full, np.maximum(least, worst), least)
                to, who = np.nonzero((s >= least - ERROR) | odd)
            other = names_[who] != uids[to]
            who, to = who[other], to[other]
            seen = seen + np.bincount(who, minlength=len(names))
            sim = _cosines(q, v, who, to, (asks[who, -1] & codes[to, -1]) == 1)
            held[names] = (*_best(np.concatenate([who0, who]), np.concatenate([sim0, sim]), np.concatenate([uid0, uids[to]]), k), seen)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                numbers = lambda c, kind, wide: np.frombuffer(row[c].as_py(), kind).reshape(-1, wide)  # noqa: B023,E731
                q, v = numbers("q_x", np.float64, dim), numbers("x", np.float64, dim)
                asks, codes = (numbers(c, np.int64, families + 1) for c in ("q_codes", "codes"))
                with np.errstate(all="ignore"):
                    meet(tuple(row["q_uids"].as_py()), q, asks, np.array(row["uids"].as_py(), object), v, codes)
                if sum(len(h[0]) for h in held.values()) > HELD_ROWS:
                    yield from give()
        yield from give()

    return run


def _best_of_tasks(vectors: DataFrame, queries: DataFrame, dim: int, k: int, families: int) -> DataFrame:
    n = queries.count()
    asks = _blocks(queries.repartition(max(1, -(-n // ASK_ROWS))), ASK_ROWS, dim, families, "q_")
    if n * dim * 8 <= BROADCAST_BYTES:
        asks = F.broadcast(asks)
    pairs = _blocks(vectors, BLOCK_ROWS, dim, families, "").crossJoin(asks)
    return pairs.mapInArrow(_search(dim, k, families), "query string, uid string, similarity double, n bigint")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "uid"))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """query, uid, similarity, rank: the k vectors most similar to each query but itself, exactly.

    Vectors (uid, vector) that are null, hold nulls or are of another length have similarity 0. queries should be cheap to
    read again.
    """
    return _ranked(_best_of_tasks(vectors, queries, dim, k, 0).where("uid IS NOT NULL").drop("n"), k)


def ann_top_k(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """query, uid, similarity, rank: the k best bucket candidates of each query, but for itself and those of no positive similarity.

    A query with fewer than min(k, 10) candidates is ranked over all vectors instead.
    """
    queries = cut(queries.select("uid", "vector"))
    some = cut(_best_of_tasks(vectors, queries, dim, k, schema.LSH_FAMILIES))
    enough = some.groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= min(k, 10)).select("query")
    near = some.where("uid IS NOT NULL").drop("n").join(enough, "query", "left_semi")
    far = cut(queries.join(enough, queries.uid == enough.query, "left_anti"))
    return _ranked(near.unionByName(nearest(vectors, far, dim, k).drop("rank")).where("similarity > 0"), k)


def mock_vector(text: Column) -> Column:
    """Sixteen numbers in [-1, 1] from the SHA-256 of a text."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)


def stale_vectors(entities: DataFrame, vectors: DataFrame, provider: str, text: Column) -> DataFrame:
    """uid, content_hash, text of the entities whose vector of the provider is missing or of another text."""
    want = entities.select("uid", text.alias("text")).withColumn("content_hash", F.sha2("text", 256))
    return want.join(vectors.where(F.col("provider") == provider).select("uid", "content_hash"), ["uid", "content_hash"], "left_anti")
