"""Exact centroid clustering of integer vectors with zone maps along a space-filling curve.

Vectors are put in the order of a Hilbert curve over a few projections and cut into blocks, each
with the least and greatest value of every component. Over such a box the difference of two
squared distances is linear, so its maximum is known exactly: a centroid that another one beats
everywhere in the box is no candidate of the block. Where one candidate is left, the block's sums
are enough; the other blocks compare their vectors with their candidates only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import map_arrow, task_count
from spanmill.llm.packing import hilbert_index
from spanmill.session import written

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Vectors of a block, and projections that the curve runs through.
BLOCK, AXES = 256, 3
#: Integer components up to this size keep all distances and bounds exact in 64 bits.
LARGEST = 1 << 27
#: Up to this size sums of products are exact in double precision as well.
_FLOAT_EXACT = 1 << 22


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v): rows with exactly ``dims`` components, none null or non-finite, each turned into
    floor(scale * x). A component beyond ``LARGEST`` stops the job: its distances are no longs."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    kept = vectors.filter(F.coalesce((F.size(x) == dims) & finite, F.lit(False)))

    def whole(c):
        scaled = c.cast("double") * scale
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).otherwise(F.raise_error("vector component too large for exact distances").cast("bigint"))

    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors (or all, if fewer) with the least SHA-256 of ``seed:id``, in that order;
    of rows that repeat an id the least vector is first. Null ids are no starts."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.filter("id IS NOT NULL").withColumn("h", drawn).orderBy("h", "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _projected(v: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return v.astype(np.float64) @ axes


def curve_blocks(vectors: DataFrame, axes: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` neighbours on the Hilbert curve through the projections on
    ``axes`` (d, a): (ids, v, lo, hi, total), the vectors row by row. Equal vectors, however many,
    are dealt to several ranges by a second key."""
    bits = 30 // max(1, axes.shape[1])

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = [], []
        for batch in batches:
            if batch.num_rows:
                p = _projected(_matrix(batch.column("v")), axes)
                lows.append(p.min(axis=0))
                highs.append(p.max(axis=0))
        if lows:
            low, high = np.min(lows, axis=0), np.max(highs, axis=0)
            yield pa.RecordBatch.from_pydict({"axis": pa.array(range(len(low)), pa.int32()), "low": low, "high": high})

    seen = map_arrow(vectors.select("v"), extent, "axis int, low double, high double")
    bounds = {r.axis: (r.low, r.high) for r in seen.groupBy("axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low = np.array([bounds.get(a, (0.0, 0.0))[0] for a in range(axes.shape[1])])
    step = np.array([max(bounds.get(a, (0.0, 0.0))[1] - low[a], 1e-9) for a in range(axes.shape[1])]) / (1 << bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.clip((_projected(_matrix(batch.column("v")), axes) - low) / step, 0, (1 << bits) - 1)
            key = hilbert_index(cells.astype(np.int64), bits) if cells.shape[1] else np.zeros(batch.num_rows, np.int64)
            yield batch.append_column("key", pa.array(key, pa.int64()))

    placed = map_arrow(vectors, keyed, "id long, v array<bigint>, key long").withColumn("tie", F.monotonically_increasing_id())
    ranges = placed.repartitionByRange(task_count(vectors.sparkSession), "key", "tie").sortWithinPartitions("key", "tie")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, cut = _matrix(batch.column("v")), range(0, batch.num_rows, block)
            parts = [v[at : at + block] for at in cut]
            narrow = pa.array([at for at in cut] + [batch.num_rows], pa.int32())
            out = {"ids": pa.ListArray.from_arrays(narrow, batch.column("id")), "v": pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())}
            for name, f in (("lo", np.min), ("hi", np.max), ("total", np.sum)):
                out[name] = pa.array([f(p, axis=0).astype("<i8").tobytes() for p in parts], pa.binary())
            if parts:
                yield pa.RecordBatch.from_pydict(out)

    schema = "ids array<bigint>, v binary, lo binary, hi binary, total binary"
    return written(map_arrow(ranges.select("id", "v"), blocks, schema), "vector-blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(blocks, centroids) booleans: may the centroid be nearest to some vector in the box?

    Over a box the greatest of |v - c_i|^2 - |v - c_j|^2 = |c_i|^2 - |c_j|^2 - 2 v (c_i - c_j)
    takes the least or greatest of each component. Below 0, i beats j everywhere; at 0 it
    does if its number is smaller."""
    square = (centroids**2).sum(axis=1)
    stays = np.ones((len(lo), len(centroids)), bool)
    for i in range(len(centroids)):
        for j in range(len(centroids)):
            if i != j:
                apart = centroids[i] - centroids[j]
                worst = square[i] - square[j] - 2 * (np.where(apart > 0, lo, hi) * apart).sum(axis=1)
                stays[:, j] &= ~((worst < 0) | ((worst == 0) & (i < j)))
    return stays


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) exact squared distances."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < _FLOAT_EXACT:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray, np.ndarray]]:
    """Per block: its place in the batch, its only candidate's number or the numbers of its
    vectors, and its candidates."""
    d = centroids.shape[1]
    stays = candidates(_rows(batch.column("lo"), d), _rows(batch.column("hi"), d), centroids)
    for k in range(batch.num_rows):
        own = np.flatnonzero(stays[k])
        if len(own) == 1:
            yield k, None, None, own
        else:
            v = np.frombuffer(batch.column("v")[k].as_buffer(), "<i8").reshape(-1, d)
            yield k, v, distances(v, centroids[own]), own


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors of every cluster: one row per cluster and
    task is shuffled, one per cluster reaches the driver."""
    k, d = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            for at, v, far, own in _assigned(batch, centroids):
                if v is None:
                    counts[own[0]] += sizes[at]
                    totals[own[0]] += np.frombuffer(batch.column("total")[at].as_buffer(), "<i8")
                else:
                    nearest = far.argmin(axis=1)
                    for c in np.unique(nearest):
                        mine = nearest == c
                        counts[own[c]] += mine.sum()
                        totals[own[c]] += v[mine].sum(axis=0)
        some = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * d, pa.int32()), pa.array(totals[some].ravel(), pa.int64()))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some], pa.int64()), "total": lists})

    parts = map_arrow(blocks, work, "cluster int, n long, total array<bigint>")
    sums = [F.sum(F.col("total")[j].cast("decimal(38,0)")) for j in range(d)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*sums).alias("total")).collect()
    return {r.cluster: (r.n, [int(x) for x in r.total]) for r in rows}


def centroid_clusters(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept: exactly ``dims`` components, none null or non-finite. All arithmetic is on integers.
    Each round assigns every vector to its nearest centroid (ties: the smaller number) and sets
    every centroid that has vectors to the floor of their mean. Fewer vectors with ids than ``k``:
    as many centroids. Repeated ids and vectors are rows of their own; null ids are assigned too,
    but start no centroid. No vector with an id: no rows. Only the two named columns are read.
    """
    kept = written(integer_vectors(vectors, id_col, vector_col, dims, scale), "integer-vectors")
    centroids = first_centroids(kept, k, seed)
    schema = "vec_id long, cluster int, distance long"
    full = f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], full)
    axes = (centroids[1 : AXES + 1] - centroids[0]).T.astype(np.float64)
    blocks = curve_blocks(kept, axes)
    for _ in range(rounds):
        for cluster, (n, total) in _sums(blocks, centroids).items():
            centroids[cluster] = [x // n for x in total]
    final = centroids.copy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, far = [], []
            for at, v, all_far, own in _assigned(batch, final):
                if v is None:
                    v = np.frombuffer(batch.column("v")[at].as_buffer(), "<i8").reshape(-1, final.shape[1])
                    all_far = distances(v, final[own])
                nearest = all_far.argmin(axis=1)
                clusters.append(own[nearest])
                far.append(all_far[np.arange(len(nearest)), nearest])
            if clusters:
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("ids").flatten(), "cluster": pa.array(np.concatenate(clusters), pa.int32()), "distance": pa.array(np.concatenate(far), pa.int64())})

    assigned = written(map_arrow(blocks.select("ids", "v", "lo", "hi"), work, schema), "assigned-vectors")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in final]
    of_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("bigint") for c in range(len(final))])
    return assigned.withColumns(
        {
            "cluster_inertia": F.get(of_cluster, F.col("cluster")),
            "inertia": F.lit(sum(inertia.values())).cast("bigint"),
            "centroid_sha256": F.get(F.array(*map(F.lit, names)), F.col("cluster")),
        }
    )
