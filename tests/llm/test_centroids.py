"""Clusters along the curve against SQL, plain numpy, and boxes against their vectors."""

import hashlib

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import types as T

from spanmill.llm.centroids import candidates, centroid_clusters, curve_blocks, distances, integer_vectors
from spanmill.llm.queries import QUERIES, SQL

SHAPE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()), T.StructField("key", T.StringType())])


def test_matches_sql(spark, sf):
    assert difference(QUERIES["op12_centroids"](spark, sf), connect(sf), SQL["op12_centroids"]) is None


def lloyd(rows, k, rounds):
    v = np.array([r[1] for r in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    c = v[order[:k]].copy()
    for r in range(rounds + 1):
        far = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        near = far.argmin(axis=1)
        for j in range(len(c)) if r < rounds else ():
            if (near == j).any():
                c[j] = [sum(int(x) for x in col) // int((near == j).sum()) for col in v[near == j].T]
    return sorted((rows[i][0], int(near[i]), int(far[i, near[i]])) for i in range(len(rows)))


@pytest.mark.parametrize("spread", [1, 3000])
def test_against_plain_rounds(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (5, 4))
    rows = [(i, (centres[rng.integers(5)] + rng.integers(-2, 3, 4)).tolist()) for i in range(700)]
    rows += [(i, [7, 7, 7, 7]) for i in range(700, 1100)] + [(3, [0, 0, 0, 0]), (3, [0, 0, 0, 0])]
    df = spark.createDataFrame([(i, [float(x) for x in v], "c", "k") for i, v in rows], SHAPE)
    got = centroid_clusters(df, 6, 4, dims=4, scale=1)
    found = sorted((r.vec_id, r.cluster, r.distance) for r in got.collect())
    assert found == lloyd(rows, 6, 4)
    first = got.first()
    assert first.inertia == sum(d for *_, d in found)
    assert first.cluster_inertia == sum(d for _, c, d in found if c == first.cluster)


def test_blocks_of_separate_groups_have_one_candidate(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (4, 8))
    rows = [(i, [float(x) for x in centres[i % 4] + rng.integers(-50, 50, 8)], "c", "k") for i in range(2000)]
    kept = integer_vectors(spark.createDataFrame(rows, SHAPE), dims=8, scale=1)
    axes = (centres[1:4] - centres[0]).T.astype(float)
    blocks = curve_blocks(kept, axes, 50).collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(2000))
    lo, hi = (np.stack([np.frombuffer(bytes(b[n]), "<i8") for b in blocks]) for n in ("lo", "hi"))
    assert candidates(lo, hi, centres).sum(axis=1).mean() < 1.3


def test_no_nearest_centroid_is_left_out():
    rng = np.random.default_rng(2)
    for _ in range(200):
        v, c = rng.integers(-4, 5, (9, 3)), rng.integers(-4, 5, (5, 3))
        near = distances(v, c).argmin(axis=1)
        assert candidates(v.min(axis=0)[None], v.max(axis=0)[None], c)[0][near].all()


def test_distances_are_exact():
    v, c = np.array([[(1 << 27) - 1, -(1 << 27)]]), np.array([[-(1 << 27), (1 << 27) - 1]])
    assert distances(v, c)[0, 0] == 2 * ((1 << 28) - 1) ** 2


def test_odd_rows(spark):
    bad = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [])]
    good = [(7, [0.5, -0.5]), (None, [0.5, -0.5]), (7, [0.25, 0.0]), (8, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, "c", "k") for i, v in bad + good], SHAPE)
    rows = centroid_clusters(df, dims=2).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in rows) == [(0, 0), (7, 0), (7, 0), (8, 0)]
    assert {len(r.centroid_sha256) for r in rows} == {64}
    only = spark.createDataFrame([(i, v, "c", "k") for i, v in bad], SHAPE)
    assert centroid_clusters(only, dims=2).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroid_clusters(spark.createDataFrame([(1, [1e30, 0.0], "c", "k")], SHAPE), dims=2)
