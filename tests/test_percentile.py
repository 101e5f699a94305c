"""Exact percentiles by a sketch's bracket and its refinement."""

import random

import pytest
from pyspark.sql import functions as F

from spanmill.functions import stats


def interpolated(values, fraction):
    ordered = sorted(values)
    position = (len(ordered) - 1) * fraction
    low = int(position)
    high = ordered[min(low + 1, len(ordered) - 1)]
    return ordered[low] + (high - ordered[low]) * (position - low)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    return {
        "one": [7], "two": [1, 2], "ties": [5] * 500 + [9] * 20, "few": [rng.randint(-50, 50) for _ in range(39)],
        "wide": [rng.randint(0, 10**12) for _ in range(30_000)], "hot": [int(rng.expovariate(0.01)) for _ in range(60_000)],
        None: [3, 1, 2], "large": [2**62 + k for k in range(25)],
    }


@pytest.fixture(scope="module")
def rows(spark, groups):
    data = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("none", None), ("one", None)]
    return spark.createDataFrame(data, "g string, v bigint").repartition(7)


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 1.0])
def test_every_group_is_exact(rows, groups, fraction):
    found = stats.counted_percentile(rows, ["g"], [F.count("*").alias("n")], "v", fraction, "p").collect()
    got = {r.g: (r.n, r.p) for r in found}
    assert got.pop("none") == (2, None)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == (len(values) + (g == "one"), pytest.approx(interpolated(values, fraction), rel=1e-12))


def test_without_keys_and_without_rows(rows, groups):
    everything = [v for values in groups.values() for v in values]
    assert stats.percentile_cont(rows, [], "v", 0.95, "p").first().p == pytest.approx(interpolated(everything, 0.95), rel=1e-12)
    nothing = stats.counted_percentile(rows.limit(0), [], [F.count("*").alias("n")], "v", 0.95, "p").collect()
    assert [tuple(r) for r in nothing] == [(0, None)]
    assert stats.percentile_cont(rows.limit(0), ["g"], "v", 0.95, "p").count() == 0
    assert stats.percentile_cont(rows.filter("g = 'none'"), ["g"], "v", 0.95, "p").count() == 0


def test_only_the_bracket_is_put_in_order(rows):
    """A group of 60 000 values: the window sees the values near the rank."""
    hot = rows.filter("g = 'wide'")
    result = stats.counted_percentile(hot, ["g"], [], "v", 0.95, "p")
    result.collect()
    plan = result._jdf.queryExecution().executedPlan()
    assert "Window" in plan.toString()
    counted = result._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("Aggregate") == 1 and "kll" not in counted


def test_a_missed_bracket_stops_the_job(rows, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET", -0.4)
    with pytest.raises(Exception, match="bracket missed"):
        stats.percentile_cont(rows.filter("g = 'hot'"), ["g"], "v", 0.95, "p").collect()
