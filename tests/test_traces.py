"""Roll-up order rules, trees, paging, percentiles."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanmill.functions.stats import gap_filled, percentile_cont
from spanmill.operators import enrich, rollup, traces, tree

SCHEMA = """span_id string, trace_id string, parent_span_id string, project_id string, name string,
  input_tokens int, output_tokens int, latency_ms int, cost_usd double, status string, metadata string,
  started string, ended string, arrival_seq long"""


def spans(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("started_at", F.col("started").cast("timestamp")).withColumn(
        "ended_at", F.col("ended").cast("timestamp")
    )


def row(span, seq, parent=None, trace="t", status="success", name="n", started="2024-01-01", ended=None, **kw):
    values = {"tin": 1, "tout": None, "lat": 10, "cost": None, "meta": "{}", **kw}
    return (
        span, trace, parent, "p", name, values["tin"], values["tout"], values["lat"], values["cost"],
        status, values["meta"], started, ended, seq,
    )


def test_rollup_follows_arrival(spark):
    df = spans(
        spark,
        [
            row("c", 1, parent="r", started="2024-01-05", meta='{"first":1}', ended="2024-01-09"),
            row("r", 2, name="agent", started="2024-01-01", status="timeout", cost=0.5),
            row("d", 3, parent="r", ended="2024-01-02", status="success", lat=None, tin=None),
            row("r2", 4, name="second root", tout=4),
        ],
    )
    got = rollup.trace_rollup(df).first()
    assert got["agent_name"] == "agent" and got["status"] == "timeout"
    assert got["metadata"] == '{"first":1}' and str(got["started_at"])[:10] == "2024-01-05"
    assert str(got["ended_at"])[:10] == "2024-01-02"
    assert (got["total_spans"], got["total_tokens"], got["total_latency_ms"]) == (4, 7, 30)
    assert got["total_cost_usd"] == 0.5
    by_time = rollup.trace_rollup_eventtime(df).first()
    assert str(by_time["started_at"])[:10] == "2024-01-01" and str(by_time["ended_at"])[:10] == "2024-01-09"


def test_error_beats_timeout(spark):
    df = spans(spark, [row("a", 1, status="error"), row("b", 2, status="timeout"), row("c", 3)])
    assert rollup.trace_rollup(df).first()["status"] == "error"


def test_redelivery(spark):
    df = spans(spark, [row("a", 1), row("a", 2, tin=100), row("b", 3)])
    assert rollup.trace_rollup(df).first()["total_spans"] == 2
    twice = rollup.trace_rollup(df, count_duplicates=True).first()
    assert (twice["total_spans"], twice["total_tokens"]) == (3, 102)
    assert {r["span_id"]: r["arrival_seq"] for r in enrich.insert_spans_first_wins(df).collect()} == {"a": 1, "b": 3}
    assert {r["span_id"]: r["arrival_seq"] for r in enrich.index_spans_last_wins(df).collect()} == {"a": 2, "b": 3}


def test_partials_merge_in_any_grouping(spark):
    rng = random.Random(3)
    rows = [
        row(f"s{i}", i, parent=None if i % 5 == 0 else "x", trace=f"t{i % 7}", name=f"n{i}",
            status=rng.choice(["success", "error", "timeout"]), ended=rng.choice([None, f"2024-01-0{1 + i % 9}"]))
        for i in range(200)
    ]
    rng.shuffle(rows)
    df = spans(spark, rows)
    whole = rollup.finish_traces(rollup.trace_partials(df))
    parts = [rollup.trace_partials(df.filter(F.col("arrival_seq") % 3 == k)) for k in range(3)]
    merged = rollup.merge_trace_partials(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, rollup.finish_traces(merged).collect()))


def test_deep_wide_orphaned_and_cyclic_trees(spark):
    rows = [row("d0", 0, trace="deep")]
    rows += [row(f"d{i}", i, parent=f"d{i - 1}", trace="deep") for i in range(1, 70)]
    rows += [row("w", 100, trace="wide")]
    rows += [row(f"w{i}", 100 + i, parent="w", trace="wide", started=f"2024-01-0{1 + i % 3}") for i in range(1, 40)]
    rows += [row("o1", 200, parent="gone", trace="orphan"), row("o2", 201, parent="o1", trace="orphan")]
    rows += [row("c1", 300, parent="c2", trace="cycle"), row("c2", 301, parent="c1", trace="cycle")]
    rows += [row("c0", 302, trace="cycle"), row("me", 303, parent="me", trace="cycle")]
    rows += [row("under", 304, parent="c1", trace="cycle")]
    placed = tree.trace_tree(spans(spark, rows)).cache()
    got = {r["span_id"]: (r["root_id"], r["depth"]) for r in placed.collect()}
    assert got["d69"] == ("d0", 69) and got["d1"] == ("d0", 1)
    assert got["o1"] == ("o1", 0) and got["o2"] == ("o1", 1)
    assert got["c1"] == got["c2"] == got["me"] == got["under"] == (None, None) and got["c0"] == ("c0", 0)
    assert len(got) == len(rows)
    circling = {r["span_id"] for r in tree.cyclic_spans(spans(spark, rows)).collect()}
    assert circling == {"c1", "c2", "me", "under"}
    flat = [r["span_id"] for r in tree.flatten_tree(placed.filter("trace_id = 'wide'")).collect()]
    children = sorted((f"2024-01-0{1 + i % 3}", f"w{i}") for i in range(1, 40))
    assert flat == ["w"] + [name for _, name in children]
    deep = [r["span_id"] for r in tree.flatten_tree(placed.filter("trace_id = 'deep'")).collect()]
    assert deep == [f"d{i}" for i in range(70)]


def test_very_deep_trees_and_many_cyclic_spans(spark):
    n = 10_000
    ring = spark.range(n).selectExpr("'ring' trace_id", "concat('r', id) span_id", f"concat('r', (id + 1) % {n}) parent_span_id")
    deep = spark.range(1100).selectExpr("'deep' trace_id", "concat('d', id) span_id", "IF(id = 0, null, concat('d', id - 1)) parent_span_id")
    both = ring.union(deep).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    assert tree.cyclic_spans(both).agg(F.count("*"), F.min("trace_id"), F.max("trace_id")).first() == (n, "ring", "ring")
    depths = tree.trace_tree(both).groupBy("trace_id").agg(F.max("depth").alias("depth"), F.count("depth").alias("n"))
    assert {r["trace_id"]: (r["depth"], r["n"]) for r in depths.collect()} == {"ring": (None, 0), "deep": (1099, 1100)}


def test_timeline(spark):
    df = spans(
        spark,
        [
            row("a", 1, started="2024-01-01 00:00:00", ended="2024-01-01 00:00:10"),
            row("b", 2, started="2024-01-01 00:00:05", lat=2500),
            row("c", 3, started="2024-01-01 00:00:10", lat=None),
            row("z", 4, trace="zero", lat=None),
        ],
    )
    got = {r["span_id"]: (r["offset_pct"], r["width_pct"]) for r in tree.span_timeline(df).collect()}
    assert got == {"a": (0.0, 100.0), "b": (50.0, 25.0), "c": (100.0, 0.5), "z": (0.0, 0.5)}


def test_compare_takes_the_last_of_a_name(spark):
    df = spans(
        spark,
        [
            row("a", 1, trace="A", name="root"),
            row("a1", 2, parent="a", trace="A", name="step", started="2024-01-02", lat=5),
            row("a2", 3, parent="a", trace="A", name="step", started="2024-01-01", lat=6),
            row("b", 4, trace="B", name="root", status="error", lat=30),
            row("b1", 5, parent="b", trace="B", name="only b"),
        ],
    )
    rows = {r["name"]: r for r in tree.compare_traces(tree.trace_tree(df), "A", "B").collect()}
    assert rows["step"]["latency_ms_a"] == 5 and rows["step"]["missing_b"]
    assert rows["only b"]["missing_a"] and rows["root"]["latency_diff_ms"] == 20
    assert rows["root"]["different"]


def test_pages_cover_everything_once(spark):
    rows = [
        (f"t{i:02d}", "p", f"2024-01-0{1 + i // 10} 00:00:00.00000{i % 3}") for i in range(25)
    ]
    df = spark.createDataFrame(rows, "trace_id string, project_id string, t string").withColumn(
        "started_at", F.col("t").cast("timestamp")
    )
    seen, cursor = [], None
    while True:
        page = traces.trace_page(df, 10, cursor).collect()
        seen += [r["trace_id"] for r in page]
        cursor = next((r["next_cursor"] for r in page if r["next_cursor"]), None)
        if cursor is None:
            break
    want = sorted(((r[2], r[0]) for r in rows), reverse=True)
    assert seen == [name for _, name in want]


def test_percentile_equals_numpy_under_skew(spark):
    rng = np.random.default_rng(1)
    # One group holds nearly all rows.
    values = {"hot": rng.integers(0, 500, 20_000), "one": np.array([7]), "few": rng.integers(0, 9, 4)}
    rows = [(k, int(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(8)
    for p in (0.5, 0.95):
        got = {r["k"]: r["x"] for r in percentile_cont(df, ["k"], "v", p, "x").collect()}
        assert set(got) == set(values)
        for k, vs in values.items():
            assert abs(got[k] - np.percentile(vs, p * 100)) < 1e-9
    everything = percentile_cont(df, [], "v", 0.95, "x").first()["x"]
    assert abs(everything - np.percentile(np.concatenate(list(values.values())), 95)) < 1e-9


def test_gaps_only_between_the_ends(spark):
    df = spark.createDataFrame([("p", "2024-01-01", 2), ("p", "2024-01-04", 1), ("q", "2024-01-09", 5)], "k string, d string, n long")
    df = df.withColumn("d", F.col("d").cast("date"))
    rows = gap_filled(df, "d", "1 DAY", ["n"], ["k"]).orderBy("k", "d").collect()
    assert [(r["k"], str(r["d"])[-2:], r["n"]) for r in rows] == [
        ("p", "01", 2), ("p", "02", 0), ("p", "03", 0), ("p", "04", 1), ("q", "09", 5),
    ]


def test_agent_names(spark):
    df = spans(
        spark,
        [row("r", 1, name="root"), row("c", 2, parent="r"), row("x", 3, parent="gone", trace="u"), row("g", 4, parent="r")],
    ).withColumn("agent_name", F.when(F.col("span_id") == "g", "given").when(F.col("span_id") == "c", ""))
    got = {r["span_id"]: r["agent_name"] for r in enrich.resolve_agent_name(df).collect()}
    assert got == {"r": "root", "c": "root", "x": None, "g": "given"}
