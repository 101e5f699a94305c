"""Bloom filters, runs by key, and ingest that drops a repeat whenever it comes."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from test_streaming import run_ingest, stored, wire, write_file

from spanmill.operators import enrich
from spanmill.operators.bloom import block_of, blocks_for, bloom_filter, may_hold
from spanmill.plans import derived as d
from spanmill.sources import key_runs, tables
from spanmill.sources.batches import read_span_batches, read_spans, spans_sink
from spanmill.streaming import jobs

SCHEMA = "k string, v bigint"


def test_filter_keeps_every_key(spark):
    keys = spark.range(4000).select(F.concat(F.lit("key-"), "id").alias("k"), "id")
    n = blocks_for(2000)
    filter_ = bloom_filter(keys.filter("id % 2 = 0"), "k", n)
    asked = keys.withColumn("block", block_of(F.col("k"), n)).join(filter_, "block", "left").withColumn("hit", may_hold(F.col("k")))
    hits = {r.id for r in asked.filter("hit").collect()}
    assert hits >= set(range(0, 4000, 2)) and len(hits) < 2000 + 2000 * 0.08
    assert blocks_for(0) == 1 and bloom_filter(keys.limit(0), "k", 1).count() == 0


def test_lookup_over_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_runs, "FANOUT", 2)
    root, rng, want = str(tmp_path / "runs"), random.Random(1), {}
    for batch in range(7):
        rows = [(f"k{rng.randrange(60)}", batch * 100 + i) for i in range(12 if batch != 3 else 0)]
        key_runs.merge(spark, root, "k", SCHEMA, batch)
        keys = spark.createDataFrame([(f"k{i}",) for i in range(80)] + [(None,), ("k1",)], "k string")
        for pushed in (3, 10**6):
            monkeypatch.setattr(key_runs, "PUSHED_KEYS", pushed)
            found = sorted(map(tuple, key_runs.lookup(spark, root, "k", SCHEMA, keys, batch).collect()))
            assert found == sorted((k, v) for k, rows_ in want.items() for v in rows_)
        for _ in range(2):  # running a batch again changes nothing
            key_runs.record(spark.createDataFrame(rows, SCHEMA), root, "k", batch)
        for k, v in rows:
            want.setdefault(k, []).append(v)
    assert key_runs.live_runs(spark, root) == [(0, 3), (4, 5), (6, 6)]
    # A merge that stopped before its filter was written does not count.
    monkeypatch.setattr(key_runs, "bloom_filter", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        key_runs.merge(spark, root, "k", SCHEMA, 8) or key_runs._write_run(spark.createDataFrame([], SCHEMA), root, "k", 0, 6)
    assert key_runs.live_runs(spark, root) == [(0, 3), (4, 5), (6, 6)]


def test_few_keys_reach_the_scan(spark, tmp_path):
    root = str(tmp_path / "runs")
    key_runs.record(spark.range(3000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")), root, "k", 0)
    found = key_runs.lookup(spark, root, "k", SCHEMA, spark.createDataFrame([("7",), ("x",)], "k string"), 1)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "EqualTo(_hash" in text
    assert [tuple(r) for r in found.collect()] == [("7", 7)]


def test_a_repeat_is_dropped_whenever_it_comes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_runs, "FANOUT", 2)
    rng = random.Random(5)
    spans = [wire(i, startedAt=f"2024-{1 + i % 9:02d}-01T00:00:00Z") for i in range(30)]
    again = [{**rng.choice(spans), "startedAt": "2025-07-01T00:00:00Z", "latencyMs": 5} for _ in range(30)]
    # Children months after their root still get its name.
    late = [wire(i, startedAt="2025-09-01T00:00:00Z", traceId="t1", parentSpanId="s3") for i in (201, 202)]
    deliveries = spans + again + late + spans[:5]
    results = []
    for name, size in (("one", 100), ("many", 24)):
        source = tmp_path / name
        source.mkdir()
        root = str(tmp_path / f"out-{name}")
        for k, at in enumerate(range(0, len(deliveries), size)):
            write_file(source, f"{k:03d}.json", deliveries[at : at + size])
            os.utime(source / f"{k:03d}.json", (1_700_000_000 + k,) * 2)  # the order of arrival
        run_ingest(spark, source, root, str(tmp_path / f"cp-{name}"), maxFilesPerTrigger=1)
        rows = stored(spark, root).collect()
        assert len(rows) == 32 and all(r["latency_ms"] is None for r in rows)
        traces = tables.read_traces(spark, f"{root}/trace_partials").select("trace_id", "total_spans").collect()
        results.append((sorted((r["span_id"], r["agent_name"], r["started_at"]) for r in rows), sorted(map(tuple, traces))))
    assert results[0] == results[1]
    assert {r[1] for r in results[0][0] if r[0] in ("s201", "s202")} == {"n0"}
    last = read_span_batches(spark, str(source / f"{k:03d}.json"))
    jobs.ingest_micro_batch(last, k, root)  # run again
    assert stored(spark, root).count() == 32


@pytest.mark.parametrize("most", [0, 10**6])
def test_duplicate_rules_without_moving_texts(spark, tmp_path, monkeypatch, most):
    """With broadcast joins off and more repeats than are broadcast, texts are shuffled only
    where the filter finds a repeat."""
    spans_sink(d.duplicates(spark, "/root/testdata/sf0.001"), str(tmp_path / "spans"))
    spans = read_spans(spark, str(tmp_path / "spans")).drop("date")
    want = {r.span_id: (r.low, r.high) for r in spans.groupBy("span_id").agg(F.min("arrival_seq").alias("low"), F.max("arrival_seq").alias("high")).collect()}
    monkeypatch.setattr(enrich, "BROADCAST_IDS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k, rule in enumerate((enrich.insert_spans_first_wins, enrich.index_spans_last_wins)):
            result = rule(spans)
            text = result._jdf.queryExecution().executedPlan().toString()
            rows = result.collect()
            assert len(rows) == len(want) and all(r.arrival_seq == want[r.span_id][k] for r in rows)
            moved = [at.start() for at in re.finditer(r"Exchange hashpartitioning\(span_id", text)]
            assert ("SortMergeJoin" in text) == (most == 0)
            for at in moved:  # what is moved was found by the filter, or is the repeated ids
                below = text[at:].split("\n", 4)[1:4]
                assert any("_w0" in line or "_kept" in line for line in below), below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    once = spans.dropDuplicates(["span_id"])
    assert enrich.insert_spans_first_wins(once) is once


def test_lookup_in_an_empty_table_is_known_to_be_empty(spark, tmp_path):
    keys = spark.createDataFrame([("a",)], "k string")
    nothing = key_runs.lookup(spark, str(tmp_path / "runs"), "k", SCHEMA, keys, 0)
    assert nothing.dtypes == [("k", "string"), ("v", "bigint")] and nothing.count() == 0
    assert "LocalRelation <empty>" in keys.join(nothing, "k")._jdf.queryExecution().optimizedPlan().toString()
