import datetime as dt
import json
import random

from pyspark.sql import functions as F

from spanmill.operators import alerts, lifecycle
from spanmill.schema import ALERTS, FIRINGS
from spanmill.sources import batches

BASE = dt.datetime(2024, 1, 1)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def greedy(minutes, wait=15):
    fired, last = [], None
    for m in sorted(minutes):
        if last is None or m - last >= wait:
            fired.append(m)
            last = m
    return fired


def test_cooldown_equals_a_sequential_run(spark):
    rng = random.Random(5)
    ticks = {f"a{k}": sorted(rng.sample(range(0, 3000, 5), rng.randint(1, 400))) for k in range(6)}
    ticks["constant"] = list(range(0, 5000, 5))
    rows = [(k, at(m), float(m)) for k, ms in ticks.items() for m in ms]
    df = spark.createDataFrame(rows, "alert_id string, tick timestamp, value double").repartition(5)
    got: dict[str, list[float]] = {}
    for r in alerts.apply_cooldown(df, "alert_id", "tick").collect():
        got.setdefault(r["alert_id"], []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(ms) for k, ms in ticks.items()}


def _fixture(spark):
    spans = spark.createDataFrame(
        [("p", "t1", "error", 100, 1.5, at(-1)), ("p", "t2", "success", 300, None, at(-5)), ("p", "t3", "error", 1, 9.0, at(-6)),
         ("q", "t4", "success", None, None, at(0))],
        "project_id string, trace_id string, status string, latency_ms int, cost_usd double, started_at timestamp",
    )
    traces = spark.createDataFrame(
        [("p", "error", at(-2)), ("p", "error", at(-9))], "project_id string, status string, started_at timestamp"
    )
    rule = lambda i, p, kind, limit, active=True: (
        i, p, f"rule {i}", kind, limit, "slack", "{}", active, at(-1000),
    )
    from decimal import Decimal as D

    rules = spark.createDataFrame(
        [
            rule("rate", "p", "error_rate", D("49.9999")),
            rule("rate-eq", "p", "error_rate", D("50")),
            rule("cost", "p", "cost_spike", D("1")),
            rule("p95", "p", "latency_p95", D("289.9")),
            rule("fail", "p", "failure", D("0")),
            rule("off", "p", "failure", D("0"), False),
            rule("quiet", "q", "latency_p95", D("0")),
            rule("none", "r", "error_rate", D("0")),
            rule("cooling", "p", "cost_spike", D("0.5")),
            rule("cooled", "p", "cost_spike", D("0.5")),
        ],
        ALERTS,
    )
    fired = lambda i, m: (i, "p", i, "cost_spike", 1.0, D("1"), "slack", "pending", None, at(m))
    firings = spark.createDataFrame([fired("cooling", -14), fired("cooled", -15)], FIRINGS)
    return rules, spans, traces, firings


def test_evaluation(spark):
    rules, spans, traces, firings = _fixture(spark)
    fired = {r["alert_id"]: r for r in alerts.evaluate_alerts(rules, spans, traces, firings, at(0)).collect()}
    assert set(fired) == {"rate", "cost", "p95", "fail", "cooled"}
    assert fired["rate"]["current_value"] == 50.0 and fired["cost"]["current_value"] == 1.5
    assert abs(fired["p95"]["current_value"] - 290.0) < 1e-9
    assert fired["fail"]["current_value"] == 1.0 and fired["fail"]["delivery_status"] == "pending"
    # Without any latency: zero in one form, absent in the other.
    metrics = {r["project_id"]: r["latency_p95"] for r in alerts.alert_metrics(spans, at(0)).collect()}
    assert metrics["q"] == 0.0
    assert [r["project_id"] for r in alerts.alert_latency_p95(spans, at(0)).collect()] == ["p"]


def test_messages(spark):
    from decimal import Decimal as D

    rows = spark.createDataFrame(
        [(c, "p", "High cost", "cost_spike", 12.34567, D("1.5"), c, "pending", None, at(0)) for c in ("slack", "email", "webhook")],
        FIRINGS,
    )
    projects = spark.createDataFrame([("p", "Support")], "project_id string, name string")
    out = {r["channel"]: r["body"] for r in alerts.alert_payload(rows, projects, "https://d.example").collect()}
    slack = json.loads(out["slack"])["blocks"]
    assert slack[0] == {"type": "header", "text": {"type": "plain_text", "text": "🚨 Alert: High cost"}}
    assert [f["text"] for f in slack[1]["fields"]] == [
        "*Project:*\nSupport", "*Alert type:*\ncost_spike", "*Current value:*\n12.3457", "*Threshold:*\n1.5",
    ]
    assert slack[2]["elements"][0]["url"] == "https://d.example/projects/p/alerts"
    email = json.loads(out["email"])
    assert email["subject"] == "Alert fired: High cost"
    assert "<tr><td><strong>Threshold</strong></td><td>1.5</td></tr>" in email["html"]
    assert json.loads(out["webhook"]) == {
        "event": "alert.fired", "timestamp": "2024-01-01T00:00:00.000Z", "projectName": "Support",
        "alertName": "High cost", "alertType": "cost_spike", "currentValue": 12.34567, "threshold": 1.5,
        "dashboardUrl": "https://d.example/projects/p/alerts",
    }
    rules, *_ = _fixture(spark)
    test = alerts.test_alert_payload(rules, "https://d.example", at(0)).filter("alert_id = 'cost'").first()
    assert test["alert_name"] == "[TEST] rule cost" and test["current_value"] == 0.0


def test_retention_on_files(spark, tmp_path):
    odd = "a:b/c%"
    rows = [(f"{p}{d}", p, at(d * 1440 + 600)) for p in ("p", "q", "keep", odd) for d in range(6)]
    rows += [("edge", odd, at(3 * 1440 + 900)), ("late", "p", at(1 * 1440 + 1000))]
    spans = spark.createDataFrame(rows, "span_id string, project_id string, started_at timestamp")
    projects = spark.createDataFrame(
        [("p", 2), ("q", 4), ("keep", None), ("absent", 1), (odd, 2)], "project_id string, retention_days int"
    )
    path = str(tmp_path / "spans")
    batches.spans_sink(spans, path)
    # Noon of day 5: cutoffs fall inside days 3 and 1.
    as_of = at(5 * 1440 + 720)
    outcome = lifecycle.retention_cleanup(spark, path, projects, as_of)
    assert {(r["project_id"], r["deleted"], r["outcome"]) for r in outcome.collect()} == {
        ("p", 5, "ok"), ("q", 2, "ok"), ("absent", 0, "ok"), (odd, 4, "ok"),
    }
    left = sorted(r["span_id"] for r in batches.read_spans(spark, path).collect())
    kept = ["p4", "p5", "q2", "q3", "q4", "q5", f"{odd}4", f"{odd}5", "edge"]
    assert left == sorted(kept + [f"keep{d}" for d in range(6)])
    assert left == sorted(r["span_id"] for r in lifecycle.retained(spans, projects, as_of).collect())
    report = {r["project_id"]: r["deleted"] for r in lifecycle.retention_report(spans, projects, as_of).collect()}
    assert report == {"p": 5, "q": 2, "absent": 0, odd: 4}


def test_csv_parts_make_one_file(spark, tmp_path):
    rows = [("a", 1.5, at(0)), ('say "hi", x', None, None), ("line\nfeed", 2.0, None), ("only\rreturn", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, `odd,name` double, t timestamp").repartition(3).orderBy(F.asc_nulls_last("name"))
    path = tmp_path / "csv"
    batches.export_csv(df, str(path))
    text = "".join(p.read_bytes().decode() for p in sorted(path.glob("part-*")))
    assert text == (
        'name,"odd,name",t\na,1.5,2024-01-01T00:00:00.000Z\n"line\nfeed",2.0,\nonly\rreturn,,\n"say ""hi"", x",,\n,,\n'
    )


def test_costly_rare_agent_and_model(spark):
    from spanmill.operators import cost

    rows = [("p", f"m{k:02d}", f"a{k:02d}", 1.0, at(j)) for k in range(60) for j in range(3)]
    rows += [("p", "rare", "seldom", 1000.0, at(1)), ("p", "late", "late", 5000.0, at(90))]
    spans = spark.createDataFrame(rows, "project_id string, model string, agent_name string, cost_usd double, started_at timestamp")
    spans = spans.withColumns(
        {c: F.lit(1) for c in ("input_tokens", "output_tokens", "latency_ms")} | {"provider": F.lit("openai")}
    )
    top = cost.top_cost_model_agent(spans, "p", at(0), at(60)).first()
    assert (top["most_expensive_model"], top["most_expensive_agent"]) == ("rare", "seldom")
    shares = {r["agent_name"]: r["share_pct"] for r in cost.agent_cost_share(cost.cost_by_agent(spans, "p", at(0), at(60))).collect()}
    assert len(shares) == 61 and abs(shares["seldom"] - 100 * 1000 / 1180) < 1e-9
    assert cost.cost_by_model(spans, "p", at(0), at(60)).count() == 61
    assert cost.cost_by_model(spans, "p", at(0), at(60), limit=50).count() == 50
    projects = spark.createDataFrame([("p", 2000.0)], "project_id string, monthly_budget_usd double")
    assert cost.budget_status(spans, projects, as_of=at(60)).first()["month_cost_usd"] == 1180.0


def test_tiers(spark):
    df = spark.createDataFrame([("p", at(-1440 * d)) for d in (0, 8, 30, 60, 90)], "project_id string, started_at timestamp")
    rows = lifecycle.lifecycle_tier(df, at(0)).orderBy(F.desc("started_at")).collect()
    assert [(r["tier"], r["generation"]) for r in rows] == [
        ("hot", 0), ("hot", 1), ("warm", None), ("cold", None), ("delete", None),
    ]


def test_firings_from_series_equal_those_from_breaches(spark):
    import random
    from decimal import Decimal as D

    rng = random.Random(5)
    points = [(p, at(m), "cost_spike", rng.choice([None, 0.5, 1.0, 2.0, 3.0])) for p in ("p", "q") for m in range(0, 2000, 5) if rng.random() < 0.7]
    values = spark.createDataFrame(points, "project_id string, tick timestamp, type string, value double")
    rules = [(f"{p}{k}", p, "cost_spike", D(k % 3) + D("0.5"), k % 5 != 4) for p in ("p", "q", "none") for k in range(10)]
    rules = spark.createDataFrame(rules, "alert_id string, project_id string, type string, threshold decimal(10,4), is_active boolean")
    breaches = rules.filter("is_active").join(values, ["project_id", "type"]).filter("value > threshold")
    columns = ["alert_id", "project_id", "type", "tick", "value", "threshold"]
    want = sorted(map(tuple, alerts.apply_cooldown(breaches, "alert_id", "tick").select(*columns).collect()))
    fired = alerts.fire_with_cooldown(rules, values)
    assert sorted(map(tuple, fired.collect())) == want and len(want) > 400
    # Breaches, alerts times ticks, are not dealt by alert: what is dealt are series and thresholds.
    plan = fired._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftSemi" not in plan
    # A stored firing stands: it silences its own alert for the cooldown, and is not given again.
    marks = [("p0", at(-5)), ("p3", at(0)), ("p1", at(7))]
    stored = spark.createDataFrame(marks, "alert_id string, tick timestamp")
    both = breaches.select(*columns).withColumn("new", F.lit(True)).unionByName(
        stored.withColumn("new", F.lit(False)), allowMissingColumns=True
    )
    want = alerts.apply_cooldown(both, "alert_id", "tick").filter("new").join(stored, ["alert_id", "tick"], "left_anti").select(*columns)
    got = alerts.fire_with_cooldown(rules, values, stored=stored)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_firings_stay_where_their_chunk_is_folded(spark):
    from decimal import Decimal as D

    rng = random.Random(11)
    n = 2 * alerts.CHUNK_ALERTS + 30
    points = [(m, rng.choice([None, float("nan"), *map(float, range(9))])) for m in range(0, 600, 5)]
    values = spark.createDataFrame([("p", at(m), "failure", v) for m, v in points], "project_id string, tick timestamp, type string, value double")
    limits = [None if k % 97 == 0 else D(rng.randrange(9)) + D(k) / 1000 for k in range(n)]
    rules = spark.createDataFrame(
        [(f"a{k}", "p", "failure", limit, True) for k, limit in enumerate(limits)],
        "alert_id string, project_id string, type string, threshold decimal(10,4), is_active boolean",
    )
    fired = alerts.fire_with_cooldown(rules, values)
    got: dict[str, list[int]] = {}
    for r in fired.collect():
        got.setdefault(r["alert_id"], []).append(int((r["tick"] - BASE).total_seconds() // 60))
    # A value that is not a number is above every limit, as in Spark's comparison.
    above = lambda v, limit: v is not None and limit is not None and not v <= float(limit)
    want = {f"a{k}": greedy([m for m, v in points if above(v, limit)]) for k, limit in enumerate(limits)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    # Firings, as many as alerts times ticks, meet no join, and a chunk is bounded.
    after, found, before = fired._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")
    assert found and "Join" not in after and "Aggregate" not in after and "Join" in before
