import json
import re

import pytest

from spanmill.operators import validate
from spanmill.session import COMPILED_BYTES, small_methods
from spanmill.sources import batches

GOOD = {
    "spanId": "s1",
    "traceId": "t1",
    "projectId": "00000000-0000-4000-8000-000000000000",
    "name": "n",
    "status": "success",
    "startedAt": "2024-01-01T00:00:00.000Z",
}


def reasons(spark, cases, **kw):
    """Failed checks of each changed copy of the good span, in one job."""
    spans = [{k: v for k, v in {**GOOD, **c}.items() if v != "absent"} for c in cases]
    body = spark.createDataFrame([(json.dumps({"spans": spans}),)], "value string")
    raw = batches.explode_spans(batches.envelopes(body))
    checked = validate.check_spans(raw, **kw).orderBy("position")
    return [r["reasons"].split(",") if r["reasons"] else [] for r in checked.select("reasons").collect()]


CASES = [
    ({}, []),
    ({"spanId": ""}, ["spanId"]),
    ({"spanId": "x" * 128}, []),
    ({"spanId": "x" * 129}, ["spanId"]),
    # 65 characters outside the basic plane are 130 UTF-16 units.
    ({"spanId": "😀" * 65}, ["spanId"]),
    ({"spanId": "😀" * 64}, []),
    ({"traceId": 5}, ["traceId"]),
    ({"parentSpanId": None}, ["parentSpanId"]),
    ({"projectId": "p0"}, ["projectId"]),
    ({"name": "absent"}, ["name"]),
    ({"model": "m" * 129}, ["model"]),
    ({"provider": "p" * 65}, ["provider"]),
    ({"agentName": "a" * 257}, ["agentName"]),
    ({"inputTokens": -1}, ["inputTokens"]),
    ({"inputTokens": 1.5}, ["inputTokens"]),
    ({"inputTokens": 5.0}, []),
    ({"inputTokens": "5"}, ["inputTokens"]),
    ({"costUsd": 0.25}, []),
    ({"costUsd": -0.1}, ["costUsd"]),
    ({"status": "running"}, ["status"]),
    ({"errorMessage": "e" * 4097}, ["errorMessage"]),
    ({"metadata": {"a": [1]}}, []),
    ({"metadata": [1]}, ["metadata"]),
    ({"startedAt": "2024-01-01"}, ["startedAt"]),
    ({"startedAt": "2024-02-30T00:00:00Z"}, ["startedAt"]),
    ({"startedAt": "2024-01-01T00:00:00+00:00"}, ["startedAt"]),
    ({"endedAt": "soon"}, ["endedAt"]),
    ({"status": "nope", "name": ""}, ["name", "status"]),
]


def test_rules(spark):
    got = reasons(spark, [changes for changes, _ in CASES])
    for (changes, expected), found in zip(CASES, got, strict=True):
        assert found == expected, changes


def test_offsets_on_request(spark):
    assert reasons(spark, [{"startedAt": "2024-01-01T02:00:00+02:00"}], allow_offset=True) == [[]]


def test_types_and_defaults(spark):
    span = {**GOOD, "inputTokens": 7, "costUsd": 1, "metadata": {"b": 1, "a": "x"}}
    body = spark.createDataFrame([(json.dumps({"spans": [span, {**GOOD, "spanId": "s2"}]}),)], "value string")
    valid, rejected = validate.validate_spans(batches.explode_spans(batches.envelopes(body)))
    first, second = valid.orderBy("span_id").collect()
    assert (first["input_tokens"], first["cost_usd"]) == (7, 1.0)
    assert json.loads(first["metadata"]) == {"a": "x", "b": 1}
    assert second["metadata"] == "{}" and second["ended_at"] is None
    assert rejected.count() == 0


def batch_verdict(spark, spans):
    body = spark.createDataFrame([(json.dumps({"spans": spans}),)], "value string")
    return validate.check_batches(batches.envelopes(body)).first()


def test_batches(spark):
    assert batch_verdict(spark, [GOOD] * 100)["valid"]
    assert not batch_verdict(spark, [GOOD] * 101)["valid"]
    assert not batch_verdict(spark, [])["valid"]
    mixed = batch_verdict(spark, [GOOD, {**GOOD, "name": ""}])
    assert (mixed["valid"], mixed["n_bad"]) == (False, 1)
    assert batch_verdict(spark, [{**GOOD, "projectId": "short"}])["valid"]
    assert not batch_verdict(spark, [{**GOOD, "input": "x" * 100_001}])["valid"]


def test_batches_strip_the_agent(spark):
    body = spark.createDataFrame([(json.dumps({"spans": [{**GOOD, "agentName": "a"}]}),)], "value string")
    accepted, rejected = validate.validate_batches(batches.envelopes(body))
    assert accepted.first()["agent_name"] is None and rejected.count() == 0


def test_broken_bodies(spark):
    bodies = ["junk", '{"spans": 5}', "{}", '{"spans": [1, null]}']
    envelopes = batches.envelopes(spark.createDataFrame([(b,) for b in bodies], "value string"))
    assert [r["valid"] for r in validate.check_batches(envelopes).collect()] == [False] * 4
    raw = batches.explode_spans(envelopes)
    valid, rejected = validate.validate_spans(raw)
    assert valid.count() == 0 and rejected.count() == 2


def test_project_match(spark):
    spans = [GOOD, {**GOOD, "spanId": "x", "projectId": "other"}, {**GOOD, "spanId": "y", "projectId": "z"}]
    body = spark.createDataFrame([(json.dumps({"spans": spans}),)], "value string")
    row = validate.check_project_match(batches.envelopes(body), GOOD["projectId"]).first()
    assert (row["matches"], row["offending_span_id"]) == (False, "x")


def test_reasons_and_payload_of_typed_rows(spark):
    spans = [{k: v for k, v in {**GOOD, **c}.items() if v != "absent"} for c, _ in CASES]
    body = spark.createDataFrame([(json.dumps({"spans": spans}),)], "value string")
    rows = validate.typed_spans(batches.explode_spans(batches.envelopes(body))).orderBy("position").collect()
    for span, (_, expected), row in zip(spans, CASES, rows, strict=True):
        assert row["reasons"] == ",".join(expected)
        assert (row["payload"] is None) == (not expected), span
        if expected:
            assert json.loads(row["payload"])["projectId"] == span["projectId"]


def test_the_jvm_compiles_the_checks(spark, tmp_path, capsys):
    """No generated method of the checks has more than the 8000 bytes that the JVM compiles."""
    (tmp_path / "a.json").write_text(json.dumps({"spans": [GOOD]}) + "\n")
    validate.typed_spans(batches.read_span_batches(spark, str(tmp_path))).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= COMPILED_BYTES


def test_small_methods_only_inside(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), small_methods(spark):
        assert spark.conf.get(name) == str(COMPILED_BYTES)
        raise ValueError
    assert spark.conf.get(name) == before
