"""Checks on raw spans. Every check is a column, so rejects keep their reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.text import json_number, longer_than
from spanmill.schema import SPAN_STATUSES, SPANS

_UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
_ZULU = r"\A\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z\z"
_ZULU_OR_OFFSET = r"\A\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d{2}:?\d{2})\z"

# --- Fixed values: text fields as (wire name, required, longest) ---
TEXT_FIELDS = (
    ("spanId", True, 128),
    ("traceId", True, 128),
    ("parentSpanId", False, 128),
    ("name", True, 512),
    ("model", False, 128),
    ("provider", False, 64),
    ("errorMessage", False, 4096),
)
EDGE_TEXT_LIMIT = 100_000
EDGE_BATCH_LIMIT = 100
MAX_INT = 2_147_483_647


def _field(span: Column, name: str) -> Column:
    return span[name]


def _text(span: Column, name: str) -> Column:
    return F.try_variant_get(span[name], "$", "string")


def _kind(span: Column, name: str) -> Column:
    return F.schema_of_variant(_field(span, name))


def _number(span: Column, name: str) -> Column:
    return json_number(span[name])


def _text_ok(span: Column, name: str, required: bool, longest: int | None) -> Column:
    value = _text(span, name)
    ok = _kind(span, name) == "STRING"
    if required:
        ok = ok & (value != "")
    if longest is not None:
        ok = ok & ~longer_than(value, longest)
    return ok if required else _field(span, name).isNull() | ok


def _time_ok(span: Column, name: str, required: bool, allow_offset: bool) -> Column:
    value = _text(span, name)
    ok = (
        (_kind(span, name) == "STRING")
        & value.rlike(_ZULU_OR_OFFSET if allow_offset else _ZULU)
        & F.try_to_timestamp(value).isNotNull()
    )
    return ok if required else _field(span, name).isNull() | ok


def _checks(span: Column, edge: bool, allow_offset: bool) -> list[tuple[str, Column]]:
    checks = [(n, _text_ok(span, n, required, longest)) for n, required, longest in TEXT_FIELDS]
    text_limit = EDGE_TEXT_LIMIT if edge else None
    checks += [(n, _text_ok(span, n, False, text_limit)) for n in ("input", "output")]
    if edge:
        checks.append(("projectId", _text_ok(span, "projectId", True, 128)))
    else:
        checks.append(("agentName", _text_ok(span, "agentName", False, 256)))
        project_ok = (_kind(span, "projectId") == "STRING") & _text(span, "projectId").rlike(_UUID)
        checks.append(("projectId", project_ok))
    for name in ("inputTokens", "outputTokens", "latencyMs"):
        value = _number(span, name)
        whole = value.between(0, MAX_INT) & (value == F.floor(value))
        checks.append((name, _field(span, name).isNull() | whole))
    cost_ok = _number(span, "costUsd") >= 0
    checks.append(("costUsd", _field(span, "costUsd").isNull() | cost_ok))
    status_ok = (_kind(span, "status") == "STRING") & _text(span, "status").isin(*SPAN_STATUSES)
    checks.append(("status", status_ok))
    metadata = _field(span, "metadata")
    checks.append(("metadata", metadata.isNull() | _kind(span, "metadata").startswith("OBJECT")))
    checks.append(("startedAt", _time_ok(span, "startedAt", True, allow_offset)))
    checks.append(("endedAt", _time_ok(span, "endedAt", False, allow_offset)))
    return checks


def _verdicts(span: Column, edge: bool, allow_offset: bool) -> list[tuple[str, Column]]:
    """The checks, false where one has no answer."""
    return [(name, F.coalesce(ok, F.lit(False))) for name, ok in _checks(span, edge, allow_offset)]


def _failed(verdicts: list[tuple[str, Column]]) -> Column:
    return F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in verdicts])


def failed_checks(span: Column, edge: bool = False, allow_offset: bool = False) -> Column:
    """Names of the wire fields of a raw span that break a rule, separated by commas.

    Text, not an array: dropping nulls from an array takes a higher-order
    function, and all checks inside one would run without code generation.
    """
    return _failed(_verdicts(span, edge, allow_offset))


def span_columns(span: Column, edge: bool = False) -> list[Column]:
    """Typed columns of a valid raw span."""
    integer = lambda name: _number(span, name).try_cast("int")
    agent = F.lit(None).cast("string") if edge else _text(span, "agentName")
    return [
        _text(span, "spanId").alias("span_id"),
        _text(span, "traceId").alias("trace_id"),
        _text(span, "parentSpanId").alias("parent_span_id"),
        _text(span, "projectId").alias("project_id"),
        _text(span, "name").alias("name"),
        _text(span, "model").alias("model"),
        _text(span, "provider").alias("provider"),
        _text(span, "input").alias("input"),
        _text(span, "output").alias("output"),
        agent.alias("agent_name"),
        integer("inputTokens").alias("input_tokens"),
        integer("outputTokens").alias("output_tokens"),
        integer("latencyMs").alias("latency_ms"),
        _number(span, "costUsd").alias("cost_usd"),
        _text(span, "status").alias("status"),
        _text(span, "errorMessage").alias("error_message"),
        F.coalesce(F.to_json(_field(span, "metadata")), F.lit("{}")).alias("metadata"),
        F.try_to_timestamp(_text(span, "startedAt")).alias("started_at"),
        F.try_to_timestamp(_text(span, "endedAt")).alias("ended_at"),
    ]


def check_spans(raw: DataFrame, allow_offset: bool = False) -> DataFrame:
    """Add ``reasons``, the failed checks of ``span`` (empty text for a valid one)."""
    return raw.withColumn("reasons", failed_checks(F.col("span"), False, allow_offset))


def typed_spans(raw: DataFrame, allow_offset: bool = False) -> DataFrame:
    """Every raw span as typed columns with its ``reasons``, in one pass.

    Rejects also get their ``payload``. Write this once where both the valid and
    the rejected rows are needed.

    Reasons and payload use each check, side by side in one projection: what is used twice there
    Spark generates as a function of its own. In one method all checks together are more than the
    JVM compiles (8000 bytes), and that method is then interpreted for every span.
    """
    span = F.col("span")
    carried = [c for c in raw.columns if c != "span"]
    verdicts = _verdicts(span, False, allow_offset)
    valid = reduce(lambda a, b: a & b, [ok for _, ok in verdicts])
    payload = F.when(~valid, F.to_json(span))
    return raw.select(*carried, *span_columns(span), _failed(verdicts).alias("reasons"), payload.alias("payload"))


def split_typed(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid spans, and rejects with their reasons as an array."""
    typed_only = [f.name for f in SPANS.fields] + ["reasons", "payload"]
    carried = [c for c in typed.columns if c not in typed_only]
    valid = typed.filter(F.col("reasons") == "").drop("reasons", "payload")
    rejected = typed.filter(F.col("reasons") != "").select(
        *carried, "span_id", "payload", F.split("reasons", ",").alias("reasons")
    )
    return valid, rejected


def validate_spans(raw: DataFrame, allow_offset: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split raw spans into typed valid rows and rejects with their reasons.

    Input has a column ``span`` as ``explode_spans`` makes it; other columns are
    carried along.
    """
    return split_typed(typed_spans(raw, allow_offset))


def check_batches(batches: DataFrame, allow_offset: bool = False) -> DataFrame:
    """Edge verdict per envelope, without a shuffle: ``valid`` and ``n_spans``, ``n_bad``.

    One bad span, an empty list or more than 100 spans reject the whole batch.
    """
    bad = F.filter("spans", lambda s: failed_checks(s, True, allow_offset) != "")
    checked = batches.withColumn("n_spans", F.coalesce(F.size("spans"), F.lit(-1))).withColumn(
        "n_bad", F.size(bad)
    )
    valid = F.col("n_spans").between(1, EDGE_BATCH_LIMIT) & (F.col("n_bad") == 0)
    return checked.withColumn("valid", F.coalesce(valid, F.lit(False)))


def validate_batches(batches: DataFrame, allow_offset: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed spans of the accepted envelopes, and the rejected envelopes."""
    checked = check_batches(batches, allow_offset)
    verdict = ("n_spans", "n_bad", "valid")
    carried = [c for c in batches.columns if c != "spans"]
    accepted = (
        checked.filter("valid")
        .select(*carried, F.posexplode("spans").alias("position", "span"))
        .select(*carried, "position", *span_columns(F.col("span"), edge=True))
    )
    return accepted, checked.filter(~F.col("valid")).select(*carried, *verdict)


def check_project_match(batches: DataFrame, key_project: str | Column) -> DataFrame:
    """Add ``matches`` and ``offending_span_id``: the first span of another project."""
    project = F.lit(key_project) if isinstance(key_project, str) else key_project
    foreign = F.filter(
        "spans", lambda s: F.coalesce(_text(s, "projectId") != project, F.lit(True))
    )
    return (
        batches.withColumn("_foreign", foreign)
        .withColumn("matches", F.size("_foreign") == 0)
        .withColumn("offending_span_id", _text(F.get("_foreign", F.lit(0)), "spanId"))
        .drop("_foreign")
    )
