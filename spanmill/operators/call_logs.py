"""Captured provider calls turned into spans.

Calls are rows (call_id, path, request_body, response_body, http_status,
started_at, ended_at, headers); streamed calls come as rows (call_id, seq, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import pricing
from spanmill.functions.text import JS_SPACE, json_number
from spanmill.session import written

_ROUTE = r"(?s)\A/v1/p/([^/]+)/([^/]+)(/.*)\z"
SEQ_BLOCK = 4096


def parse_proxy_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Add project_id, provider and upstream_path of ``/v1/p/{project}/{provider}/{rest}``."""
    part = lambda i: F.nullif(F.regexp_extract(path, _ROUTE, i), F.lit(""))
    return df.withColumns({"project_id": part(1), "provider": part(2), "upstream_path": part(3)})


def _variant(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _kind(doc: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_variant(doc, path)), F.lit("MISSING"))


def _truthy(doc: Column, path: str) -> Column:
    """JavaScript truth of a JSON value: not missing, null, false, 0 or ''."""
    text = F.try_variant_get(doc, path, "string")
    kind = _kind(doc, path)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return (
        F.when(kind.isin("MISSING", "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(numeric, F.coalesce(json_number(_variant(doc, path)) != 0, F.lit(False)))
        .otherwise(True)
    )


def _string(doc: Column, path: str, default: str) -> Column:
    return F.when(_truthy(doc, path), F.try_variant_get(doc, path, "string")).otherwise(default)


def _stringified(doc: Column, body: str, path: str) -> Column:
    """Compact JSON of a value. A VARIANT would sort the keys of objects, the text keeps them."""
    nested = _kind(doc, path).startswith("ARRAY") | _kind(doc, path).startswith("OBJECT")
    return F.when(nested, F.get_json_object(body, path)).otherwise(F.to_json(_variant(doc, path)))


def _tokens(doc: Column, path: str) -> Column:
    return json_number(_variant(doc, path)).try_cast("int")


def _text_blocks(blocks: Column) -> Column:
    """Texts of the ``text`` blocks of a content array, concatenated."""
    texts = F.transform(
        F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("undefined")),
    )
    return F.array_join(texts, "")


def _with_docs(calls: DataFrame) -> DataFrame:
    return calls.withColumn("_req", F.try_parse_json("request_body")).withColumn(
        "_res", F.try_parse_json("response_body")
    )


def _openai(req: Column, res: Column) -> dict[str, Column]:
    messages = F.when(_truthy(req, "$.messages"), _stringified(req, "request_body", "$.messages"))
    prompt = F.when(_truthy(req, "$.prompt"), _stringified(req, "request_body", "$.prompt"))
    return {
        "model": _string(req, "$.model", "unknown"),
        "input": F.coalesce(messages, prompt, F.lit('""')),
        "is_streaming": _truthy(req, "$.stream"),
        "output": _string(res, "$.choices[0].message.content", ""),
        "input_tokens": _tokens(res, "$.usage.prompt_tokens"),
        "output_tokens": _tokens(res, "$.usage.completion_tokens"),
    }


def _anthropic(req: Column, res: Column) -> dict[str, Column]:
    def message_text(m: Column) -> Column:
        kind = _kind(m, "$.content")
        return (
            F.when(kind == "STRING", F.try_variant_get(m, "$.content", "string"))
            .when(
                kind.startswith("ARRAY"),
                _text_blocks(F.try_variant_get(m, "$.content", "array<variant>")),
            )
            .otherwise("")
        )

    messages = F.try_variant_get(req, "$.messages", "array<variant>")
    user_text = F.coalesce(F.array_join(F.transform(messages, message_text), "\n"), F.lit(""))
    system = F.when(_kind(req, "$.system") == "STRING", F.try_variant_get(req, "$.system", "string"))
    has_system = F.coalesce(system != "", F.lit(False))
    blocks = F.try_variant_get(res, "$.content", "array<variant>")
    return {
        "model": _string(req, "$.model", "unknown"),
        "input": F.when(has_system, F.concat(system, F.lit("\n\n"), user_text)).otherwise(user_text),
        "is_streaming": _truthy(req, "$.stream"),
        "output": F.coalesce(_text_blocks(blocks), F.lit("")),
        "input_tokens": _tokens(res, "$.usage.input_tokens"),
        "output_tokens": _tokens(res, "$.usage.output_tokens"),
    }


def _generic(req: Column, res: Column) -> dict[str, Column]:
    missing = F.lit(None).cast("int")
    return {
        "model": F.lit("unknown"),
        "input": _stringified(req, "request_body", "$"),
        "is_streaming": _truthy(req, "$.stream"),
        "output": _stringified(res, "response_body", "$"),
        "input_tokens": missing,
        "output_tokens": missing,
    }


def _extract(calls: DataFrame, fields) -> DataFrame:
    return (
        _with_docs(calls)
        .withColumns(fields(F.col("_req"), F.col("_res")))
        .drop("_req", "_res")
    )


def extract_openai_calls(calls: DataFrame) -> DataFrame:
    """Add model, input, is_streaming, output and token counts of OpenAI-shaped calls."""
    return _extract(calls, _openai)


def extract_anthropic_calls(calls: DataFrame) -> DataFrame:
    """The same for Anthropic-shaped calls; content may be text or blocks."""
    return _extract(calls, _anthropic)


def extract_generic_calls(calls: DataFrame) -> DataFrame:
    """Any other provider: the JSON itself is input and output."""
    return _extract(calls, _generic)


def dispatch_provider(calls: DataFrame) -> DataFrame:
    """Extract every call in the shape of its ``provider``, in one pass."""

    def fields(req: Column, res: Column) -> dict[str, Column]:
        openai, anthropic, generic = _openai(req, res), _anthropic(req, res), _generic(req, res)
        return {
            name: F.when(F.col("provider") == "openai", openai[name])
            .when(F.col("provider") == "anthropic", anthropic[name])
            .otherwise(generic[name])
            for name in generic
        }

    return _extract(calls, fields)


def _running_bytes(lines: DataFrame) -> DataFrame:
    """Add ``_bytes_upto``: bytes of a call up to and including each line.

    Two levels, because one call may hold most lines: totals per block of
    sequence numbers first, then a running sum inside each block.
    """
    sized = lines.withColumn("_block", F.floor(F.col("seq") / SEQ_BLOCK)).withColumn(
        "_bytes", (F.octet_length("line") + 1).cast("bigint")
    )
    by_block = Window.partitionBy("call_id").orderBy("_block")
    before = (
        sized.groupBy("call_id", "_block")
        .agg(F.sum("_bytes").alias("_total"))
        .withColumn("_before", F.sum("_total").over(by_block) - F.col("_total"))
        .drop("_total")
    )
    inside = Window.partitionBy("call_id", "_block").orderBy("seq")
    return (
        sized.withColumn("_inside", F.sum("_bytes").over(inside))
        .join(before, ["call_id", "_block"])
        .withColumn("_bytes_upto", F.col("_before") + F.col("_inside"))
        .drop("_block", "_bytes", "_inside", "_before")
    )


def sse_data_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Payloads of the ``data: `` lines; with a ``limit``, up to so many bytes of a call.

    ``truncated`` tells whether the call went over the limit (never without one). Every call also has
    one row without a payload, so that calls without any data do not vanish.
    Only the lines of calls over the limit need a running sum; the ids of those
    calls are written first, so the planner knows whether they can be broadcast.
    """
    if limit is None:
        totals = lines.select("call_id").distinct().withColumn("truncated", F.lit(False))
        return totals.unionByName(_data_payloads(lines.withColumn("truncated", F.lit(False))), allowMissingColumns=True)
    totals = lines.groupBy("call_id").agg(
        (F.sum((F.octet_length("line") + 1).cast("bigint")) > limit).alias("truncated")
    )
    over = written(totals.filter("truncated").select("call_id"), "streams-over-limit")
    whole = lines.join(over, "call_id", "left_anti").withColumn("truncated", F.lit(False))
    cut = _running_bytes(lines.join(over, "call_id", "left_semi")).filter(F.col("_bytes_upto") <= limit)
    kept = whole.unionByName(cut.drop("_bytes_upto").withColumn("truncated", F.lit(True)))
    return totals.unionByName(_data_payloads(kept), allowMissingColumns=True)


def _data_payloads(lines: DataFrame) -> DataFrame:
    # Spark's trim only knows the space.
    trimmed = F.regexp_replace("line", rf"\A[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")
    return (
        lines.withColumn("_trimmed", trimmed)
        .filter(F.col("_trimmed").startswith("data: "))
        .select("call_id", "truncated", "seq", F.expr("substring(_trimmed, 7)").alias("payload"))
    )


def _ordered(when: Column, *values: Column) -> Column:
    """Rows of a call in order, as structs; a call is one answer of a model."""
    return F.sort_array(F.collect_list(F.when(when, F.struct("seq", *values))))


def _joined(pieces: Column, separator: str) -> Column:
    return F.array_join(F.transform(pieces, lambda s: s["p"]), separator)


def assemble_sse_openai(data: DataFrame) -> DataFrame:
    """Concatenated deltas up to ``[DONE]``; the last usage wins; bad JSON is skipped."""
    doc = F.col("_doc")
    delta = F.nullif(F.try_variant_get(doc, "$.choices[0].delta.content", "string"), F.lit(""))
    parsed = data.withColumn("_doc", F.try_parse_json("payload")).withColumn("_delta", delta)
    collected = parsed.groupBy("call_id").agg(
        F.any_value("truncated").alias("truncated"),
        F.min(F.when(F.col("payload") == "[DONE]", F.col("seq"))).alias("_done"),
        _ordered(F.col("_delta").isNotNull(), F.col("_delta").alias("p")).alias("_pieces"),
        _ordered(
            _truthy(doc, "$.usage"),
            _tokens(doc, "$.usage.prompt_tokens").alias("input_tokens"),
            _tokens(doc, "$.usage.completion_tokens").alias("output_tokens"),
        ).alias("_usages"),
    )
    before_done = lambda s: F.col("_done").isNull() | (s["seq"] < F.col("_done"))
    usage = F.try_element_at(F.filter("_usages", before_done), F.lit(-1))
    return collected.select(
        "call_id",
        _joined(F.filter("_pieces", before_done), "").alias("output"),
        usage["input_tokens"].alias("input_tokens"),
        usage["output_tokens"].alias("output_tokens"),
        "truncated",
    )


def assemble_sse_anthropic(data: DataFrame) -> DataFrame:
    """Text deltas in order; tokens from the last start and the last delta event."""
    parsed = data.withColumn("_doc", F.try_parse_json("payload")).withColumn(
        "_type", F.try_variant_get("_doc", "$.type", "string")
    )
    is_text = (F.col("_type") == "content_block_delta") & (
        F.try_variant_get("_doc", "$.delta.type", "string") == "text_delta"
    )
    text = F.when(is_text, F.try_variant_get("_doc", "$.delta.text", "string"))
    doc = F.col("_doc")
    last = lambda event, path: F.coalesce(
        F.max_by(
            F.coalesce(_tokens(doc, path), F.lit(0)), F.when(F.col("_type") == event, F.col("seq"))
        ),
        F.lit(0),
    )
    return (
        parsed.withColumn("_text", text)
        .groupBy("call_id")
        .agg(
            _ordered(F.col("_text").isNotNull(), F.col("_text").alias("p")).alias("_pieces"),
            last("message_start", "$.message.usage.input_tokens").alias("input_tokens"),
            last("message_delta", "$.usage.output_tokens").alias("output_tokens"),
            F.any_value("truncated").alias("truncated"),
        )
        .select("call_id", _joined(F.col("_pieces"), "").alias("output"), "input_tokens", "output_tokens", "truncated")
    )


def assemble_sse_generic(data: DataFrame) -> DataFrame:
    """All payloads joined by newlines."""
    pieces = _ordered(F.col("payload").isNotNull(), F.col("payload").alias("p"))
    return data.groupBy("call_id").agg(
        _joined(pieces, "\n").alias("output"), F.any_value("truncated").alias("truncated")
    )


def _named_cost(df: DataFrame) -> DataFrame:
    """Proxy price of a call that reports usage, by provider."""
    priced = pricing.cost_proxy_openai(df, "_openai_cost")
    priced = pricing.cost_proxy_anthropic(priced, "_anthropic_cost")
    cost = F.when(F.col("provider") == "openai", F.col("_openai_cost")).when(
        F.col("provider") == "anthropic", F.col("_anthropic_cost")
    )
    return priced.withColumn("cost_usd", cost).drop("_openai_cost", "_anthropic_cost")


def calls_to_spans(
    calls: DataFrame, streams: DataFrame | None = None, header_prefix: str = "x-trace"
) -> DataFrame:
    """One span per captured call.

    ``streams`` holds the assembled answers (call_id, output, input_tokens,
    output_tokens, truncated) of streamed calls. Calls need ``project_id`` and
    ``provider`` (see :func:`parse_proxy_path`); a call that never reached the
    provider has a null ``http_status`` and its ``transport_error``.
    Trace, parent and name come from the ``{header_prefix}-trace-id``,
    ``-parent-span-id`` and ``-span-name`` headers.
    """
    if "transport_error" not in calls.columns:
        calls = calls.withColumn("transport_error", F.lit(None).cast("string"))
    parsed = dispatch_provider(calls)
    # JSON.parse fails on the text but not on a JSON null; the null has no fields to read.
    readable = F.try_parse_json("response_body").isNotNull()
    ok = F.col("http_status").between(200, 299)
    if streams is not None:
        assembled = streams.select(
            "call_id",
            F.struct("output", "input_tokens", "output_tokens", "truncated").alias("_stream"),
        )
        parsed = parsed.join(assembled, "call_id", "left")
    else:
        parsed = parsed.withColumn(
            "_stream",
            F.lit(None).cast(
                "struct<output:string,input_tokens:int,output_tokens:int,truncated:boolean>"
            ),
        )
    streamed = F.col("_stream").isNotNull()
    use_body = ok & readable
    header = lambda name: F.nullif(
        F.element_at("headers", F.lit(f"{header_prefix}-{name}")), F.lit("")
    )
    named = parsed.withColumns(
        {
            "output": F.when(F.col("http_status").isNull(), F.lit(None))
            .when(streamed, F.col("_stream.output"))
            .when(use_body, F.col("output"))
            .otherwise(F.col("response_body")),
            "input_tokens": F.when(streamed, F.col("_stream.input_tokens")).when(
                use_body, F.col("input_tokens")
            ),
            "output_tokens": F.when(streamed, F.col("_stream.output_tokens")).when(
                use_body, F.col("output_tokens")
            ),
            "status": F.when(F.coalesce(ok, F.lit(False)), "success").otherwise("error"),
            "error_message": F.when(F.col("http_status").isNull(), F.col("transport_error")).when(
                ~ok & ~streamed, F.concat(F.lit("Upstream returned "), F.col("http_status"))
            ),
            "metadata": F.when(F.col("_stream.truncated"), '{"truncated":true}').otherwise("{}"),
            "trace_id": F.coalesce(header("trace-id"), F.concat(F.lit("trace-"), F.col("call_id"))),
            "parent_span_id": header("parent-span-id"),
            "name": F.coalesce(header("span-name"), F.concat("provider", F.lit(".proxy"))),
        }
    )
    return _named_cost(named).select(
        F.concat(F.lit("span-"), F.col("call_id")).alias("span_id"),
        "trace_id",
        "parent_span_id",
        "project_id",
        "name",
        F.col("name").alias("agent_name"),
        "model",
        "provider",
        "input",
        "output",
        "input_tokens",
        "output_tokens",
        "cost_usd",
        (F.unix_millis("ended_at") - F.unix_millis("started_at")).cast("int").alias("latency_ms"),
        "status",
        "error_message",
        "metadata",
        "started_at",
        "ended_at",
    )
