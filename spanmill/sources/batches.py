"""Readers for span envelopes and legacy spans, and the table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.schema import LEGACY_SPANS


# --- Fixed values: fields of a span on the wire ---
WIRE_FIELDS = (
    "spanId", "traceId", "parentSpanId", "projectId", "name", "model", "provider", "input", "output",
    "agentName", "inputTokens", "outputTokens", "costUsd", "latencyMs", "status", "errorMessage",
    "metadata", "startedAt", "endedAt",
)
# One VARIANT per field keeps the JSON type of each value for the checks.
RAW_SPAN = "struct<" + ",".join(f"{name}:variant" for name in WIRE_FIELDS) + ">"


def envelopes(bodies: DataFrame, body: str = "value") -> DataFrame:
    """Parse envelope texts to (batch_id, spans); ``spans`` is an array of raw spans.

    Unreadable JSON or a missing list gives null. The id is a digest of the body,
    so a redelivered or recomputed batch keeps it.
    """
    parsed = F.try_parse_json(F.col(body))
    return bodies.select(
        *[c for c in bodies.columns if c not in (body, "batch_id")],
        (F.col("batch_id") if "batch_id" in bodies.columns else F.sha2(F.col(body), 256)).alias(
            "batch_id"
        ),
        F.try_variant_get(parsed, "$.spans", f"array<{RAW_SPAN}>").alias("spans"),
    )


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Envelopes from text files with one JSON body per line, plain or ``.gz``.

    ``options`` are those of the file source; ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``
    bound a micro-batch, so a stream that was paused catches up in several.
    """
    reader = spark.readStream if streaming else spark.read
    return envelopes(reader.options(**options).text(path))


def explode_spans(batches: DataFrame) -> DataFrame:
    """One row per span: (batch_id, position, span), the fields as VARIANT."""
    others = [c for c in batches.columns if c != "spans"]
    # The outer form: the inner one makes Spark parse each body again in a filter.
    rows = batches.select(*others, F.posexplode_outer("spans").alias("position", "span"))
    return rows.filter(F.col("position").isNotNull())


def read_span_batches(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """One row per span of ``{"spans": [...]}`` envelopes, plain or gzip (see ``read_envelopes``)."""
    return explode_spans(read_envelopes(spark, path, streaming, **options))


# --- Fixed values: column and wire name of a span field ---
WIRE_NAMES = {
    "span_id": "spanId",
    "trace_id": "traceId",
    "parent_span_id": "parentSpanId",
    "project_id": "projectId",
    "name": "name",
    "model": "model",
    "provider": "provider",
    "input": "input",
    "output": "output",
    "agent_name": "agentName",
    "input_tokens": "inputTokens",
    "output_tokens": "outputTokens",
    "cost_usd": "costUsd",
    "latency_ms": "latencyMs",
    "status": "status",
    "error_message": "errorMessage",
}
BATCH_SIZE = 100


def wire_span(columns: list[str]) -> Column:
    """Span columns as a wire struct; null fields vanish in its JSON."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = [F.col(c).alias(w) for c, w in WIRE_NAMES.items() if c in columns]
    if "metadata" in columns:
        fields.append(F.from_json("metadata", "variant").alias("metadata"))
    fields.append(iso("started_at").alias("startedAt"))
    if "ended_at" in columns:
        fields.append(iso("ended_at").alias("endedAt"))
    return F.struct(*fields)


def span_micro_batches(spans: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Envelopes (batch_id, value) of at most ``size`` spans in order of arrival.

    Sequence numbers must be unique; every range of ``size`` numbers is a batch.
    """
    return envelope_bodies(
        spans.select("arrival_seq", F.to_json(wire_span(spans.columns)).alias("_json")), size
    )


def envelope_bodies(wire: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """The same from rows (arrival_seq, _json)."""
    numbered = wire.withColumn("batch_id", F.floor(F.col("arrival_seq") / size).cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("arrival_seq", "_json")))
    body = F.concat(
        F.lit('{"spans":['),
        F.array_join(F.transform(ordered, lambda s: s["_json"]), ","),
        F.lit("]}"),
    )
    return numbered.groupBy("batch_id").agg(body.alias("value"))


def write_envelopes(batches: DataFrame, path: str) -> None:
    """Envelope bodies as gzip text, one per line."""
    batches.select("value").write.option("compression", "gzip").text(path)


def read_legacy_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEGACY_SPANS).json(path)


def legacy_ingest_batch(batch: DataFrame, project_id: str | Column) -> DataFrame:
    """Stamp the project on a legacy batch and keep one row per span id."""
    project = F.lit(project_id) if isinstance(project_id, str) else project_id
    stamped = batch.withColumn("projectId", project)
    order = "arrival_seq" if "arrival_seq" in batch.columns else "startTimeMs"
    first = F.min_by(F.struct(*stamped.columns), F.col(order)).alias("_s")
    return stamped.groupBy(F.col("spanId").alias("_id")).agg(first).select("_s.*")


def legacy_spans_to_spans(legacy: DataFrame) -> DataFrame:
    """Rename the legacy columns and turn epoch milliseconds into timestamps."""
    return legacy.select(
        F.col("spanId").alias("span_id"),
        F.col("traceId").alias("trace_id"),
        F.col("parentSpanId").alias("parent_span_id"),
        F.col("projectId").alias("project_id"),
        "name",
        "kind",
        F.col("durationMs").alias("latency_ms"),
        "status",
        F.col("statusMessage").alias("error_message"),
        F.coalesce("attributes", F.lit("{}")).alias("metadata"),
        F.coalesce("events", F.lit("[]")).alias("events"),
        F.timestamp_millis("startTimeMs").alias("started_at"),
        F.timestamp_millis("endTimeMs").alias("ended_at"),
    )


def spans_sink(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Write spans as Parquet by project and day.

    The rebalance hint lets the adaptive planner split the files of a dominant
    project and merge tiny ones.
    """
    dated = spans.withColumn("date", F.to_date("started_at"))
    (
        dated.hint("rebalance", "project_id", "date")
        .sortWithinPartitions("project_id", "date", "started_at")
        .write.mode(mode)
        .partitionBy("project_id", "date")
        .parquet(path)
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans written by :func:`spans_sink`, also in folders of landed batches."""
    return spark.read.option("basePath", path).parquet(path).drop("landed")


def csv_lines(df: DataFrame) -> DataFrame:
    """One ``value`` per row: RFC 4180 fields, null as empty, quotes (doubled inside) only
    around text with a comma, a quote or a line feed."""
    fields = []
    for name, kind in df.dtypes:
        field = F.date_format(F.col(f"`{name}`"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") if kind.startswith("timestamp") else F.col(f"`{name}`").cast("string")
        quoted = F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))
        needed = field.contains(",") | field.contains('"') | field.contains("\n")
        fields.append(F.coalesce(F.when(needed, quoted).otherwise(field), F.lit("")))
    return df.select(F.concat_ws(",", *fields).alias("value"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose part files make one file in the order of their names: the header is the
    first part alone, and ordered input stays ordered."""
    names = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"c{k} string" for k in range(len(df.columns))))
    csv_lines(names).coalesce(1).unionAll(csv_lines(df)).write.text(path)
