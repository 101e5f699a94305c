"""Structured Streaming jobs. They reuse the batch operators on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from spanmill.functions.pii import scrub_pii
from spanmill.functions.pricing import compute_cost
from spanmill.functions.stats import top_k
from spanmill.operators.alerts import COOLDOWN_MINUTES, fire_with_cooldown, metric_values
from spanmill.operators.enrich import first_agents, insert_spans_first_wins, resolve_agent_name, root_agents
from spanmill.operators.validate import split_typed, typed_spans
from spanmill.session import small_methods, written
from spanmill.sources import key_runs
from spanmill.sources.tables import read_traces, write_batch, write_trace_partials

WATERMARK = "10 minutes"
FEED_SIZE = 200
FLUSH_INTERVAL = "500 milliseconds"
#: A micro-batch of the ingest job writes several tables, so it gathers for a while.
INGEST_INTERVAL = "1 minute"


def micro_batch_writer(df: DataFrame, interval: str | None = FLUSH_INTERVAL) -> DataStreamWriter:
    """Writer that flushes at the client's interval, or drains the source and stops."""
    writer = df.writeStream
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


#: Tables of the ingest job that are looked up by key, with the rows they hold.
SEEN_IDS, SEEN_SCHEMA = "seen_ids", "span_id string, arrival_seq bigint"
ROOT_AGENTS, AGENT_SCHEMA = "root_agents", "trace_id string, agent_name string, arrival_seq bigint"
#: What the cooldown reads of stored firings.
FIRED_SCHEMA = "alert_id string, tick timestamp, ingest_batch int, date date"


def _numbered(staged: DataFrame, batch_id: int) -> DataFrame:
    """Dense numbers within the batch, above those of all batches before.

    The row numbers of the tasks are made dense by the sizes of the tasks before: one row per
    task, so neither the number of tasks nor of rows can run into the next batch. These few rows are
    broadcast: the planner takes their size from that of the spans, and beyond its threshold it would
    shuffle and sort all spans by the number of their task, a partition for each task.
    """
    task = F.shiftright("_row", 33)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    number = F.lit(batch_id).cast("bigint") * (1 << 40) + F.col("_before") + inside
    return (
        staged.withColumn("_task", task).join(F.broadcast(offsets), "_task")
        .withColumn("arrival_seq", number).drop("_task", "_before", "_row")
    )


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _remove(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ingest_micro_batch(raw: DataFrame, batch_id: int, root: str, allow_offset: bool = False) -> None:
    """Validate, enrich and store one micro-batch of raw spans (see ``read_span_batches``).

    Writes ``spans``, ``trace_partials`` and ``rejects`` below ``root``, and two narrow tables of
    runs (see ``key_runs``): every id stored so far, and the agent of every root. A span whose id
    any earlier micro-batch stored is dropped before it counts anywhere, whenever it comes and
    whatever its start or project; so how the input is cut into micro-batches doesn't change what is
    stored. An agent comes from the roots of this batch or of any before. Checks and redaction
    (of rejects too) run once, into a staged table that the later steps read and that goes
    afterwards. A batch that runs again replaces all it wrote.
    """
    spark = raw.sparkSession
    counted = "arrival_seq" in raw.columns
    if not counted:
        raw = raw.withColumn("_row", F.monotonically_increasing_id())
    typed = scrub_pii(typed_spans(raw, allow_offset), ("input", "output", "payload"))
    staged = f"{root}/staged/ingest_batch={batch_id}"
    with small_methods(spark):
        typed.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(typed.schema).parquet(staged)
    rows = rows if counted else _numbered(rows, batch_id)
    valid, rejected = split_typed(rows)
    write_batch(rejected, f"{root}/rejects", batch_id)
    seen_ids, root_agent_rows = f"{root}/{SEEN_IDS}", f"{root}/{ROOT_AGENTS}"
    for table, key, schema in ((seen_ids, "span_id", SEEN_SCHEMA), (root_agent_rows, "trace_id", AGENT_SCHEMA)):
        key_runs.merge(spark, table, key, schema, batch_id)
    seen = key_runs.lookup(spark, seen_ids, "span_id", SEEN_SCHEMA, valid.select("span_id"), batch_id)
    # At most the ids of this batch; written, so that the planner knows their size.
    seen = written(seen.select("span_id").distinct(), "seen-ids")
    first = insert_spans_first_wins(valid.join(seen, "span_id", "left_anti"))
    # Prices are looked up only where the cost is stored, not by every step that reads ids and names.
    priced = compute_cost(first)
    own_agents = root_agents(first)
    open_traces = first.filter(F.col("parent_span_id").isNotNull()).select("trace_id")
    earlier = key_runs.lookup(spark, root_agent_rows, "trace_id", AGENT_SCHEMA, open_traces, batch_id)
    agents = first_agents(own_agents.unionByName(earlier))
    named = resolve_agent_name(priced, agents).withColumn("date", F.to_date("started_at"))
    write_batch(named.hint("rebalance", "project_id", "date"), f"{root}/spans", batch_id, "project_id", "date")
    write_trace_partials(priced, f"{root}/trace_partials", batch_id)
    key_runs.record(first.select("span_id", "arrival_seq"), seen_ids, "span_id", batch_id)
    key_runs.record(own_agents, root_agent_rows, "trace_id", batch_id)
    _remove(spark, staged)


def stream_ingest(
    raw: DataFrame,
    root: str,
    checkpoint: str,
    interval: str | None = INGEST_INTERVAL,
    allow_offset: bool = False,
) -> StreamingQuery:
    """Raw spans of a stream into the tables below ``root``, each span id once."""
    return (
        micro_batch_writer(raw, interval)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, n: ingest_micro_batch(batch, n, root, allow_offset))
        .start()
    )


def stream_dedup(spans: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First delivery of each span id within the watermark; older ids leave the state."""
    return spans.withWatermark("started_at", watermark).dropDuplicatesWithinWatermark(["span_id"])


def stream_trace_rollup(
    spans: DataFrame, root: str, checkpoint: str, interval: str | None = FLUSH_INTERVAL
) -> StreamingQuery:
    """Running trace totals as partial rows per micro-batch (read with ``read_traces``).

    Traces never expire, so keeping them in streaming state would grow for ever;
    the partial rows need no state.
    """
    return (
        micro_batch_writer(spans, interval)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, n: write_trace_partials(batch, root, n))
        .start()
    )


def stream_live_feed(
    spans: DataFrame,
    project_id: str | None = None,
    errors_only: bool = False,
    model: str | None = None,
    agent_name: str | None = None,
) -> DataFrame:
    """Entries of the live feed with the wanted filters."""
    kept = spans
    if project_id is not None:
        kept = kept.filter(F.col("project_id") == project_id)
    if errors_only:
        kept = kept.filter("status = 'error'")
    if model is not None:
        kept = kept.filter(F.col("model") == model)
    if agent_name is not None:
        kept = kept.filter(F.col("agent_name") == agent_name)
    return kept.select(
        "project_id", "span_id", "trace_id", "name", "agent_name", "model", "provider", "status",
        F.left("input", F.lit(100)).alias("input_preview"),
        "input_tokens", "output_tokens", "cost_usd", "latency_ms", "started_at", "arrival_seq",
    )


def latest_feed(feed: DataFrame, size: int = FEED_SIZE) -> DataFrame:
    """Newest entries per project of a stored feed."""
    return top_k(feed, ["project_id"], [F.desc("arrival_seq"), F.desc("span_id")], size)


def live_feed_by_agent(spans: DataFrame, agent_name: str, project_id: str | None = None) -> DataFrame:
    return stream_live_feed(spans, project_id, agent_name=agent_name)


def stream_trace_feed(spans: DataFrame, trace_id: str) -> DataFrame:
    """Spans of one trace as they arrive."""
    return spans.filter(F.col("trace_id") == trace_id)


def _watermarked(spans: DataFrame, at: str, watermark: str) -> DataFrame:
    return spans.withWatermark(at, watermark) if spans.isStreaming else spans


def stream_throughput(
    spans: DataFrame, seconds: int = 5, at: str = "started_at", watermark: str = WATERMARK
) -> DataFrame:
    """Calls per second of each project in tumbling windows."""
    return (
        _watermarked(spans, at, watermark)
        .groupBy("project_id", F.window(at, f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("calls"))
        .select(
            "project_id",
            F.col("w.start").alias("window_start"),
            "calls",
            (F.col("calls") / seconds).alias("calls_per_sec"),
        )
    )


def known_models(spans: DataFrame) -> DataFrame:
    """Models seen so far; the state is one row per model."""
    return spans.filter(F.col("model").isNotNull()).select("model").dropDuplicates(["model"])


def stream_alert_metrics(
    spans: DataFrame, minutes: int = 5, watermark: str = WATERMARK
) -> DataFrame:
    """Error rate, cost and p95 latency per project in tumbling windows.

    Equal latencies are counted before the shuffle, so a dominant project costs one row per task and
    window. The state is one row per project and window, which holds the counts of its latencies.
    """
    p95 = F.percentile("latency_ms", F.lit(0.95))
    return (
        _watermarked(spans, "started_at", watermark)
        .groupBy("project_id", F.window("started_at", f"{minutes} minutes").alias("w"))
        .agg(
            (F.count_if(F.col("status") == "error") * 100.0 / F.count("*")).alias("error_rate"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_spike"),
            F.coalesce(p95, F.lit(0.0)).alias("latency_p95"),
        )
        .select("project_id", F.col("w.end").alias("tick"), "error_rate", "cost_spike", "latency_p95")
    )


def _firings_before(spark: SparkSession, root: str, batch_id: int, since) -> DataFrame | None:
    """Firings (alert_id, tick) of earlier micro-batches on the days from ``since`` on (a rerun must
    not see its own); only folders of these days are read."""
    if not _exists(spark, root):
        return None
    stored = spark.read.schema(FIRED_SCHEMA).option("basePath", root).parquet(root)
    recent = stored.filter(F.col("ingest_batch") < batch_id).filter(F.col("date") >= F.to_date(since))
    return recent.filter(F.col("tick") > since).select("alert_id", "tick")


def _failures(traces: DataFrame, ticks: DataFrame, minutes: int) -> DataFrame:
    """Failed traces per project and tick: those that started in the window of a tick."""
    end = F.window("started_at", f"{minutes} minutes")["end"]
    failed = traces.filter("status = 'error'").select("project_id", end.alias("tick"))
    counts = failed.groupBy("project_id", "tick").agg(F.count("*").cast("double").alias("value"))
    wanted = ticks.select("project_id", "tick").distinct()
    return counts.join(wanted, ["project_id", "tick"], "left_semi").select(
        "project_id", "tick", F.lit("failure").alias("type"), "value"
    )


def cooldown_micro_batch(
    metrics: DataFrame,
    batch_id: int,
    alerts: DataFrame,
    root: str,
    minutes: int = COOLDOWN_MINUTES,
    traces_root: str | None = None,
    window_minutes: int = 5,
) -> None:
    """Append the firings of one micro-batch of metrics to the table at ``root``.

    Firings already stored take part in the cooldown as firings that stand. With
    ``traces_root`` (see ``write_trace_partials``) failed traces of the same ticks are
    counted too, so alerts of all four types fire.
    """
    spark = metrics.sparkSession
    staged = f"{root}-staged/ingest_batch={batch_id}"
    # The stream's state is run once; everything after it reads the staged metrics.
    metrics.write.mode("overwrite").parquet(staged)
    metrics = spark.read.schema(metrics.schema).parquet(staged)
    values = metric_values(metrics, ["project_id", "tick"])
    if traces_root is not None and _exists(spark, traces_root):
        low, high = metrics.agg(F.min("tick"), F.max("tick")).first()
        traces = read_traces(spark, traces_root)
        if low is not None:
            span = F.make_dt_interval(mins=F.lit(window_minutes))
            traces = traces.filter((F.col("started_at") >= F.lit(low) - span) & (F.col("started_at") < F.lit(high)))
        values = values.unionByName(_failures(traces, metrics, window_minutes))
    first, recent = metrics.agg(F.min("tick")).first()[0], None
    if first is not None:
        # Only firings that can still silence one of these breaches.
        since = F.lit(first) - F.make_dt_interval(mins=F.lit(minutes))
        recent = _firings_before(spark, root, batch_id, since)
    fired = fire_with_cooldown(alerts, values, minutes, recent)
    write_batch(fired.withColumn("date", F.to_date("tick")), root, batch_id, "date")
    _remove(spark, staged)


def stream_alert_cooldown(
    metrics: DataFrame,
    alerts: DataFrame,
    root: str,
    checkpoint: str,
    interval: str | None = "5 minutes",
    traces_root: str | None = None,
) -> StreamingQuery:
    """Firings of streaming metrics, at most one per alert and cooldown; ``traces_root`` adds
    alerts on failed traces."""
    return (
        micro_batch_writer(metrics, interval)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, n: cooldown_micro_batch(batch, n, alerts, root, traces_root=traces_root))
        .start()
    )


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all available input into Parquet, then stop."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
