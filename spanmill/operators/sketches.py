"""Mergeable totals and sketches of spans, for answers about any window without the spans.

One row per project, hour, model, agent and status holds counts and sums, a quantile sketch of
the latencies and a distinct-count sketch of the traces. Rows of any hours, batches and groups
merge to the same totals and to sketches with the same error, so they are stored per micro-batch
and merged when they are read. Counts and sums are exact; only p95 (within ``RANK_ERROR`` of its
rank) and distinct traces (``TRACES_ERROR``, relative) are estimates, each in at least 99 of 100 cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators.slices import moment
from spanmill.sources.tables import write_batch

DIMENSIONS = ["project_id", "hour", "model", "agent_name", "status"]
#: Sizes of the sketches, and the errors that they have in 99 of 100 cases.
LATENCY_K, RANK_ERROR = 400, 0.0072
TRACES_LG_K, TRACES_ERROR = 12, 2.6 * 0.83 / 2**6
_SUMS = ("spans", "errors", "cost_usd", "input_tokens", "output_tokens", "latency_sum", "latency_n")


def usage_sketches(spans: DataFrame) -> DataFrame:
    """One row per ``DIMENSIONS``; combined before the shuffle, so a dominant group costs a row
    (some kB) per task. A group without latencies has a null latency sketch, one without trace
    ids a null trace sketch."""
    zero = lambda name, kind: F.coalesce(F.sum(name), F.lit(0)).cast(kind)
    latency, trace = F.col("latency_ms").cast("bigint"), F.col("trace_id")
    rows = spans.withColumn("hour", F.date_trunc("hour", "started_at")).groupBy(*DIMENSIONS).agg(
        F.count("*").alias("spans"),
        F.count_if(F.col("status") == "error").alias("errors"),
        zero("cost_usd", "double").alias("cost_usd"),
        zero("input_tokens", "bigint").alias("input_tokens"),
        zero("output_tokens", "bigint").alias("output_tokens"),
        zero("latency_ms", "bigint").alias("latency_sum"),
        F.count("latency_ms").alias("latency_n"),
        F.kll_sketch_agg_bigint(latency, F.lit(LATENCY_K)).alias("latencies"),
        F.count(trace).alias("_traces_n"),
        F.hll_sketch_agg(trace, F.lit(TRACES_LG_K)).alias("traces"),
    )
    known = {
        "latencies": F.when(F.col("latency_n") > 0, F.col("latencies")),
        "traces": F.when(F.col("_traces_n") > 0, F.col("traces")),
    }
    return rows.withColumns(known).drop("_traces_n")


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the same ``keys`` (any of the dimensions or columns made from them) as one."""
    return sketches.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.kll_merge_agg_bigint("latencies", F.lit(LATENCY_K)).alias("latencies"),
        F.hll_union_agg("traces").alias("traces"),
    )


def write_sketches(spans: DataFrame, root: str, batch_id: int) -> None:
    """Sketches of one micro-batch, by day; the same batch again replaces them."""
    dated = usage_sketches(spans).withColumn("date", F.to_date("hour"))
    write_batch(dated, root, batch_id, "date")


def read_sketches(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all batches; rows of one group from several batches are merged by the reports."""
    return spark.read.option("basePath", root).parquet(root).drop("ingest_batch")


def sketch_slice(sketches: DataFrame, project_id: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of the hours from ``start`` up to and without ``end``; both must be full hours, as a
    row can't be cut. Days outside are not read."""
    rows = sketches if project_id is None else sketches.filter(F.col("project_id") == project_id)
    by_day = "date" in sketches.columns
    for bound, keep in ((start, lambda at, x: at >= x), (end, lambda at, x: at < x)):
        if bound is None:
            continue
        full = F.date_trunc("hour", moment(bound)) == moment(bound)
        limit = F.when(full, moment(bound)).otherwise(F.raise_error("sketches are cut at full hours").cast("timestamp"))
        rows = rows.filter(keep(F.col("hour"), limit))
    if by_day and start is not None:
        rows = rows.filter(F.col("date") >= F.to_date(moment(start)))
    if by_day and end is not None:
        rows = rows.filter(F.col("date") <= F.to_date(moment(end)))
    return rows


def _p95(n: Column) -> Column:
    return F.when(n > 0, F.kll_sketch_get_quantile_bigint("latencies", F.lit(0.95)).cast("double"))


def sketched_summary(
    sketches: DataFrame, keys: list[str] | None = None, project_id: str | None = None, start=None, end=None
) -> DataFrame:
    """The columns of ``summary_stats`` for each group of ``keys`` (default: the project), from
    sketches alone. A group without latencies has p95 and mean 0."""
    keys = ["project_id"] if keys is None else keys
    rows = merged_sketches(sketch_slice(sketches, project_id, start, end), keys)
    mean = F.coalesce(F.try_divide(F.col("latency_sum"), F.col("latency_n")), F.lit(0.0))
    return rows.select(
        *keys,
        F.col("spans").alias("total_spans"),
        F.col("errors").alias("error_count"),
        F.col("cost_usd").alias("total_cost_usd"),
        mean.alias("avg_latency_ms"),
        F.col("input_tokens").alias("total_input_tokens"),
        F.col("output_tokens").alias("total_output_tokens"),
        F.coalesce(F.hll_sketch_estimate("traces"), F.lit(0)).alias("unique_traces"),
        F.coalesce(_p95(F.col("latency_n")), F.lit(0.0)).alias("p95_latency_ms"),
    )


def sketch_errors(sketches: DataFrame, spans: DataFrame, project_id: str | None = None, start=None, end=None) -> DataFrame:
    """Per project, how far the estimates are from the spans: ``rank_error`` of p95 (0 if its value
    covers the rank) and relative ``traces_error``. For checking a table of sketches."""
    estimated = sketched_summary(sketches, None, project_id, start, end)
    rows = spans.filter((F.col("started_at") >= moment(start)) & (F.col("started_at") < moment(end)))
    rows = rows.join(estimated.select("project_id", F.col("p95_latency_ms").alias("_p95")), "project_id")
    n = F.count("latency_ms")
    below = F.count_if(F.col("latency_ms") < F.col("_p95")) / n
    upto = F.count_if(F.col("latency_ms") <= F.col("_p95")) / n
    exact = rows.groupBy("project_id").agg(
        F.coalesce(F.greatest(below - 0.95, 0.95 - upto, F.lit(0.0)), F.lit(0.0)).alias("rank_error"),
        F.count_distinct("trace_id").alias("_traces"),
    )
    error = F.abs(F.col("unique_traces") - F.col("_traces")) / F.col("_traces")
    return estimated.join(exact, "project_id").select("*", error.alias("traces_error")).drop("_traces")
