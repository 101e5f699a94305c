"""Reports of the cost page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.pricing import price_lookup
from spanmill.functions.stats import combined, gap_filled, js_round, top_k
from spanmill.operators.overview import model_usage
from spanmill.operators.page import by_model, grouped_counts, listed, single
from spanmill.operators.slices import moment, report_keys, time_slice
from spanmill.session import written


def _cost(column: str = "cost_usd") -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def _prev_start(start, end) -> Column:
    """Start of the period of the same length before ``start``, cut to its date."""
    seconds = F.unix_seconds(moment(end)) - F.unix_seconds(moment(start))
    return F.timestamp_seconds(F.unix_seconds(moment(start)) - seconds).cast("date").cast("timestamp")


def period_costs(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Cost and tokens of the period and the cost of the one before, in one scan.

    Both periods hold the moment ``start``.
    """
    at, first = F.col("started_at"), _prev_start(start, end)
    now = (at >= moment(start)) & (at <= moment(end))
    before = (at >= first) & (at <= moment(start))
    tokens = lambda name: F.coalesce(F.sum(F.when(now, F.col(name))), F.lit(0))
    return (
        time_slice(spans, project_id, first, end)
        .groupBy(*report_keys(project_id))
        .agg(
            F.coalesce(F.sum(F.when(now, F.col("cost_usd"))), F.lit(0.0)).alias("total_cost_usd"),
            tokens("input_tokens").alias("total_input_tokens"),
            tokens("output_tokens").alias("total_output_tokens"),
            F.coalesce(F.sum(F.when(before, F.col("cost_usd"))), F.lit(0.0)).alias(
                "prev_period_cost_usd"
            ),
        )
    )


def prev_period_cost(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Cost of the period of the same length before ``start``."""
    return (
        time_slice(spans, project_id, _prev_start(start, end), start)
        .groupBy(*report_keys(project_id))
        .agg(_cost().alias("prev_period_cost_usd"))
    )


def cost_by_model(
    spans: DataFrame, project_id=None, start=None, end=None, limit: int | None = None
) -> DataFrame:
    """Usage of all models (or of the ``limit`` busiest) with the roundings of the cost page."""
    return model_usage(spans, project_id, start, end, limit).select(
        *report_keys(project_id),
        "model",
        "provider",
        "cost_usd",
        F.col("calls").alias("span_count"),
        js_round(F.col("avg_tokens_per_call")).alias("avg_tokens_per_call"),
        F.round("avg_cost_per_call", 6).alias("avg_cost_per_call"),
        js_round(F.col("avg_latency_ms")).alias("avg_latency_ms"),
        F.col("calls").alias("call_count"),
    )


def cost_by_model_pg(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """By model and provider; missing names are ``unknown``, missing costs are skipped."""
    keys = report_keys(project_id)
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    unknown = lambda name: F.coalesce(name, F.lit("unknown")).alias(name)
    rows = time_slice(spans, project_id, start, end).groupBy(*keys, "model", "provider")
    return rows.agg(
        F.sum("cost_usd").alias("cost_usd"),
        F.count("*").alias("span_count"),
        js_round(F.avg(tokens)).alias("avg_tokens_per_call"),
        F.round(F.avg("cost_usd"), 6).alias("avg_cost_per_call"),
        js_round(F.coalesce(F.avg("latency_ms"), F.lit(0.0))).alias("avg_latency_ms"),
    ).select(
        *keys, unknown("model"), unknown("provider"),
        "cost_usd", "span_count", "avg_tokens_per_call", "avg_cost_per_call", "avg_latency_ms",
    ).orderBy(*keys, F.desc_nulls_first("cost_usd"), "model", "provider")


def _daily(spans: DataFrame, project_id, start, end, *aggs: Column) -> DataFrame:
    keys = report_keys(project_id)
    rows = time_slice(spans, project_id, start, end)
    return rows.groupBy(*keys, F.to_date("started_at").alias("date")).agg(*aggs)


def cost_by_date(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Cost per UTC day; empty days between the first and last one are zero."""
    keys = report_keys(project_id)
    daily = _daily(spans, project_id, start, end, _cost().alias("cost_usd"))
    return gap_filled(daily, "date", "1 DAY", ["cost_usd"], keys).orderBy(*keys, "date")


#: The endpoint for one series; the same report.
cost_timeseries = cost_by_date


def cost_by_date_pg(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Cost per UTC day without gap filling; null for a day without any cost."""
    daily = _daily(spans, project_id, start, end, F.sum("cost_usd").alias("cost_usd"))
    return daily.orderBy(*report_keys(project_id), "date")


def cost_by_date_split(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Daily cost of input tokens and of output tokens, from the price list."""
    rows = price_lookup(time_slice(spans, project_id, start, end))
    part = lambda tokens, price: F.coalesce(
        F.sum(F.col(tokens) / 1000 * F.col(price)), F.lit(0.0)
    )
    keys = report_keys(project_id)
    daily = _daily(
        rows,
        project_id,
        None,
        None,
        part("input_tokens", "price_in").alias("input_cost_usd"),
        part("output_tokens", "price_out").alias("output_cost_usd"),
    )
    zeros = ["input_cost_usd", "output_cost_usd"]
    return gap_filled(daily, "date", "1 DAY", zeros, keys).orderBy(*keys, "date")


def cost_by_agent(
    spans: DataFrame, project_id=None, start=None, end=None, limit: int | None = None
) -> DataFrame:
    """Cost of all agents, or of the ``limit`` agents with most spans."""
    keys = report_keys(project_id)
    rows = time_slice(spans, project_id, start, end).filter(F.col("agent_name").isNotNull())
    agents = rows.groupBy(*keys, "agent_name").agg(
        F.count("*").alias("_spans"), _cost().alias("cost_usd")
    )
    return top_k(agents, keys, [F.desc("_spans"), F.asc("agent_name")], limit).drop("_spans")


def cost_by_agent_pg(
    spans: DataFrame, traces: DataFrame, project_id=None, start=None, end=None
) -> DataFrame:
    """Cost by the agent of the trace; traces without one are ``unknown``."""
    keys = report_keys(project_id)
    # Spans collapse to one row per trace before they meet the traces.
    by_trace = (
        time_slice(spans, project_id, start, end)
        .groupBy(*keys, "trace_id")
        .agg(F.sum("cost_usd").alias("_cost"))
    )
    agents = traces.select("trace_id", F.coalesce("agent_name", F.lit("unknown")).alias("agent_name"))
    return (
        by_trace.join(agents, "trace_id")
        .groupBy(*keys, "agent_name")
        .agg(F.sum("_cost").alias("cost_usd"))
        .orderBy(*keys, F.desc_nulls_first("cost_usd"), "agent_name")
    )


def cost_delta(costs: DataFrame) -> DataFrame:
    """Change against the previous period, absolute and in percent; null without one."""
    prev, delta = F.col("prev_period_cost_usd"), F.col("total_cost_usd") - F.col("prev_period_cost_usd")
    return costs.withColumn("delta_usd", F.when(prev > 0, delta)).withColumn(
        "delta_pct", F.when(prev > 0, delta / prev * 100)
    )


def agent_cost_share(by_agent: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cost in percent of the agents of ``by_agent``."""
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum("cost_usd").over(window)
    share = F.when(total > 0, F.col("cost_usd") / total * 100).otherwise(0.0)
    return by_agent.withColumn("share_pct", share)


def top_cost_model_agent(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Most expensive model and agent; ties go to the busier, then the smaller name."""
    keys = report_keys(project_id)
    models = cost_by_model(spans, project_id, start, end)
    agents = cost_by_agent(spans, project_id, start, end)
    first = lambda *order: F.min(F.struct(*order))
    top_model = models.groupBy(*keys).agg(
        first((-F.col("cost_usd")).alias("c"), (-F.col("span_count")).alias("n"), "model")["model"].alias(
            "most_expensive_model"
        )
    )
    top_agent = agents.groupBy(*keys).agg(
        first((-F.col("cost_usd")).alias("c"), "agent_name")["agent_name"].alias("most_expensive_agent")
    )
    return combined(keys, top_model, top_agent)


def _month_cost(spans: DataFrame, project_id, as_of) -> DataFrame:
    start = F.date_trunc("month", moment(as_of))
    return (
        time_slice(spans, project_id, start, as_of)
        .groupBy("project_id")
        .agg(_cost().alias("month_cost_usd"))
    )


def budget_status(spans: DataFrame, projects: DataFrame, project_id=None, as_of=None) -> DataFrame:
    """Month cost against the budget for every project that has one."""
    budget = F.col("monthly_budget_usd").cast("double")
    budgets = projects.filter(budget > 0)
    if project_id is not None:
        budgets = budgets.filter(F.col("project_id") == project_id)
    pct = F.least(F.col("month_cost_usd") / budget * 100, F.lit(100.0))
    return (
        budgets.select("project_id", budget.alias("monthly_budget_usd"))
        .join(_month_cost(spans, project_id, as_of), "project_id", "left")
        .fillna(0.0, ["month_cost_usd"])
        .withColumn("used_pct", pct)
        .withColumn(
            "budget_state",
            F.when(F.col("used_pct") >= 100, "over").when(F.col("used_pct") >= 80, "warn").otherwise("ok"),
        )
        .withColumn("remaining_usd", F.col("monthly_budget_usd") - F.col("month_cost_usd"))
    )


SORT_COLUMNS = (
    "model", "call_count", "avg_tokens_per_call", "avg_cost_per_call", "avg_latency_ms", "cost_usd",
)


def model_efficiency_sort(
    by_model: DataFrame, column: str = "cost_usd", descending: bool = True
) -> DataFrame:
    """The model table in the order of any of its columns."""
    if column not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {column}")
    return by_model.orderBy(F.desc(column) if descending else F.asc(column), "model")


def _cost_counts(spans: DataFrame, project_id, start, end, as_of) -> DataFrame:
    """Everything that the cost page adds up, from one scan of both periods and the month."""
    at, first, month = F.col("started_at"), _prev_start(start, end), F.date_trunc("month", moment(as_of))
    now = (at >= moment(start)) & (at <= moment(end))
    before = (at >= first) & (at <= moment(start))
    inside = lambda c: F.when(now, F.col(c)).alias(c)
    earliest, latest = F.least(first, month), F.greatest(moment(end), moment(as_of))
    rows = time_slice(spans, project_id, earliest, latest).select(
        "project_id",
        F.when(now, F.to_date("started_at")).alias("date"),
        *[inside(c) for c in ("model", "provider", "agent_name", "input_tokens", "output_tokens", "latency_ms")],
        now.alias("now"),
        (now | before).alias("reported"),
        F.when(now, F.col("cost_usd")).alias("cost"),
        F.when(before, F.col("cost_usd")).alias("cost_before"),
        F.when((at >= month) & (at <= moment(as_of)), F.col("cost_usd")).alias("cost_month"),
    )
    return grouped_counts(
        rows,
        {"total": [], "date": ["date"], "model": ["model", "provider"], "agent": ["agent_name"]},
        F.count_if("now").alias("n"),
        F.count_if("reported").alias("n_reported"),
        *[F.sum(c).alias(c) for c in ("cost", "cost_before", "cost_month")],
        *[
            agg(c).alias(name)
            for c, total, n in (("latency_ms", "latency", "n_latency"), ("input_tokens", "tokens_in", "n_in"), ("output_tokens", "tokens_out", "n_out"))
            for agg, name in ((F.sum, total), (F.count, n))
        ],
    )


def cost_summary(
    spans: DataFrame, projects: DataFrame, project_id=None, start=None, end=None, as_of=None
) -> DataFrame:
    """The whole page as one row per project: totals, budget, and short arrays.

    One scan counts by day, by model and provider, and by agent; its result (written, as small as
    the page) answers every part. With ``project_id`` there is always one row.
    """
    keys = ["project_id"]
    as_of = end if as_of is None else as_of
    counts = written(_cost_counts(spans, project_id, start, end, as_of), "cost-counts")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    totals = counts.filter("kind = 'total'").select(
        *keys,
        F.when(F.col("n_reported") > 0, zero("cost")).alias("total_cost_usd"),
        F.coalesce("tokens_in", F.lit(0)).alias("total_input_tokens"),
        F.coalesce("tokens_out", F.lit(0)).alias("total_output_tokens"),
        zero("cost_before").alias("prev_period_cost_usd"),
    )
    models = by_model(counts).select(
        *keys, "model", "provider", "cost_usd",
        F.col("calls").alias("span_count"),
        js_round(F.col("avg_tokens_per_call")).alias("avg_tokens_per_call"),
        F.round("avg_cost_per_call", 6).alias("avg_cost_per_call"),
        js_round(F.col("avg_latency_ms")).alias("avg_latency_ms"),
        F.col("calls").alias("call_count"),
    )
    days = counts.filter("kind = 'date' AND n > 0").select(*keys, "date", zero("cost").alias("cost_usd"))
    agents = counts.filter("kind = 'agent' AND n > 0 AND agent_name IS NOT NULL").select(*keys, "agent_name", zero("cost").alias("cost_usd"))
    budgets = projects.filter(F.col("monthly_budget_usd") > 0)
    if project_id is not None:
        budgets = budgets.filter(F.col("project_id") == project_id)
    page = combined(
        keys,
        totals,
        listed(
            models, "by_model", [-F.col("call_count")], "model", "provider", "cost_usd", "span_count",
            "avg_tokens_per_call", "avg_cost_per_call", "avg_latency_ms", "call_count",
        ),
        listed(gap_filled(days, "date", "1 DAY", ["cost_usd"], keys), "by_date", [F.col("date")], "date", "cost_usd"),
        listed(agents, "by_agent", [F.col("agent_name")], "agent_name", "cost_usd"),
        counts.filter("kind = 'total'").select(*keys, zero("cost_month").alias("month_cost_usd")),
        budgets.select(*keys, F.col("monthly_budget_usd").cast("double").alias("monthly_budget_usd")),
    )
    if project_id is not None:
        budget = page.agg(F.max("monthly_budget_usd").alias("monthly_budget_usd"))
        return combined([], single(page.drop("monthly_budget_usd")), budget)
    # A budget alone (no spans) is no report.
    return page.filter(F.col("total_cost_usd").isNotNull()).fillna(0.0, ["month_cost_usd"])
