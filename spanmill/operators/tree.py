"""Trace trees: nesting, depth-first order, timelines and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.spans import span_end, total_tokens
from spanmill.session import cut_lineage


def _step() -> Column:
    """Order of a span among its siblings: by start, then by id, as sortable text."""
    micros = F.lpad(F.unix_micros("started_at").cast("string"), 20, "0")
    return F.concat(micros, F.lit(":"), F.col("span_id"))


def _links(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, up, done): the parent, or the span itself if that is a root."""
    links = spans.select("trace_id", "span_id", "parent_span_id")
    parents = links.select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("span_id").alias("_known")
    )
    return links.join(parents, ["trace_id", "parent_span_id"], "left").select(
        "trace_id",
        "span_id",
        F.coalesce("_known", "span_id").alias("up"),
        F.col("_known").isNull().alias("done"),
    )


def _climbed(active: DataFrame, finished: DataFrame, *carried: str) -> DataFrame:
    """One round: every active span takes over what its ancestor so far knows."""
    known = finished.unionByName(active).select(
        "trace_id",
        F.col("span_id").alias("up"),
        F.col("up").alias("_up"),
        F.col("done").alias("_done"),
        *[F.col(c).alias(f"_{c}") for c in carried],
    )
    return active.drop("done").join(known, ["trace_id", "up"]).select(
        "trace_id",
        "span_id",
        F.col("_up").alias("up"),
        F.col("_done").alias("done"),
        *[F.concat(f"_{c}", c).alias(c) for c in carried],
    )


def cyclic_spans(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans whose ancestors run in a circle: they hang on no root.

    Distances double each round, and only ids travel. A span of depth d is done after
    log2(d) rounds, and then so is one of its ancestors in every round before: once a round
    finishes none, all that is left is cyclic.
    """
    state = cut_lineage(_links(spans))
    finished, active = state.filter("done"), state.filter("NOT done")
    while not active.isEmpty():
        moved = cut_lineage(_climbed(active, finished))
        active = moved.filter("NOT done")
        new = moved.filter("done")
        if new.isEmpty():
            break
        finished = finished.unionByName(new)
    return active.select("trace_id", "span_id")


def trace_tree(spans: DataFrame) -> DataFrame:
    """Add ``root_id``, ``depth`` and ``path`` to spans of any number of traces.

    A span whose parent is not in its trace is a root. ``path`` lists the steps
    from the root down, so sorting by it gives depth-first order. Spans in a parent cycle,
    or below one, stay with nulls in the three columns (see ``cyclic_spans``).

    Every span knows its parent at first; each round joins it with what its current ancestor
    knows, so the distance doubles and a tree of depth d takes log2(d) joins. Paths are built
    only for spans that reach a root.
    """
    circling = cyclic_spans(spans)
    sound = spans.join(circling, ["trace_id", "span_id"], "left_anti")
    steps = sound.select("trace_id", "span_id", F.array(_step()).alias("path"))
    state = cut_lineage(_links(sound).join(steps, ["trace_id", "span_id"]))
    finished, active = state.filter("done"), state.filter("NOT done")
    while not active.isEmpty():
        moved = cut_lineage(_climbed(active, finished, "path"))
        finished = finished.unionByName(moved.filter("done"))
        active = moved.filter("NOT done")
    placed = finished.select(
        "trace_id", "span_id", F.col("up").alias("root_id"), "path", (F.size("path") - 1).alias("depth")
    )
    return spans.join(placed, ["trace_id", "span_id"], "left")


def flatten_tree(tree: DataFrame) -> DataFrame:
    """Spans in depth-first order, trace after trace (a distributed sort)."""
    return tree.orderBy("trace_id", "path")


def sort_path(path: str = "path") -> Column:
    """The path as one text that sorts the same way."""
    return F.array_join(path, "\u0001")


def span_timeline(spans: DataFrame) -> DataFrame:
    """Add ``offset_pct`` and ``width_pct`` of each span within its trace."""
    start, end = F.unix_millis("started_at"), F.unix_millis(span_end())
    bounds = spans.groupBy("trace_id").agg(F.min(start).alias("_from"), F.max(end).alias("_to"))
    # Joined, not windowed: a dominant trace is split by the skew join.
    rows = spans.join(bounds, "trace_id")
    span = F.col("_to") - F.col("_from")
    total = F.when(span == 0, 1).otherwise(span)
    return (
        rows.withColumn("offset_pct", (start - F.col("_from")) / total * 100)
        .withColumn("width_pct", F.greatest((end - start) / total * 100, F.lit(0.5)))
        .drop("_from", "_to")
    )


def last_by_name(tree: DataFrame) -> DataFrame:
    """For each trace and span name the last span in depth-first order."""
    last = F.max_by(F.struct("status", "latency_ms", "cost_usd", total_tokens().alias("tokens")), "path")
    return tree.groupBy("trace_id", "name").agg(last.alias("s"))


def _compared(pairs: DataFrame) -> DataFrame:
    left, right = F.col("_a"), F.col("_b")
    shown = lambda side: [
        F.col(f"_{side}.{field}").alias(f"{field}_{side}")
        for field in ("status", "latency_ms", "cost_usd", "tokens")
    ]
    kept = [c for c in pairs.columns if c not in ("_a", "_b")]
    differs = ~left.eqNullSafe(right)
    return pairs.select(
        *kept,
        left.isNull().alias("missing_a"),
        right.isNull().alias("missing_b"),
        *shown("a"),
        *shown("b"),
        (F.col("_b.latency_ms") - F.col("_a.latency_ms")).alias("latency_diff_ms"),
        differs.alias("different"),
    )


def compare_traces(tree: DataFrame, trace_a: str, trace_b: str) -> DataFrame:
    """Two traces side by side, matched by span name."""
    named = last_by_name(tree.filter(F.col("trace_id").isin(trace_a, trace_b)))
    side = lambda trace: named.filter(F.col("trace_id") == trace)
    a = side(trace_a).select("name", F.col("s").alias("_a"))
    b = side(trace_b).select("name", F.col("s").alias("_b"))
    return _compared(a.join(b, "name", "full_outer"))


def compare_trace_pairs(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for a table of pairs (trace_a, trace_b), in one job."""
    named = last_by_name(tree)
    side = lambda key, out: pairs.join(
        named.select(F.col("trace_id").alias(key), "name", F.col("s").alias(out)), key
    )
    a, b = side("trace_a", "_a"), side("trace_b", "_b")
    return _compared(a.join(b, ["trace_a", "trace_b", "name"], "full_outer"))


def compare_totals(traces: DataFrame, trace_a: str, trace_b: str) -> DataFrame:
    """Status, spans, latency, cost and tokens of two traces, with a flag where they differ."""
    fields = ("status", "total_spans", "total_latency_ms", "total_cost_usd", "total_tokens")
    values = F.explode(
        F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
        )
    )
    both = traces.filter(F.col("trace_id").isin(trace_a, trace_b)).select("trace_id", values.alias("_v"))
    pick = lambda trace: F.max(F.when(F.col("trace_id") == trace, F.col("_v.value")))
    return (
        both.groupBy("_v.field")
        .agg(pick(trace_a).alias("value_a"), pick(trace_b).alias("value_b"))
        .withColumn("different", ~F.col("value_a").eqNullSafe(F.col("value_b")))
    )
