"""Column expressions over single spans and traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: listing presets (inclusive bounds, so neighbours overlap) ---
LATENCY_PRESETS = {
    "<1s": (None, 1000),
    "1-3s": (1000, 3000),
    "3-5s": (3000, 5000),
    ">5s": (5000, None),
}
COST_PRESETS = {
    "<0.01": (None, 0.01),
    "0.01-0.10": (0.01, 0.10),
    ">0.10": (0.10, None),
}


def span_latency() -> Column:
    """Reported latency, else end minus start in milliseconds."""
    elapsed = F.unix_millis("ended_at") - F.unix_millis("started_at")
    return F.coalesce(F.col("latency_ms"), elapsed.cast("int"))


def span_end() -> Column:
    """End of a span: ``ended_at``, else start plus latency, else the start."""
    by_latency = F.timestamp_millis(F.unix_millis("started_at") + F.col("latency_ms"))
    return F.coalesce("ended_at", by_latency, "started_at")


def total_tokens() -> Column:
    return F.coalesce("input_tokens", F.lit(0)).cast("bigint") + F.coalesce("output_tokens", F.lit(0))


def token_share() -> Column:
    """Struct of the input and output share in percent; half each without tokens."""
    total = total_tokens()
    share = lambda name: F.when(
        total > 0, F.coalesce(name, F.lit(0)) / total * 100
    ).otherwise(50.0)
    return F.struct(
        share("input_tokens").alias("input_pct"), share("output_tokens").alias("output_pct")
    )


def in_range(value: Column, low, high) -> Column:
    """``low <= value <= high``; a bound of None is open."""
    kept = F.lit(True)
    if low is not None:
        kept = kept & (value >= F.lit(low))
    if high is not None:
        kept = kept & (value <= F.lit(high))
    return kept


def _bucket(value: Column, presets: dict) -> Column:
    """First preset that holds the value: turns the overlapping filters into a partition."""
    label = F.lit(None).cast("string")
    for name, (low, high) in reversed(presets.items()):
        label = F.when(in_range(value, low, high), name).otherwise(label)
    return F.when(value.isNotNull(), label)


def latency_bucket(value: Column) -> Column:
    return _bucket(value, LATENCY_PRESETS)


def cost_bucket(value: Column) -> Column:
    return _bucket(value, COST_PRESETS)

