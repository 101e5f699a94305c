"""Aggregation helpers that stay spread out when one group is huge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.session import written


def js_round(value: Column) -> Column:
    """Round halves up, as the result fields are rounded."""
    return F.floor(value + 0.5).cast("bigint")


#: Size of the quantile sketches that bracket an exact percentile, and the half width of the
#: bracket in ranks. The sketch's ranks are within 0.17 % in 99 of 100 cases (2.6 deviations); the
#: bracket is four times as wide and, in groups larger than the sketch, has two more places.
SKETCH_K, BRACKET = 2048, 0.0068 + 2 / 2048


def counted_percentile(
    df: DataFrame, keys: list[str], aggregates: list[Column], value: str, fraction: float, out: str
) -> DataFrame:
    """``aggregates`` of each group of ``keys`` with the exact interpolated percentile of the
    whole-numbered ``value`` (null for a group without values).

    The scan that counts also builds a mergeable quantile sketch of each group, which brackets the
    percentile between two values about 1.6 % of the ranks apart. This first result, one narrow row per
    group, is written. A second scan of keys and value counts what is below the bracket and the
    distinct values inside it, combined before the shuffle; only these are put in order. Should
    a bracket ever miss its rank the job stops: no approximate value is given.
    """
    whole = F.col(value).cast("bigint")
    grouped = df.groupBy(*keys).agg(
        *aggregates, F.count(value).alias("_size"), F.min(whole).alias("_least"), F.max(whole).alias("_most"),
        F.kll_sketch_agg_bigint(whole, F.lit(SKETCH_K)).alias("_sketch"),
    )

    def at(rank: float, end: str) -> Column:
        quantile = F.kll_sketch_get_quantile_bigint("_sketch", F.lit(min(1.0, max(0.0, rank))))
        return F.when(F.col("_size") > SKETCH_K, quantile).otherwise(F.col(end))

    bracketed = grouped.withColumns({"_lo": at(fraction - BRACKET, "_least"), "_hi": at(fraction + BRACKET, "_most")})
    bracketed = bracketed.drop("_sketch", "_least", "_most")
    base = written(bracketed, "counted-groups")
    values = df.select(*keys, F.col(value).cast("bigint").alias("_v")).filter(F.col("_v").isNotNull())
    if keys:
        bounds = base.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_lo", "_hi")
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
        values = values.join(bounds, same)
    else:
        row = base.first()
        values = values.withColumns({"_lo": F.lit(row["_lo"]).cast("bigint"), "_hi": F.lit(row["_hi"]).cast("bigint")})
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))  # null: below the bracket
    counted = values.filter(F.col("_v") <= F.col("_hi")).groupBy(*keys, inside.alias("_v")).agg(F.count("*").alias("_n"))
    renamed = counted.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_v", "_n")
    group = Window.partitionBy(*[f"_of_{k}" for k in keys]) if keys else Window.partitionBy(F.lit(0))
    ordered = group.orderBy(F.col("_v").asc_nulls_first())
    ranked = renamed.withColumn("_upto", F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_next", F.lead("_v").over(ordered)
    )
    sizes = base.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_size")
    if keys:
        ranked = ranked.join(sizes, reduce(lambda x, y: x & y, [F.col(f"_of_{k}").eqNullSafe(F.col(f"_key_{k}")) for k in keys]))
    else:
        ranked = ranked.withColumn("_size", F.lit(row["_size"]))
    position = (F.col("_size") - 1) * F.lit(fraction)
    low = F.floor(position)
    holds_low = F.col("_v").isNotNull() & (F.col("_upto") - F.col("_n") <= low) & (low < F.col("_upto"))
    following = F.coalesce(F.col("_next"), F.when((low + 1 >= F.col("_size")) | (position == low), F.col("_v")))
    high_value = F.when(low + 1 < F.col("_upto"), F.col("_v")).otherwise(following)
    interpolated = (F.col("_v") + (high_value - F.col("_v")) * (position - low)).cast("double")
    found = ranked.filter(holds_low).select(*[f"_of_{k}" for k in keys], interpolated.alias("_found"))
    checked = F.when(F.col("_size") > 0, F.coalesce("_found", F.raise_error("the sketch's bracket missed the percentile").cast("double")))
    if keys:
        found = base.join(found, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), "left")
    else:
        # A global aggregate: one row, also of an empty table.
        found = combined([], base, found.agg(F.max("_found").alias("_found")))
    names = [c for c in base.columns if c not in ("_size", "_lo", "_hi")]
    return found.withColumn(out, checked).select(*names, out)


def percentile_cont(
    df: DataFrame, keys: list[str], value: str, fraction: float, out: str
) -> DataFrame:
    """Exact interpolated percentile of ``value`` for each group of ``keys`` that has values."""
    return counted_percentile(df, keys, [], value, fraction, out).filter(F.col(out).isNotNull())


def gap_filled(
    buckets: DataFrame, bucket: str, step: str, zeros: list[str], keys: list[str]
) -> DataFrame:
    """Add the missing buckets between the first and last one of each group, with zeros."""
    bounds = buckets.groupBy(*keys).agg(F.min(bucket).alias("_lo"), F.max(bucket).alias("_hi"))
    grid = bounds.filter(F.col("_lo").isNotNull()).select(
        *keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias(bucket)
    )
    filled = grid.join(buckets, [*keys, bucket], "left")
    return filled.fillna(0, zeros)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None) -> DataFrame:
    """First ``k`` rows, of the whole frame or of each group (None: all of them).

    Spark cuts every task's rows to ``k`` per group before the shuffle
    (TakeOrdered or WindowGroupLimit), so a dominant group does not travel.
    """
    if k is None:
        return df
    if not keys:
        return df.orderBy(*order).limit(k)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def combined(keys: list[str], *parts: DataFrame) -> DataFrame:
    """Put results with the same keys and different value columns side by side.

    A union and an aggregate instead of joins: it works for zero keys too, and
    keeps keys that only some parts have.
    """
    values = [c for part in parts for c in part.columns if c not in keys]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.any_value(c, F.lit(True)).alias(c) for c in values])
