"""What the overview and cost pages share: one scan that counts for all parts of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_counts(rows: DataFrame, kinds: dict[str, list[str]], *measures: Column) -> DataFrame:
    """``measures`` of each project by several sets of dimensions, in one scan and one shuffle.

    ``kinds`` names the sets; the first dimension of a set is in no other, and the set without
    any is the total of the project. Rows are (project_id, kind, all dimensions, measures). They
    combine before the shuffle, so only sets of many values (traces) send many rows.
    """
    names = list(dict.fromkeys(name for kind in kinds.values() for name in kind))
    sets = [["project_id", *kind] for kind in kinds.values()]
    kind = F.lit(next((name for name, dims in kinds.items() if not dims), None))
    for name, dims in kinds.items():
        if dims:
            kind = F.when(F.grouping(dims[0]) == 0, name).otherwise(kind)
    return rows.groupingSets(sets, "project_id", *names).agg(kind.alias("kind"), *measures)


def mean(total: str, n: str) -> Column:
    """Mean of summed values; zero without any."""
    return F.coalesce(F.try_divide(F.sum(total), F.sum(n)), F.lit(0.0))


def by_model(counts: DataFrame) -> DataFrame:
    """Usage of each model from counts by model and provider, with its most common provider
    (ties by name)."""
    provider = F.min(F.when(F.col("provider").isNotNull(), F.struct((-F.col("n")).alias("n"), "provider")))["provider"]
    cost = F.coalesce(F.sum("cost"), F.lit(0.0))
    return (
        counts.filter((F.col("kind") == "model") & F.col("model").isNotNull() & (F.col("n") > 0))
        .groupBy("project_id", "model")
        .agg(
            F.coalesce(provider, F.lit("unknown")).alias("provider"),
            F.sum("n").alias("calls"),
            cost.alias("cost_usd"),
            (mean("tokens_in", "n_in") + mean("tokens_out", "n_out")).alias("avg_tokens_per_call"),
            (cost / F.sum("n")).alias("avg_cost_per_call"),
            mean("latency", "n_latency").alias("avg_latency_ms"),
        )
    )


def listed(rows: DataFrame, name: str, order: list[Column], *columns: str) -> DataFrame:
    """(project_id, ``name``): the rows of each project as an array of structs in order."""
    structs = F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns))
    fields = F.transform(F.sort_array(structs), lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return rows.groupBy("project_id").agg(fields.alias(name))


def single(page: DataFrame) -> DataFrame:
    """The page of one project: always one row, with zeros and empty arrays where nothing was found."""
    names = [c for c in page.columns if c != "project_id"]
    row = page.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in names])
    zero = {c: F.array().cast(t) if t.startswith("array") else F.lit(0).cast(t) for c, t in row.dtypes}
    return row.select(*[F.coalesce(c, zero[c]).alias(c) for c in names])


def magnitude(value: Column) -> Column:
    """Bucket of a whole number: itself up to 127, then 64 buckets for each doubling. Buckets
    ascend with the value, and all negative values share one."""
    value = value.cast("bigint")
    bits = F.length(F.bin(value))
    upper = (bits - 1) * 64 + F.call_function("shiftright", value, (bits - 7).cast("int"))
    return F.when(value < 0, -1).when(value < 128, value).otherwise(upper).cast("bigint")


def percentile_of_buckets(buckets: DataFrame, rows: DataFrame, value: str, fraction: float, out: str) -> DataFrame:
    """(project_id, ``out``): exact interpolated percentile of ``value`` in ``rows``.

    ``buckets`` (project_id, bucket, n) counts the rows by ``magnitude``. The one or two buckets
    around the rank are known from them; ``rows`` is scanned for these alone, and only their
    distinct values are put in order.
    """
    project = Window.partitionBy("project_id")
    ranked = buckets.select(
        "project_id", "bucket", "n",
        F.sum("n").over(project.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(project).alias("size"),
    )
    position = (F.col("size") - 1) * F.lit(fraction)
    low = F.floor(position)
    high = F.least(low + 1, F.col("size") - 1)
    around = ranked.filter((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high))
    bounds = around.groupBy(F.col("project_id").alias("_of")).agg(
        F.min("bucket").alias("first"), F.max("bucket").alias("last"),
        F.min(F.col("upto") - F.col("n")).alias("below"), F.max("size").alias("size"),
    )
    values = rows.filter(F.col(value).isNotNull()).select("project_id", F.col(value).cast("bigint").alias("v"))
    values = values.withColumn("bucket", magnitude(F.col("v")))
    near = values.join(bounds, F.col("project_id").eqNullSafe(F.col("_of")) & F.col("bucket").isin(F.col("first"), F.col("last")))
    counted = near.groupBy("project_id", "below", "size", "v").agg(F.count("*").alias("n"))
    ordered = project.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.col("below") + F.sum("n").over(ordered))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))
    found = placed.groupBy("project_id", "size").agg(at(low).alias("low"), at(high).alias("high"))
    return found.select("project_id", (F.col("low") + (F.col("high") - F.col("low")) * (position - low)).cast("double").alias(out))
