"""Tables fed by micro-batches.

Every micro-batch writes its own ``ingest_batch=N`` folder and replaces it when
it is run again, so a restarted stream leaves no duplicates. Traces are stored
as mergeable partial rows: nothing is ever updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators.rollup import finish_traces, merge_trace_partials, trace_partials
from spanmill.sources.batches import spans_sink


def write_batch(df: DataFrame, root: str, batch_id: int, *partition_cols: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(f"{root}/ingest_batch={batch_id}")


def write_trace_partials(spans: DataFrame, root: str, batch_id: int) -> None:
    write_batch(trace_partials(spans), root, batch_id)


def read_trace_partials(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(root)


def read_traces(spark: SparkSession, root: str) -> DataFrame:
    """Traces as of the last written batch."""
    return finish_traces(merge_trace_partials(read_trace_partials(spark, root)))


def compact_trace_partials(spark: SparkSession, root: str, target: str, upto: int) -> None:
    """Merge the partial rows of the batches up to ``upto`` into a new table.

    Batch 0 of ``target`` holds one row per trace; later batches are copied, so
    ``read_traces`` gives the same rows for both tables. Run again, it replaces what it wrote.
    """
    partials = read_trace_partials(spark, root)
    old = partials.filter(F.col("ingest_batch") <= upto).drop("ingest_batch")
    write_batch(merge_trace_partials(old), target, 0)
    recent = partials.filter(F.col("ingest_batch") > upto)
    # Only the folders of the batches that are written are replaced, not the whole table.
    recent.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(target)


def compact_spans(spark: SparkSession, landing: str, target: str, first: int, last: int) -> None:
    """Move the landed batches ``first`` to ``last`` to the table by project and day.

    They get a folder of their own in ``target`` (read with ``read_spans``), which the same move
    replaces when it runs again.
    """
    landed = spark.read.option("basePath", landing).parquet(landing)
    chosen = landed.filter(F.col("ingest_batch").between(first, last))
    spans_sink(chosen.drop("ingest_batch", "date"), f"{target}/landed={first}-{last}", mode="overwrite")
