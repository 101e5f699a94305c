"""Registry of the runnable queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.plans.derived import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """Fractions to 9 places and arrays as text, so both engines print the same."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            column = F.round(column.cast("double"), 9)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def placed(ordered: DataFrame, *keys: str) -> DataFrame:
    """Add the place of each row in the order of the frame, within its ``keys``, so that the
    checking SQL can compare the order too."""
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return numbered.withColumn("place", F.row_number().over(window.orderBy("_at"))).drop("_at")


def query(name: str, tables: str = "", sql: str | None = None):
    """Register a query; ``tables`` names the derived tables that its SQL reads."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return settled(build(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(tables, sql) if tables else sql.strip()
        return build

    return add
