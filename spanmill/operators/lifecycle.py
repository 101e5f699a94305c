"""Retention per project and storage tiers by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators.slices import days_before, moment
from spanmill.session import written

# --- Fixed values: days after which data changes its tier ---
TIER_DAYS = {"rollover": 7, "warm": 30, "cold": 60, "delete": 90}


def expired(spans: DataFrame, projects: DataFrame, as_of) -> DataFrame:
    """Spans that started before the retention of their project.

    ``projects`` is a dimension; the planner broadcasts it while its measured
    size is below the broadcast threshold.
    """
    limits = projects.filter(F.col("retention_days").isNotNull()).select(
        "project_id", days_before(as_of, F.col("retention_days")).alias("_cutoff")
    )
    return spans.join(limits, "project_id").filter(F.col("started_at") < F.col("_cutoff")).drop("_cutoff")


def retained(spans: DataFrame, projects: DataFrame, as_of) -> DataFrame:
    """Spans that stay; projects without a retention keep everything."""
    limits = projects.filter(F.col("retention_days").isNotNull()).select(
        "project_id", days_before(as_of, F.col("retention_days")).alias("_cutoff")
    )
    keep = F.col("_cutoff").isNull() | (F.col("started_at") >= F.col("_cutoff"))
    return spans.join(limits, "project_id", "left").filter(keep).drop("_cutoff")


def retention_report(spans: DataFrame, projects: DataFrame, as_of) -> DataFrame:
    """Spans to delete per project with a retention, zeros included."""
    narrow = spans.select("project_id", "started_at")
    counts = expired(narrow, projects, as_of).groupBy("project_id").agg(F.count("*").alias("deleted"))
    return (
        projects.filter(F.col("retention_days").isNotNull())
        .select("project_id", "retention_days")
        .join(counts, "project_id", "left")
        .fillna(0, ["deleted"])
    )


def retention_cleanup(spark: SparkSession, path: str, projects: DataFrame, as_of) -> DataFrame:
    """Delete expired spans from a table written by ``spans_sink``; returns (project_id,
    deleted, outcome) of every project with a retention.

    One job counts them per folder, one rewrites the folders that also hold spans to keep,
    and folders without any are removed. The folders' own names are used, so any project
    name works; a folder that cannot be removed is reported for its project only. What
    reaches the driver is one row per folder with expired spans.
    """
    stored = spark.read.parquet(path)
    own = stored.select("*", F.expr("_metadata.file_path").alias("_file"))
    folder = F.regexp_replace("_file", "/[^/]*$", "").alias("_folder")
    limits = projects.filter(F.col("retention_days").isNotNull()).select(
        F.col("project_id").cast(stored.schema["project_id"].dataType).alias("project_id"),
        days_before(as_of, F.col("retention_days")).alias("_cutoff"),
    )
    # Days after the cutoff are not read; the planner prunes them per project.
    old = own.join(limits, "project_id").filter(F.col("date") <= F.to_date("_cutoff"))
    gone = F.col("started_at") < F.col("_cutoff")
    per_folder = (
        old.groupBy("project_id", folder)
        .agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))
        .filter("deleted > 0")
    )
    folders = per_folder.collect()
    if any(f["kept"] for f in folders):
        edges = spark.createDataFrame([(f["_folder"],) for f in folders if f["kept"]], "_folder string")
        kept = old.withColumn("_folder", folder).join(edges, "_folder", "left_semi").filter(~gone)
        # Written aside first: the rewrite reads the folders that it replaces.
        rows = written(kept.select(*stored.columns), "retained-spans")
        (
            rows.hint("rebalance", "project_id", "date").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "date").parquet(path)
        )
    jvm = spark.sparkContext._jvm
    counts: dict[str, int] = {}
    errors: dict[str, str] = {}
    for f in folders:
        project = str(f["project_id"])
        counts[project] = counts.get(project, 0) + f["deleted"]
        if f["kept"]:
            continue
        try:
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f["_folder"]))
            files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if not files.delete(place, True):
                raise OSError(f"{f['_folder']} is still there")
        except Exception as error:  # noqa: BLE001 - reported per project
            errors[project] = str(error)
    rows = [(p, n, errors.get(p, "ok")) for p, n in sorted(counts.items())]
    found = spark.createDataFrame(rows, "project_id string, deleted long, outcome string")
    return (
        projects.filter(F.col("retention_days").isNotNull()).select("project_id")
        .join(found, "project_id", "left").fillna({"deleted": 0, "outcome": "ok"})
    )


def lifecycle_tier(spans: DataFrame, as_of, days: dict[str, int] = TIER_DAYS) -> DataFrame:
    """Add ``age_days``, ``tier`` (hot, warm, cold, delete) and ``generation``.

    ``generation`` numbers the rollover periods of hot data, newest first.
    """
    age: Column = (F.unix_micros(moment(as_of)) - F.unix_micros("started_at")) / 86_400_000_000
    tier = (
        F.when(age >= days["delete"], "delete")
        .when(age >= days["cold"], "cold")
        .when(age >= days["warm"], "warm")
        .otherwise("hot")
    )
    return (
        spans.withColumn("age_days", F.floor(age).cast("int"))
        .withColumn("tier", tier)
        .withColumn(
            "generation", F.when(F.col("tier") == "hot", F.floor(age / days["rollover"]).cast("int"))
        )
    )


def tier_report(spans: DataFrame, as_of, days: dict[str, int] = TIER_DAYS) -> DataFrame:
    """Spans per project and tier."""
    return (
        lifecycle_tier(spans.select("project_id", "started_at"), as_of, days)
        .groupBy("project_id", "tier")
        .agg(F.count("*").alias("spans"), F.min("started_at").alias("oldest"))
    )
