"""The (project, time range) slice that every report starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(value) -> Column:
    """Timestamp column from a column, text or datetime."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def days_before(as_of, days) -> Column:
    return moment(as_of) - F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)


def hours_before(as_of, hours: int) -> Column:
    return moment(as_of) - F.make_dt_interval(hours=F.lit(hours))


def time_slice(
    df: DataFrame, project_id: str | None = None, start=None, end=None, open_end: bool = False
) -> DataFrame:
    """Rows of the project with ``start <= started_at <= end`` (``<`` with ``open_end``)."""
    if project_id is not None:
        df = df.filter(F.col("project_id") == project_id)
    if start is not None:
        df = df.filter(F.col("started_at") >= moment(start))
    if end is not None:
        at = F.col("started_at")
        df = df.filter(at < moment(end) if open_end else at <= moment(end))
    return df


def report_keys(project_id: str | None) -> list[str]:
    """A single project gives an ungrouped report; otherwise one report per project."""
    return ["project_id"] if project_id is None else []
