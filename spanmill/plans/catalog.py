"""All registered queries."""

from spanmill.plans import (  # noqa: F401 - importing registers the queries
    alert_queries,
    call_queries,
    ingest_queries,
    lookup_queries,
    report_queries,
)
from spanmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
