"""Fuzzy full-text search as one scan: no index, no shuffle before the top-k."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.text import tokens, within_edits
from spanmill.operators.slices import time_slice

_TOKEN = re.compile(r"\w+")


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(_TOKEN.findall(query.lower())))


def matches(query: str, columns: tuple[str, ...] = ("input", "output")) -> Column:
    """True where any token of a text column is near any query term.

    The name is matched as a whole against the whole query.
    """
    terms = query_terms(query)

    def near(word: Column) -> Column:
        hit = F.lit(False)
        for term in terms:
            hit = hit | within_edits(word, term)
        return hit

    found = within_edits(F.col("name"), query)
    for column in columns:
        words = F.array_distinct(tokens(F.col(column)))
        found = F.coalesce(F.exists(words, near), F.lit(False)) | found
    return F.coalesce(found, F.lit(False))


def matching_spans(spans: DataFrame, query: str, project_id: str | None = None) -> DataFrame:
    """All spans that match; an empty query matches everything."""
    rows = time_slice(spans, project_id)
    return rows if query == "" else rows.filter(matches(query))


def search_spans(
    spans: DataFrame, query: str, project_id: str | None = None, offset: int = 0, size: int = 20
) -> DataFrame:
    """Page of matching spans, newest first, with the constant score 1."""
    hits = matching_spans(spans, query, project_id)
    return (
        hits.orderBy(F.desc("started_at"), "span_id")
        .offset(offset)
        .limit(size)
        .withColumn("score", F.lit(1))
    )


def search_total(spans: DataFrame, query: str, project_id: str | None = None) -> DataFrame:
    return matching_spans(spans, query, project_id).agg(F.count("*").alias("total"))


def _hits(words: Column, term: str) -> Column:
    near = F.filter(words, lambda w: within_edits(w, term))
    return F.transform(near, lambda w: F.struct(F.lit(term).alias("term"), w.alias("word")))


def matched_terms(spans: DataFrame, query: str, project_id: str | None = None) -> DataFrame:
    """Distinct indexed terms near each query term, with the spans that hold them."""
    rows = time_slice(spans, project_id)
    words = F.array_distinct(
        F.concat(
            F.coalesce(tokens(F.col("input")), F.array().cast("array<string>")),
            F.coalesce(tokens(F.col("output")), F.array().cast("array<string>")),
        )
    )
    # Filter inside the row, so only hits are exploded and shuffled.
    found = None
    for term in query_terms(query):
        hits = _hits(words, term)
        found = hits if found is None else F.concat(found, hits)
    return (
        rows.select(F.explode(found).alias("_h"))
        .groupBy("_h.term", "_h.word")
        .agg(F.count("*").alias("spans"))
    )
