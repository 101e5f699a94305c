"""Stored index of the fuzzy text search: postings and a dictionary of near spellings.

Both tables lie below one root, by batch of indexed spans, so indexing a batch again replaces it.

* ``postings``: (term, field, span_id, trace_id, started_at), by project and day and sorted by
  term, so a search of a project and a time range opens only these folders, and retention can drop
  them with the spans.
* ``spellings``: for each distinct term of a batch, whatever its projects and days, its deletion
  neighbourhood, (spelling, cut, term, field): hashes of the term's first letters with up to two
  of them left out, sorted by hash inside files. Two words within k edits (a swap of neighbours is
  one) have a spelling in common with at most k letters cut from either.

A search looks up the spellings of its terms, checks the edit distance of the few terms found,
and reads their postings. The texts of spans are read for the rows of one page only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.text import fuzziness, tokens, within_edits
from spanmill.operators.search import query_terms
from spanmill.operators.slices import time_slice
from spanmill.sources.tables import write_batch

#: Letters of a term that are varied. Edits behind them do not change the spellings in common.
VARIED = 8
TEXT, NAME = 0, 1
#: Up to so many terms found are filtered for at the scan of the postings; more are joined.
PUSHED_TERMS = 1000
#: Rows of a page of the spellings.
PAGE_ROWS = 1000
#: A page is read by its keys, so it has a largest size.
LARGEST_PAGE = 100

POSTINGS = "term string, field int, span_id string, trace_id string, started_at timestamp, ingest_batch int, project_id string, date date"
SPELLINGS = "spelling bigint, cut int, term string, field int, ingest_batch int"


def _cuts(cut: int, least: int) -> Column:
    """Constant choices of ``cut`` letters: their places (0: none) and the length of term they need."""
    places = [(*out, 0, 0)[:2] for out in combinations(range(1, VARIED + 1), cut)]
    return F.array(*[F.struct(F.lit(max(least, a, b)).alias("need"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in places])


def _without(head: Column, a: Column, b: Column) -> Column:
    """``head`` without the letters at ``a`` and ``b`` (0: none), ``a < b`` if both are given."""
    before, rest = F.substring(head, F.lit(1), a - 1), F.lit(VARIED)
    one = F.concat(before, F.substring(head, a + 1, rest))
    two = F.concat(before, F.substring(head, a + 1, b - a - 1), F.substring(head, b + 1, rest))
    return F.when(a == 0, head).when(b == 0, one).otherwise(two)


def spellings(term: Column) -> Column:
    """Array of (spelling, cut) of a term. A query allows one edit from 3 letters on and two from
    6 on, so terms under 2 letters are never met with a cut, nor those under 4 with two.

    One flat pass over constant choices of letters: choosing them row by row costs many times that.
    """
    head, n = F.substring(term, 1, VARIED), F.length(term)

    def named(cut: int, least: int) -> Column:
        fitting = F.filter(_cuts(cut, least), lambda c: c["need"] <= n)
        hashes = F.array_distinct(F.transform(fitting, lambda c: F.xxhash64(_without(head, c["a"], c["b"]))))
        return F.transform(hashes, lambda h: F.struct(h.alias("spelling"), F.lit(cut).alias("cut")))

    return F.concat(named(0, 0), named(1, 2), named(2, 4))


def _query_spellings(term: str, edits: int) -> list[str]:
    """The same of a query term, for its number of edits: at most 37 texts."""
    head = term[:VARIED]
    cuts = (c for k in range(min(edits, len(head)) + 1) for c in combinations(range(len(head)), k))
    return sorted({"".join(x for i, x in enumerate(head) if i not in c) for c in cuts})


def _terms(spans: DataFrame) -> DataFrame:
    """One row per span, field and distinct term; the name is one term of its own field."""

    def of(texts: Column, field: int) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    empty = F.array().cast("array<string>")
    words = F.array_distinct(F.concat(*[F.coalesce(tokens(F.col(c)), empty) for c in ("input", "output")]))
    name = F.when(F.col("name").isNotNull(), F.array("name")).otherwise(empty)
    both = F.concat(of(words, TEXT), of(name, NAME))
    # The outer form: the inner one makes Spark cut each text again in a filter.
    rows = spans.select("project_id", "date", "span_id", "trace_id", "started_at", F.explode_outer(both).alias("t"))
    return rows.filter(F.col("t").isNotNull()).select("project_id", "date", "t.term", "t.field", "span_id", "trace_id", "started_at")


def index_spans(spans: DataFrame, root: str, batch_id: int = 0) -> None:
    """Write postings and spellings of ``spans`` as batch ``batch_id`` below ``root``.

    Span ids are those of the stored table, each once. Null ids and spans without text have no
    postings for it. The spans are shuffled by project and day before they are cut into terms, which
    are many times larger; the adaptive planner splits a dominant project or day over tasks. Of the
    postings only distinct terms are shuffled, and each is spelled where it lies.
    """
    named = spans.filter(F.col("span_id").isNotNull()).withColumn("date", F.to_date("started_at"))
    texts = named.select("project_id", "date", "span_id", "trace_id", "started_at", "name", "input", "output")
    found = _terms(texts.hint("rebalance", "project_id", "date"))
    order = ("project_id", "date", "field", "term", "span_id")
    write_batch(found.sortWithinPartitions(*order), f"{root}/postings", batch_id, "project_id", "date")
    stored = _read(spans.sparkSession, f"{root}/postings", POSTINGS, None, None, None)
    terms = stored.filter(F.col("ingest_batch") == batch_id).select("term", "field").distinct()
    spelled = terms.select("term", "field", F.explode_outer(spellings(F.col("term"))).alias("s"))
    spelled = spelled.select("s.spelling", "s.cut", "term", "field").sortWithinPartitions("spelling")
    # Small pages: a lookup reads one page of a file for each spelling.
    pages = spelled.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS)
    pages.parquet(f"{root}/spellings/ingest_batch={batch_id}")


def _read(spark: SparkSession, path: str, schema: str, project_id, start, end) -> DataFrame:
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    if start is not None:
        rows = rows.filter(F.col("date") >= F.to_date(F.lit(start).cast("timestamp")))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.to_date(F.lit(end).cast("timestamp")))
    return rows


def near_terms(spark: SparkSession, root: str, query: str) -> DataFrame:
    """(term, field, word): indexed words near each query term, and names near the whole query
    (field ``NAME``), of all projects and days."""
    table = _read(spark, f"{root}/spellings", SPELLINGS, None, None, None)
    wanted = [(t, TEXT) for t in query_terms(query)] + [(query, NAME)]
    hits = []
    for term, field in wanted:
        edits = fuzziness(term)
        # Single comparisons, not a list: a long list is pushed to the scan as a range only.
        same = reduce(lambda a, b: a | b, [F.col("spelling") == F.xxhash64(F.lit(s)) for s in _query_spellings(term, edits)])
        near = table.filter((F.col("field") == field) & (F.col("cut") <= edits) & same & within_edits(F.col("term"), term))
        hits.append(near.select(F.lit(term).alias("term"), "field", F.col("term").alias("word")))
    return reduce(DataFrame.unionByName, hits).distinct()


def _postings(spark: SparkSession, root: str, query: str, project_id, start, end) -> DataFrame:
    """Postings of the words near the query, with the query's term."""
    terms = near_terms(spark, root, query)
    rows = time_slice(_read(spark, f"{root}/postings", POSTINGS, project_id, start, end), None, start, end)
    rows = rows.withColumnRenamed("term", "word")
    few = terms.select("word", "field").distinct().limit(PUSHED_TERMS + 1).collect()
    if len(few) <= PUSHED_TERMS:
        by_field = [F.lit(False)]
        for field in (TEXT, NAME):
            words = sorted(r["word"] for r in few if r["field"] == field)
            if words:
                by_field.append((F.col("field") == field) & F.col("word").isin(words))
        rows = rows.filter(reduce(lambda a, b: a | b, by_field))
    return rows.join(terms, ["word", "field"])


def found_spans(spark: SparkSession, root: str, query: str, project_id: str | None = None, start=None, end=None) -> DataFrame:
    """(project_id, span_id, trace_id, started_at) of every span that a query finds, each once."""
    rows = _postings(spark, root, query, project_id, start, end)
    return rows.select("project_id", "date", "span_id", "trace_id", "started_at").distinct()


def search_page(
    spans: DataFrame, root: str, query: str, project_id: str | None = None, offset: int = 0, size: int = 20, start=None, end=None
) -> DataFrame:
    """Page of stored spans that match, newest first, with the constant score 1: the answer of
    ``search_spans``, with ``start <= started_at <= end``.

    The page is found from postings alone. Its keys, at most ``size`` (100 or fewer), go into
    the filters of the scan of ``spans``, where day, start and id choose files and row groups.
    An empty query matches every span and reads no index.
    """
    if not 0 < size <= LARGEST_PAGE:
        raise ValueError(f"size must be from 1 to {LARGEST_PAGE}")
    spark = spans.sparkSession
    order = (F.desc("started_at"), "span_id")
    hits = time_slice(spans, project_id, start, end) if query == "" else found_spans(spark, root, query, project_id, start, end)
    keys = ["project_id", "span_id", "started_at", F.to_date("started_at").alias("date")]
    page = hits.orderBy(*order).offset(offset).limit(size).select(*keys).collect()
    rows = spans.filter(F.lit(bool(page)))
    if page:
        for name in ("project_id", "span_id", "started_at", *(["date"] if "date" in spans.columns else [])):
            values = {r[name] for r in page}
            known = sorted(v for v in values if v is not None)
            rows = rows.filter(F.col(name).isin(known) if None not in values else F.col(name).isin(known) | F.col(name).isNull())
        starts = [r["started_at"] for r in page if r["started_at"] is not None]
        if len(starts) == len(page):  # a list is pushed to the scan as a range at best: say it
            rows = rows.filter(F.col("started_at").between(F.lit(min(starts)), F.lit(max(starts))))
    return rows.orderBy(*order).withColumn("score", F.lit(1))


def search_count(spark: SparkSession, root: str, query: str, project_id: str | None = None, start=None, end=None) -> DataFrame:
    """Number of spans that a query finds, from the index alone."""
    return found_spans(spark, root, query, project_id, start, end).agg(F.count("*").alias("total"))


def indexed_terms(spark: SparkSession, root: str, query: str, project_id: str | None = None, start=None, end=None) -> DataFrame:
    """(term, word, spans): words near each query term and the number of spans with them."""
    rows = _postings(spark, root, query, project_id, start, end).filter(F.col("field") == TEXT)
    return rows.groupBy("term", "word").agg(F.count("*").alias("spans"))
