"""Queries over search, listings, paging, trees and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import search, traces, tree
from spanmill.plans import derived as d
from spanmill.plans.registry import placed, query
from spanmill.session import work_path
from spanmill.sources import search_index
from spanmill.sources.batches import read_spans, spans_sink

QUERY = "that tion queque"
#: Its terms, r and d, are no words of any text, but an agent's name holds it.
NO_WORD = "r-d"
_TERMS = {"that": 1, "tion": 1, "queque": 2}

_SQL_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
# That function counts bytes. The terms are ASCII, so one sign for all other letters is exact.
_SQL_WORD = r"regexp_replace(word, '[^\x00-\x7F]', '#', 'g')"
_SQL_HIT = " OR ".join(f"damerau_levenshtein({_SQL_WORD}, '{t}') <= {k}" for t, k in _TERMS.items())
_SQL_MATCHING = f"""matching AS (SELECT * FROM text_spans WHERE span_id IN (
    SELECT span_id FROM postings WHERE word IN (SELECT word FROM (SELECT DISTINCT word FROM postings)
      WHERE {_SQL_HIT})) OR damerau_levenshtein(name, '{QUERY}') <= 2)"""
_SQL_POSTINGS = f"""postings AS (
    SELECT DISTINCT span_id, unnest(list_concat({_SQL_TOKENS.format('input')},
      {_SQL_TOKENS.format("coalesce(output, '')")})) AS word FROM text_spans)"""


@query(
    "search_spans",
    "text_spans",
    f"""WITH {_SQL_POSTINGS}, {_SQL_MATCHING}
    SELECT span_id, trace_id, name, started_at, 1 AS score FROM matching WHERE project_id = 'p1'
    ORDER BY started_at DESC, span_id LIMIT 20 OFFSET 10""",
)
def _(spark, sf):
    hits = search.search_spans(d.text_spans(spark, sf), QUERY, "p1", offset=10, size=20)
    return hits.select("span_id", "trace_id", "name", "started_at", "score")


@query(
    "search_total",
    "text_spans",
    f"WITH {_SQL_POSTINGS}, {_SQL_MATCHING} SELECT count(*) AS total FROM matching",
)
def _(spark, sf):
    return search.search_total(d.text_spans(spark, sf), QUERY)


@query(
    "search_terms",
    "text_spans",
    f"""WITH {_SQL_POSTINGS}, q AS (SELECT * FROM (VALUES ('that', 1), ('tion', 1), ('queque', 2)) AS t(term, k))
    SELECT term, word, count(*) AS spans FROM postings JOIN q ON damerau_levenshtein({_SQL_WORD}, term) <= k
    GROUP BY 1, 2""",
)
def _(spark, sf):
    return search.matched_terms(d.text_spans(spark, sf), QUERY)


def _indexed(spark, sf):
    """The text spans in the layout of the sink, and their index in two batches."""
    stored, root = work_path(spark, "text-spans"), work_path(spark, "search-index")
    spans_sink(d.text_spans(spark, sf), stored)
    spans = read_spans(spark, stored)
    for batch in (0, 1):
        search_index.index_spans(spans.filter(F.pmod(F.xxhash64("trace_id"), F.lit(2)) == batch), root, batch)
    return spans, root


@query(
    "search_index_page",
    "text_spans",
    f"""WITH {_SQL_POSTINGS}, {_SQL_MATCHING}
    SELECT span_id, trace_id, name, started_at, 1 AS score, length(input) AS input_chars
    FROM matching WHERE project_id = 'p1' ORDER BY started_at DESC, span_id LIMIT 20 OFFSET 10""",
)
def _(spark, sf):
    spans, root = _indexed(spark, sf)
    hits = search_index.search_page(spans, root, QUERY, "p1", offset=10, size=20)
    return hits.select("span_id", "trace_id", "name", "started_at", "score", F.length("input").cast("bigint").alias("input_chars"))


@query(
    "search_index_range",
    "text_spans",
    f"""WITH {_SQL_POSTINGS}, {_SQL_MATCHING}
    SELECT span_id, started_at FROM matching
    WHERE started_at >= TIMESTAMP '2024-01-02 06:00:00' AND started_at <= TIMESTAMP '2024-01-09 12:00:00'
    ORDER BY started_at DESC, span_id LIMIT 50""",
)
def _(spark, sf):
    spans, root = _indexed(spark, sf)
    hits = search_index.search_page(
        spans, root, QUERY, size=50, start="2024-01-02 06:00:00", end="2024-01-09 12:00:00"
    )
    return hits.select("span_id", "started_at")


@query(
    "search_index_total",
    "text_spans",
    f"WITH {_SQL_POSTINGS}, {_SQL_MATCHING} SELECT count(*) AS total FROM matching",
)
def _(spark, sf):
    return search_index.search_count(spark, _indexed(spark, sf)[1], QUERY)


@query(
    "search_index_terms",
    "text_spans",
    f"""WITH {_SQL_POSTINGS}, q AS (SELECT * FROM (VALUES ('that', 1), ('tion', 1), ('queque', 2)) AS t(term, k))
    SELECT term, word, count(*) AS spans FROM postings JOIN q ON damerau_levenshtein({_SQL_WORD}, term) <= k
    GROUP BY 1, 2""",
)
def _(spark, sf):
    return search_index.indexed_terms(spark, _indexed(spark, sf)[1], QUERY)


@query(
    "span_detail",
    "text_spans",
    "SELECT span_id, name, status, input, output FROM text_spans WHERE span_id = 'doc-57' AND project_id = 'p1'",
)
def _(spark, sf):
    rows = traces.span_detail(d.text_spans(spark, sf), "doc-57", "p1")
    return rows.select("span_id", "name", "status", "input", "output")


@query(
    "list_traces",
    "traces",
    """SELECT trace_id, status, agent_name, total_latency_ms, round(total_cost_usd, 9) AS total_cost_usd
    FROM traces WHERE project_id = 'p0' AND status = 'error' AND agent_name ILIKE '%AGENT%'
      AND started_at >= TIMESTAMP '2024-01-02' AND started_at <= TIMESTAMP '2024-01-28'
      AND total_latency_ms >= 1000 AND total_latency_ms <= 20000 AND total_cost_usd >= 0.001
      AND total_cost_usd <= 0.10
      AND trace_id IN (SELECT trace_id FROM spans WHERE model ILIKE '%gpt%' AND project_id = 'p0')""",
)
def _(spark, sf):
    rows = traces.list_traces(
        d.traces(spark, sf), d.spans(spark, sf), project_id="p0", status="error", agent_name="AGENT",
        start="2024-01-02", end="2024-01-28", model="gpt", latency=(1000, 20000), cost=(0.001, 0.10),
    )
    return rows.select("trace_id", "status", "agent_name", "total_latency_ms", "total_cost_usd")


_TEXT_TRACES = """tt AS (SELECT trace_id, min(project_id) AS project_id, min(started_at) AS started_at,
    min(name) FILTER (parent_span_id IS NULL) AS agent_name FROM text_spans GROUP BY trace_id)"""


def _text_traces(spark, sf):
    from spanmill.operators.rollup import finish_traces, trace_partials

    spans = d.text_spans(spark, sf)
    missing = F.lit(None)
    full = spans.withColumns(
        {
            "input_tokens": missing.cast("int"),
            "output_tokens": missing.cast("int"),
            "cost_usd": missing.cast("double"),
            "latency_ms": missing.cast("int"),
            "metadata": F.lit("{}"),
            "ended_at": missing.cast("timestamp"),
        }
    )
    return finish_traces(trace_partials(full))


@query(
    "list_traces_search",
    "text_spans",
    f"""WITH {_SQL_POSTINGS}, {_SQL_MATCHING}, {_TEXT_TRACES},
    hits AS (SELECT trace_id FROM matching WHERE project_id = 'p1' ORDER BY started_at DESC, span_id)
    SELECT trace_id, started_at FROM tt WHERE project_id = 'p1' AND trace_id IN (SELECT trace_id FROM hits)""",
)
def _(spark, sf):
    rows = traces.list_traces(
        _text_traces(spark, sf), d.text_spans(spark, sf), project_id="p1", search=QUERY
    )
    return rows.select("trace_id", "started_at")


@query(
    "list_traces_search_fallback",
    "text_spans",
    f"""WITH {_TEXT_TRACES} SELECT trace_id, started_at FROM tt
    WHERE project_id = 'p1' AND agent_name ILIKE '%{NO_WORD}%'""",
)
def _(spark, sf):
    # No span holds a word near this one, so the agent name decides.
    rows = traces.list_traces(
        _text_traces(spark, sf), d.text_spans(spark, sf), project_id="p1", search=NO_WORD
    )
    return rows.select("trace_id", "started_at")


@query(
    "list_traces_total",
    "text_spans",
    f"""WITH {_TEXT_TRACES} SELECT count(*) AS total FROM tt WHERE project_id = 'p1'""",
)
def _(spark, sf):
    return traces.trace_total(traces.list_traces(_text_traces(spark, sf), project_id="p1"))


# The second page: its cursor is the last row of the first one.
@query(
    "trace_page",
    "traces",
    """WITH numbered AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, trace_id DESC) AS n
      FROM traces WHERE project_id = 'p0')
    SELECT trace_id, started_at, CASE WHEN n = 40 THEN to_base64(encode('{"startedAt":"'
        || strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '","id":"' || trace_id || '"}')) END AS next_cursor
    FROM numbered WHERE n BETWEEN 21 AND 40""",
)
def _(spark, sf):
    listed = traces.list_traces(d.traces(spark, sf), project_id="p0")
    first = traces.trace_page(listed, 20)
    cursor = first.filter("next_cursor IS NOT NULL").first()["next_cursor"]
    second = traces.trace_page(listed, 20, cursor)
    return second.select("trace_id", "started_at", "next_cursor")


@query(
    "trace_page_preview",
    "text_spans",
    f"""WITH {_TEXT_TRACES}, page AS (SELECT * FROM tt ORDER BY started_at DESC, trace_id DESC LIMIT 20)
    SELECT trace_id, left(input, 100) AS input_preview FROM page JOIN text_spans USING (trace_id)
    WHERE parent_span_id IS NULL""",
)
def _(spark, sf):
    page = traces.trace_page(_text_traces(spark, sf), 20)
    return traces.with_preview(page, d.text_spans(spark, sf)).select("trace_id", "input_preview")


@query(
    "trace_preview_or_error",
    "text_spans",
    f"""WITH {_TEXT_TRACES}, st AS (SELECT trace_id, bool_or(status = 'error') AS failed,
      arg_max(error_message, started_at) FILTER (error_message IS NOT NULL) AS message,
      min(left(input, 60)) FILTER (parent_span_id IS NULL) AS preview FROM text_spans GROUP BY 1)
    SELECT trace_id, CASE WHEN failed THEN coalesce(message, preview) ELSE preview END AS preview
    FROM tt JOIN st USING (trace_id)""",
)
def _(spark, sf):
    rows = traces.trace_preview_or_error(_text_traces(spark, sf), d.text_spans(spark, sf))
    return rows.select("trace_id", "preview")


@query(
    "list_spans_legacy",
    "spans",
    """SELECT span_id, trace_id, status, started_at FROM spans WHERE project_id = 'p2' AND status = 'error'
      AND started_at >= TIMESTAMP '2024-01-03' AND started_at <= TIMESTAMP '2024-01-27'
    ORDER BY started_at DESC, span_id LIMIT 50 OFFSET 25""",
)
def _(spark, sf):
    page, _ = traces.list_spans_legacy(
        d.spans(spark, sf), project_id="p2", status="error", start="2024-01-03", end="2024-01-27", offset=25
    )
    return page.select("span_id", "trace_id", "status", "started_at")


@query(
    "list_spans_legacy_total",
    "spans",
    """SELECT count(*) AS total FROM spans WHERE project_id = 'p2' AND status = 'error'
      AND started_at >= TIMESTAMP '2024-01-03' AND started_at <= TIMESTAMP '2024-01-27'""",
)
def _(spark, sf):
    _, total = traces.list_spans_legacy(
        d.spans(spark, sf), project_id="p2", status="error", start="2024-01-03", end="2024-01-27"
    )
    return total


@query(
    "spans_by_trace",
    "spans",
    """SELECT trace_id, span_id, started_at,
      CAST(row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) AS INTEGER) AS place FROM spans""",
)
def _(spark, sf):
    rows = traces.spans_by_trace(d.spans(spark, sf)).select("trace_id", "span_id", "started_at")
    return placed(rows, "trace_id")


_SQL_TREE = """tree AS (
    SELECT s.trace_id, s.span_id, s.span_id AS root_id, 0 AS depth,
      lpad(CAST(epoch_us(s.started_at) AS VARCHAR), 20, '0') || ':' || s.span_id AS path
    FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id
    WHERE p.span_id IS NULL
    UNION ALL
    SELECT c.trace_id, c.span_id, t.root_id, t.depth + 1,
      t.path || chr(1) || lpad(CAST(epoch_us(c.started_at) AS VARCHAR), 20, '0') || ':' || c.span_id
    FROM spans c JOIN tree t ON t.trace_id = c.trace_id AND t.span_id = c.parent_span_id)"""


@query(
    "trace_tree",
    "spans",
    f"WITH RECURSIVE {_SQL_TREE} SELECT trace_id, span_id, root_id, CAST(depth AS INT) AS depth FROM tree",
)
def _(spark, sf):
    return tree.trace_tree(d.spans(spark, sf)).select("trace_id", "span_id", "root_id", "depth")


# Orphans: the middle spans are gone, so their children become roots.
@query(
    "trace_tree_orphans",
    "raw_spans",
    """WITH RECURSIVE spans AS (SELECT * FROM raw_spans WHERE name <> 'retrieve-context'), """
    + _SQL_TREE
    + " SELECT trace_id, span_id, root_id, CAST(depth AS INT) AS depth FROM tree",
)
def _(spark, sf):
    kept = d.raw_spans(spark, sf).filter("name <> 'retrieve-context'")
    return tree.trace_tree(kept).select("trace_id", "span_id", "root_id", "depth")


@query(
    "flatten_tree",
    "spans",
    f"""WITH RECURSIVE {_SQL_TREE} SELECT trace_id, span_id, CAST(depth AS INT) AS depth, path,
      CAST(row_number() OVER (PARTITION BY trace_id ORDER BY path) AS INTEGER) AS place FROM tree""",
)
def _(spark, sf):
    flat = tree.flatten_tree(tree.trace_tree(d.spans(spark, sf)))
    rows = flat.select("trace_id", "span_id", "depth", tree.sort_path().alias("path"))
    return placed(rows, "trace_id")


@query(
    "span_timeline",
    "spans",
    """WITH e AS (SELECT trace_id, span_id, epoch_us(started_at) // 1000 AS s,
      epoch_us(coalesce(ended_at, started_at)) // 1000 AS e FROM spans),
    b AS (SELECT trace_id, min(s) AS lo, max(e) AS hi FROM e GROUP BY 1)
    SELECT trace_id, span_id, round((s - lo) * 100e0 / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 9) AS offset_pct,
      round(greatest((e - s) * 100e0 / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 0.5e0), 9) AS width_pct
    FROM e JOIN b USING (trace_id)""",
)
def _(spark, sf):
    return tree.span_timeline(d.spans(spark, sf)).select("trace_id", "span_id", "offset_pct", "width_pct")


_SQL_NAMED = f"""{_SQL_TREE}, named AS (SELECT trace_id, name, arg_max(s, path) AS s FROM (
      SELECT t.trace_id, name, path, {{'status': status, 'latency_ms': latency_ms, 'cost_usd': cost_usd,
        'tokens': coalesce(input_tokens, 0) + coalesce(output_tokens, 0)}} AS s
      FROM tree t JOIN spans USING (trace_id, span_id)) GROUP BY 1, 2)"""


@query(
    "compare_traces",
    "spans",
    f"""WITH RECURSIVE {_SQL_NAMED}, pairs AS (
      SELECT trace_id AS trace_a, 'tr-' || (CAST(substring(trace_id, 4) AS BIGINT) + 4) AS trace_b
      FROM (SELECT DISTINCT trace_id FROM spans)),
    a AS (SELECT trace_a, trace_b, name, s FROM pairs JOIN named ON trace_id = trace_a),
    b AS (SELECT trace_a, trace_b, name, s FROM pairs JOIN named ON trace_id = trace_b)
    SELECT trace_a, trace_b, name, a.s IS NULL AS missing_a, b.s IS NULL AS missing_b,
      a.s.status AS status_a, a.s.latency_ms AS latency_ms_a, round(a.s.cost_usd, 9) AS cost_usd_a,
      CAST(a.s.tokens AS BIGINT) AS tokens_a, b.s.status AS status_b, b.s.latency_ms AS latency_ms_b,
      round(b.s.cost_usd, 9) AS cost_usd_b, CAST(b.s.tokens AS BIGINT) AS tokens_b,
      b.s.latency_ms - a.s.latency_ms AS latency_diff_ms, a.s.tokens IS DISTINCT FROM b.s.tokens
        OR a.s.status IS DISTINCT FROM b.s.status OR a.s.latency_ms IS DISTINCT FROM b.s.latency_ms
        OR round(a.s.cost_usd, 9) IS DISTINCT FROM round(b.s.cost_usd, 9) AS different
    FROM a FULL JOIN b USING (trace_a, trace_b, name)""",
)
def _(spark, sf):
    spans = d.spans(spark, sf)
    following = F.expr("concat('tr-', CAST(substring(trace_id, 4) AS BIGINT) + 4)")
    pairs = spans.select(F.col("trace_id").alias("trace_a"), following.alias("trace_b")).distinct()
    return tree.compare_trace_pairs(tree.trace_tree(spans), pairs)


@query(
    "compare_totals",
    "traces",
    """WITH v AS (SELECT trace_id, unnest(['status', 'total_spans', 'total_latency_ms', 'total_tokens']) AS field,
        unnest([status, CAST(total_spans AS VARCHAR), CAST(total_latency_ms AS VARCHAR),
          CAST(total_tokens AS VARCHAR)]) AS value
      FROM traces WHERE trace_id IN ('tr-0', 'tr-4'))
    SELECT a.field, a.value AS value_a, b.value AS value_b, a.value IS DISTINCT FROM b.value AS different
    FROM v a JOIN v b ON a.field = b.field AND a.trace_id = 'tr-0' AND b.trace_id = 'tr-4'""",
)
def _(spark, sf):
    totals = tree.compare_totals(d.traces(spark, sf), "tr-0", "tr-4")
    return totals.filter("field <> 'total_cost_usd'")
