"""Error messages grouped into clusters, and terms typical of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.stats import combined, top_k
from spanmill.functions.text import normalize_message, tokens
from spanmill.operators.slices import report_keys, time_slice
from spanmill.session import written

#: A word with a digit, a path or an inner dot, colon or hyphen is likely to name one thing only.
_NAMES_ONE_THING = r"[0-9/\\@_=<]|[A-Za-z0-9][.:-][A-Za-z0-9]"
#: Plain words in one place make it variable from so many on.
PLAIN_VALUES = 5
#: Pairs of places are tried in messages of up to so many words.
PAIR_WORDS = 24
WILDCARD = "<*>"


def _clusters(errors: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Clusters of ``errors`` by their ``pattern`` column."""
    group = [*keys, "pattern"]
    sizes = errors.groupBy(*group).agg(
        F.count("*").alias("span_count"), F.max("started_at").alias("last_seen")
    )
    top = top_k(sizes, keys, [F.desc("span_count"), F.asc("pattern")], limit)
    # Everything below is only computed for spans of the few clusters on the list.
    rows = errors.join(top.select(*group), group, "left_semi")
    traces = rows.groupBy(*group).agg(F.count_distinct("trace_id").alias("count"))
    newest = top_k(rows, group, [F.desc("started_at"), F.asc("span_id")], 3)
    samples = newest.groupBy(*group).agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.unix_micros("started_at")).alias("t"), "span_id", "trace_id")
            )
        ).alias("_samples")
    )
    by_model = (
        rows.filter(F.col("model").isNotNull()).groupBy(*group, "model").agg(F.count("*").alias("_n"))
    )
    busiest = top_k(by_model, group, [F.desc("_n"), F.asc("model")], 5)
    models = busiest.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), "model"))).alias("_models")
    )
    empty = F.array().cast("array<string>")
    return combined(group, top, traces, samples, models).select(
        *group,
        "span_count",
        "count",
        F.coalesce(F.transform("_samples", lambda s: s["trace_id"]), empty).alias("trace_ids"),
        F.coalesce(F.transform("_models", lambda m: m["model"]), empty).alias("models"),
        "last_seen",
    )


def _error_rows(spans: DataFrame, project_id, start, end, pattern: Column) -> DataFrame:
    """Only the narrow columns of failed spans with a message."""
    return (
        time_slice(spans, project_id, start, end)
        .filter((F.col("status") == "error") & F.col("error_message").isNotNull())
        .select(
            *report_keys(project_id),
            pattern.alias("pattern"),
            "span_id",
            "trace_id",
            "model",
            "started_at",
        )
    )


def error_clusters(spans: DataFrame, project_id=None, start=None, end=None, limit: int = 10) -> DataFrame:
    """Most frequent error messages with their traces, models and last time."""
    rows = _error_rows(spans, project_id, start, end, F.col("error_message"))
    return _clusters(rows, report_keys(project_id), limit)


def error_clusters_normalized(
    spans: DataFrame, project_id=None, start=None, end=None, limit: int = 10
) -> DataFrame:
    """The same after replacing ids and numbers, so that similar messages meet."""
    rows = _error_rows(spans, project_id, start, end, normalize_message(F.col("error_message")))
    return _clusters(rows, report_keys(project_id), limit)


def message_templates(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, message, pattern): distinct messages with their variable words as ``WILDCARD``.

    Messages meet where they have the same words but for one place or two. One place is variable
    if at least PLAIN_VALUES messages, or at least two whose words there all seem to name one
    thing (a file, a host, an id), are equal outside it; two places if all words in both seem to
    and both differ. Every message sends one row per place (or pair, up to PAIR_WORDS words) to a
    hash of the rest, so messages are never compared in pairs and a template with very many
    messages is combined before the shuffle. A message that meets no other is its own pattern.
    """
    distinct = messages.select(*keys, "message").distinct()
    rows = written(distinct.withColumn("_words", F.split("message", " ", -1)), "messages")
    n = F.size("_words")
    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), i.alias("j")))
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda j: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: i < j), lambda i: F.struct(i.alias("i"), j.alias("j"))),
        )
    )
    places = F.when(n <= PAIR_WORDS, F.concat(single, pairs)).otherwise(single)
    placed = rows.select(*keys, "message", "_words", F.explode(places).alias("_at")).select(
        *keys, "message", "_words", F.col("_at.i").alias("_i"), F.col("_at.j").alias("_j")
    )
    rest = F.transform("_words", lambda w, k: F.when((k == F.col("_i")) | (k == F.col("_j")), "\0").otherwise(w))
    first, second = F.get("_words", F.col("_i")), F.get("_words", F.col("_j"))
    placed = placed.select(
        *keys, "message", "_i", "_j", F.md5(F.array_join(rest, " ")).alias("_rest"), first.alias("_a"), second.alias("_b")
    )
    named = F.bool_and(F.col("_a").rlike(_NAMES_ONE_THING) & F.col("_b").rlike(_NAMES_ONE_THING))
    group = [*keys, "_i", "_j", "_rest"]
    differ = (F.min("_a") != F.max("_a")) & (F.min("_b") != F.max("_b"))
    variable = placed.groupBy(*group).agg(((F.col("_i") == F.col("_j")) & (F.count("*") >= PLAIN_VALUES) | named & differ).alias("_variable"))
    found = placed.join(variable.filter("_variable").drop("_variable"), group)
    masks = found.groupBy(*keys, "message").agg(F.array_distinct(F.flatten(F.collect_set(F.array("_i", "_j")))).alias("_mask"))
    masked = F.transform("_words", lambda w, k: F.when(F.array_contains("_mask", k), WILDCARD).otherwise(w))
    pattern = F.when(F.col("_mask").isNull(), F.col("message")).otherwise(F.array_join(masked, " "))
    return rows.join(masks, [*keys, "message"], "left").select(*keys, "message", pattern.alias("pattern"))


def error_clusters_similar(
    spans: DataFrame, project_id=None, start=None, end=None, limit: int = 10
) -> DataFrame:
    """The same by template: messages that also differ in the names of files, hosts and the
    like meet (see ``message_templates``). Writes the distinct messages and their templates."""
    keys = report_keys(project_id)
    rows = _error_rows(spans, project_id, start, end, normalize_message(F.col("error_message"))).withColumnRenamed("pattern", "message")
    templates = written(message_templates(rows.select(*keys, "message"), keys), "message-templates")
    met = rows.join(templates, [*keys, "message"], "left").withColumn("pattern", F.coalesce("pattern", "message"))
    return _clusters(met.drop("message"), keys, limit)


def error_significant_terms(
    spans: DataFrame, column: str, project_id=None, start=None, end=None, limit: int = 10
) -> DataFrame:
    """Terms of ``column`` that are more frequent in failed spans than overall.

    Scored by (fg - bg) * (fg / bg) with the shares of spans that hold the term.
    """
    # Grouped by project even for a single one, so that sizes meet terms on a key.
    keys = ["project_id"]
    rows = time_slice(spans, project_id, start, end).filter(F.col(column).isNotNull())
    failed = F.col("status") == "error"
    sizes = rows.groupBy(*keys).agg(
        F.count("*").alias("bg_size"), F.count_if(failed).alias("fg_size")
    )
    terms = rows.select(
        *keys, failed.alias("_failed"), F.explode(F.array_distinct(tokens(F.col(column)))).alias("term")
    )
    counts = terms.groupBy(*keys, "term").agg(
        F.count("*").alias("bg_count"), F.count_if("_failed").alias("fg_count")
    )
    sized = counts.filter("fg_count > 0").join(sizes, keys)
    fg = F.col("fg_count") / F.col("fg_size")
    bg = F.col("bg_count") / F.col("bg_size")
    scored = sized.withColumn("score", (fg - bg) * (fg / bg)).filter("score > 0")
    columns = [*report_keys(project_id), "term", "fg_count", "fg_size", "bg_count", "bg_size", "score"]
    order = [F.desc(F.round("score", 9)), F.asc("term")]
    return top_k(scored, report_keys(project_id), order, limit).select(*columns)
