"""The stored search index against the scan, and what it reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanmill.operators import search
from spanmill.sources import search_index as index
from spanmill.sources.batches import read_spans, spans_sink

SHAPE = """span_id string, trace_id string, project_id string, name string, input string, output string, started_at_text string"""


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    base = ["weather", "wether", "paris", "ab", "a", "abc", "zebra", "crossing", "überlang", "token_count", "x" * 30, "identical"]
    out = set(base)
    while len(out) < 260:
        letters = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            i, kind = rng.randrange(len(letters) + 1), rng.randrange(4)
            if kind == 0:
                letters.insert(i, rng.choice("abtré"))
            elif i < len(letters) and len(letters) > 1:
                if kind == 1:
                    del letters[i]
                elif kind == 2:
                    letters[i] = rng.choice("abtré")
                elif i + 1 < len(letters):
                    letters[i], letters[i + 1] = letters[i + 1], letters[i]
        out.add("".join(letters))
    return base, sorted(out)


@pytest.fixture(scope="module")
def stored(spark, words, tmp_path_factory):
    rng, rows = random.Random(9), []
    for k in range(400):
        text = [" ".join(rng.choices(words[1], k=rng.randint(0, 3))) if rng.random() < 0.9 else None for _ in range(2)]
        name = rng.choice([*words[1], None])
        rows.append((f"s{k:03d}", f"t{k // 3}", f"p{k % 3}", name, *text, f"2024-01-{1 + k % 7:02d} {k % 24:02d}:00:00"))
    rows.append(("odd", None, None, None, "weather", "", None))
    path, root = (str(tmp_path_factory.mktemp("index") / n) for n in ("spans", "index"))
    spans = spark.createDataFrame(rows, SHAPE).withColumn("started_at", F.col("started_at_text").cast("timestamp"))
    spans_sink(spans, path)
    read = read_spans(spark, path)
    for batch in (0, 1, 1):  # a batch that runs again replaces itself
        index.index_spans(read.filter(F.pmod(F.xxhash64("span_id"), F.lit(2)) == batch), root, batch)
    return read, root


def test_equals_the_scan(spark, stored, words):
    spans, root = stored
    for query in ("WEATHER! ab", "!!", "tokne_count", "überlagn abc"):
        want = search.search_spans(spans, query, "p1", offset=3, size=15).select("span_id", "score").collect()
        assert index.search_page(spans, root, query, "p1", offset=3, size=15).select("span_id", "score").collect() == want
        assert index.search_count(spark, root, query).first() == search.search_total(spans, query).first()
    for query in (" ".join(words[0]), "zebar x" + "x" * 28):
        want = sorted(map(tuple, search.matched_terms(spans, query).collect()))
        assert sorted(map(tuple, index.indexed_terms(spark, root, query).collect())) == want


def test_more_words_than_are_pushed(spark, stored, monkeypatch):
    spans, root = stored
    monkeypatch.setattr(index, "PUSHED_TERMS", 3)
    assert index.search_count(spark, root, "weather").first() == search.search_total(spans, "weather").first()


def test_time_range_and_empty_query(spark, stored):
    spans, root = stored
    start, end = "2024-01-02 05:00:00", "2024-01-04 20:00:00"
    inside = spans.filter(F.col("started_at").between(start, end))
    for query in ("weather", ""):
        want = [r.span_id for r in search.search_spans(inside, query, size=30).collect()]
        assert [r.span_id for r in index.search_page(spans, root, query, size=30, start=start, end=end).collect()] == want
    for size in (0, 101):
        with pytest.raises(ValueError):
            index.search_page(spans, root, "weather", size=size)


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return text


def test_only_the_page_reads_texts(spark, stored):
    spans, root = stored
    page = plan(index.search_page(spans, root, "weather", "p1", size=5))
    assert page.count("FileScan") == 1 and "Join" not in page
    assert re.search(r"PartitionFilters: \[[^\]]*date", page) and re.search(r"PushedFilters: \[[^\]]*span_id", page)
    assert "LessThanOrEqual(started_at" in page
    count = plan(index.search_count(spark, root, "weather", "p1", "2024-01-02", "2024-01-03"))
    assert "input:string" not in count and "output:string" not in count
    assert re.search(r"PartitionFilters: \[[^\]]*project_id[^\]]*date", count)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(spelling", count) and re.search(r"PushedFilters: \[.*(EqualTo|In)\(term", count)


def test_spellings_of_a_word(spark):
    row = spark.range(1).select(index.spellings(F.lit("abcdefghijk")).alias("long"), index.spellings(F.lit("ab")).alias("two"), index.spellings(F.lit("é")).alias("one")).first()
    assert (len(row.long), len(row.two), len(row.one)) == (1 + 8 + 28, 3, 1)
    assert len(index._query_spellings("abcdefghijk", 2)) == 37


def test_empty_table(spark, stored, tmp_path):
    spans, _ = stored
    index.index_spans(spans.limit(0), str(tmp_path / "none"))
    assert index.search_count(spark, str(tmp_path / "none"), "weather").first().total == 0
    assert index.search_page(spans.limit(0), str(tmp_path / "none"), "weather").count() == 0


def test_a_term_is_spelled_once_a_batch(spark, tmp_path):
    # Ten days and three projects share their words, as a corpus does: no term is spelled again for each.
    rows = [(f"s{k}", f"t{k}", f"p{k % 3}", "agent", "weather in paris", None, f"2024-01-{1 + k % 10:02d}") for k in range(60)]
    spans = spark.createDataFrame(rows, SHAPE).withColumn("started_at", F.col("started_at_text").cast("timestamp"))
    root = str(tmp_path / "index")
    index.index_spans(spans, root)
    stored = spark.read.parquet(f"{root}/spellings")
    each = {r["term"]: r["count"] for r in stored.filter("cut = 0").groupBy("term").count().collect()}
    assert each == {"weather": 1, "in": 1, "paris": 1, "agent": 1}
    wanted = spark.range(1).select(F.size(index.spellings(F.lit("weather")))).first()[0]
    assert stored.filter("term = 'weather'").count() == wanted
    hits = index.found_spans(spark, root, "wether", "p1", "2024-01-02 00:00:00", "2024-01-02 00:00:00")
    assert sorted(r["span_id"] for r in hits.collect()) == [f"s{k}" for k in range(60) if k % 3 == 1 and k % 10 == 1]
