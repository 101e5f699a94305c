"""Search matching against brute force, and the small text functions."""

import random

from pyspark.sql import functions as F

from spanmill.functions import text
from spanmill.functions.spans import cost_bucket, latency_bucket
from spanmill.operators import search


def osa(a, b):
    """Optimal string alignment distance."""
    rows = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(
                rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1])
            )
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i][j] = best
    return rows[-1][-1]


def test_edit_distance_equals_brute_force(spark):
    rng = random.Random(7)
    for term in ("ab", "abc", "abcab", "abcabc", "aabbccdd"):
        words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(0, 10))) for _ in range(400)}
        for _ in range(600):
            letters = list(term)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(letters) + 1)
                kind = rng.randrange(4)
                if kind == 0:
                    letters.insert(i, rng.choice("abcdé"))
                elif letters and i < len(letters):
                    if kind == 1:
                        del letters[i]
                    elif kind == 2:
                        letters[i] = rng.choice("abcdé")
                    elif i + 1 < len(letters):
                        letters[i], letters[i + 1] = letters[i + 1], letters[i]
            words.add("".join(letters))
        df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
        got = {r["w"] for r in df.filter(text.within_edits(F.col("w"), term)).collect()}
        assert got == {w for w in words if osa(w, term) <= text.fuzziness(term)}, term


def spans(spark, rows):
    return spark.createDataFrame(
        rows,
        """span_id string, project_id string, name string, input string, output string,
        started_at_text string""",
    ).withColumn("started_at", F.col("started_at_text").cast("timestamp"))


def test_search(spark):
    df = spans(
        spark,
        [
            ("a", "p", "chat", "The Weather in Paris", None, "2024-01-01"),
            ("b", "p", "chat", None, "wheather report", "2024-01-03"),
            ("c", "p", "wether", "nothing", None, "2024-01-02"),
            ("d", "p", "chat", None, None, "2024-01-04"),
            ("e", "q", "chat", "weather", None, "2024-01-05"),
        ],
    )
    found = [r["span_id"] for r in search.search_spans(df, "weather", "p").collect()]
    assert found == ["b", "c", "a"]
    assert search.search_total(df, "", "p").first()["total"] == 4
    assert [r["span_id"] for r in search.search_spans(df, "", "p", offset=1, size=2).collect()] == ["b", "c"]
    assert search.search_total(df, "zebra crossing").first()["total"] == 0


def test_search_is_one_scan(spark):
    df = spans(spark, [("a", "p", "chat", "x", None, "2024-01-01")])
    plan = search.search_spans(df, "weather", "p")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Exchange" not in plan and "Join" not in plan


def test_time_ago(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    cases = {
        "2024-01-02 00:00:05": "just now",
        "2024-01-01 23:59:51": "just now",
        "2024-01-01 23:59:50": "10s ago",
        "2024-01-01 23:58:00": "2m ago",
        "2024-01-01 21:00:00": "3h ago",
        "2023-12-30 23:00:00": "2d ago",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", text.time_ago(F.col("t").cast("timestamp"), as_of).alias("a")).collect():
        assert row["a"] == cases[row["t"]]


def test_chat_messages(spark):
    cases = {
        '[{"role":"user","content":"hi"},{"role":"assistant","content":null}]': [("user", "hi"), ("assistant", None)],
        '[{"role":"user","content":[{"type":"text"}]}]': [("user", '[{"type":"text"}]')],
        "[]": None,
        "[1]": None,
        '[{"role":1,"content":"x"}]': None,
        '[{"role":"user"}]': None,
        '{"role":"user","content":"x"}': None,
        "not json": None,
        '[{"role":"user","content":"x"},5]': None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", text.chat_messages(F.col("t")).alias("m")).collect():
        got = None if row["m"] is None else [tuple(m) for m in row["m"]]
        assert got == cases[row["t"]], row["t"]


def test_normalized_messages(spark):
    cases = {
        "timeout after 3000ms": "timeout after <num>ms",
        "id 123e4567-e89b-12d3-a456-426614174000 lost": "id <uuid> lost",
        "at 0xDEADBEEF": "at <hex>",
        "commit 9f86d081884c7d65": "commit <hex>",
        "deadbeef cafe": "deadbeef cafe",
        "took 1.5 s": "took <num> s",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", text.normalize_message(F.col("t")).alias("m")).collect():
        assert row["m"] == cases[row["t"]]


def test_buckets(spark):
    df = spark.createDataFrame(
        [(1000, 0.01), (1001, 0.1), (3000, 0.2), (5001, None), (None, 0.0)], "l int, c double"
    )
    rows = df.select(latency_bucket(F.col("l")), cost_bucket(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [
        ("<1s", "<0.01"), ("1-3s", "0.01-0.10"), ("1-3s", ">0.10"), (">5s", None), (None, "<0.01"),
    ]
