"""Message templates against a brute-force comparison of all messages."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from spanmill.operators import errors


def brute(messages):
    """{message: pattern} by looking at every pair of places of every message."""
    words = {m: m.split(" ") for m in set(messages)}
    named = lambda w: re.search(r"[0-9/\\@_=<]|[A-Za-z0-9][.:-][A-Za-z0-9]", w) is not None
    out = {}
    for m, own in words.items():
        mask, places = set(), [(i,) for i in range(len(own))]
        if len(own) <= errors.PAIR_WORDS:
            places += combinations(range(len(own)), 2)
        for at in places:
            rest = [w for k, w in enumerate(own) if k not in at]
            same = [o for o in words.values() if len(o) == len(own) and [w for k, w in enumerate(o) if k not in at] == rest]
            values = [{o[k] for o in same} for k in at]
            if (len(at) == 1 and len(same) >= errors.PLAIN_VALUES) or all(len(v) > 1 and all(map(named, v)) for v in values):
                mask |= set(at)
        out[m] = " ".join("<*>" if k in mask else w for k, w in enumerate(own))
    return out


def found(spark, messages):
    df = spark.createDataFrame([("p", m) for m in messages], "project_id string, message string")
    return {r.message: r.pattern for r in errors.message_templates(df, ["project_id"]).collect()}


def test_random_messages(spark):
    rng, messages = random.Random(2), []
    for _ in range(260):
        kind = rng.randrange(4)
        file, host = f"/tmp/{rng.choice('abcdefgh')}.log", f"db-{rng.choice('xyz')}.local"
        messages.append(
            [
                f"cannot open {file} for reading", f"upload of {file} to {host} failed",
                f"{rng.choice(['user', 'file', 'host', 'key', 'row', 'job'])} not found",
                " ".join(rng.choices(["connection", "refused", "reset", "by", "peer", "db-x.local"], k=rng.randint(1, 4))),
            ][kind]
        )
    messages += ["", " ", "same", "a " * 40 + "/x", "a " * 40 + "/y"]
    assert found(spark, messages) == brute(messages)


def test_what_meets(spark):
    got = found(spark, ["open /a/b.txt failed", "open /a/c.txt failed", "connection refused", "connection reset", "x to h1.local", "y to h2.local"])
    assert set(got.values()) == {"open <*> failed", "connection refused", "connection reset", "x to h1.local", "y to h2.local"}
    assert found(spark, ["alone"]) == {"alone": "alone"} and found(spark, []) == {}


def test_hot_template(spark):
    rows = spark.range(20_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("lost /f/"), "id", F.lit(" on host")).alias("message"))
    got = errors.message_templates(rows, ["project_id"])
    assert [tuple(r) for r in got.groupBy("pattern").count().collect()] == [("lost <*> on host", 20_000)]
