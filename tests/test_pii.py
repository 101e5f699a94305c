import re

import pytest
from pyspark.sql import functions as F

from spanmill.functions import pii

GOLDEN = {
    "Contact us at user@example.com": "Contact us at [REDACTED-EMAIL]",
    "Call 555-123-4567 now": "Call [REDACTED-PHONE] now",
    "SSN: 123-45-6789": "SSN: [REDACTED-SSN]",
    "4111111111111111": "41111[REDACTED-PHONE]",
    "4111 1111 1111 1111": "[REDACTED-CREDIT_CARD]",
    "Authorization: Bearer abc.def-ghi": "Authorization: [REDACTED-BEARER]",
    "key_abcdefghijklmnopqrstuvwx": "[REDACTED-API_KEY]",
    "sk-proj-abc": "sk-proj-abc",
    "é123-45-6789": "é[REDACTED-SSN]",
    "000-12-3456": "000-12-3456",
    "666-12-3456": "666-12-3456",
    "900-12-3456": "900-12-3456",
    "555 123 4567": "[REDACTED-PHONE]",
    "nothing to see": "nothing to see",
    "": "",
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, k, "error 555-123-4567") for k in GOLDEN] + [(None, None, None)]
    return spark.createDataFrame(rows, "input string, output string, error_message string")


def test_golden(texts):
    keyed = texts.withColumn("key", F.col("input"))
    for row in pii.scrub_pii(keyed).collect():
        assert row["input"] == row["output"] == GOLDEN.get(row["key"])
        assert row["error_message"] in ("error 555-123-4567", None)


def test_client_label_and_switch(spark):
    rows = spark.createDataFrame([("Bearer abcdef", None)], "input string, output string")
    assert pii.scrub_pii_sdk(rows).first()["input"] == "[REDACTED-BEARER_TOKEN]"
    assert pii.scrub_pii_sdk(rows, enabled=False).first()["input"] == "Bearer abcdef"


def test_short_cuts_never_hide_a_hit(spark):
    """The cheap conditions are necessary for the patterns: same result without them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.col("text").alias("input"), F.lit(None).cast("string").alias("output")
    )
    plain = F.col("input")
    for rule, pattern in pii.RULES:
        plain = F.regexp_replace(plain, pattern, f"[REDACTED-{rule}]")
    both = pii.scrub_pii(docs.withColumn("plain", plain))
    assert both.filter(F.col("plain") != F.col("input")).count() == 0


def test_report_counts_after_earlier_rules(spark):
    rows = spark.createDataFrame([("p", "4111111111111111 a@b.co c@d.co")], "project_id string, input string")
    report = {r["rule"]: (r["hits"], r["rows"]) for r in pii.pii_report(rows).collect()}
    assert report["EMAIL"] == (2, 1) and report["PHONE"] == (1, 1)
    assert report["CREDIT_CARD"] == (0, 0)


def test_rules_are_in_order():
    assert [r for r, _ in pii.RULES] == ["EMAIL", "PHONE", "SSN", "CREDIT_CARD", "API_KEY", "BEARER"]
    assert all(not re.search(r"\\b", p) for _, p in pii.RULES)
