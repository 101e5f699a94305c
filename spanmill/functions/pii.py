"""Redaction of personal data and secrets with ordered regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.text import JS_SPACE

# The rules come from JavaScript, where \b and \w are ASCII and \s is Unicode.
# Java 17 has it the other way round, so both are spelled out here.
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_BEFORE_WORD = r"(?<!\w)"
_AFTER_WORD = r"(?!\w)"

# --- Fixed values: rule name and pattern, applied in this order ---
RULES = (
    ("EMAIL", rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_AFTER_WORD}"),
    (
        "PHONE",
        rf"(?:\+?1[{JS_SPACE}.-]?)?\(?\d{{3}}\)?[{JS_SPACE}.-]?\d{{3}}[{JS_SPACE}.-]?\d{{4}}{_AFTER_WORD}",
    ),
    ("SSN", rf"{_BEFORE_WORD}(?!000|666|9\d{{2}})\d{{3}}[- ]?\d{{2}}[- ]?\d{{4}}{_AFTER_WORD}"),
    ("CREDIT_CARD", rf"{_BEFORE_WORD}(?:\d[ -]?){{13,19}}{_EDGE}"),
    (
        "API_KEY",
        rf"(?i){_BEFORE_WORD}(?:sk|pk|key|api_key|token|secret)[_-]?[A-Za-z0-9]{{20,}}{_AFTER_WORD}",
    ),
    ("BEARER", rf"(?i){_BEFORE_WORD}Bearer[{JS_SPACE}]+[A-Za-z0-9\-._~+/]+=*{_EDGE}"),
)
# --- Fixed values: the client-side label of the last rule ---
CLIENT_LABELS = {"BEARER": "BEARER_TOKEN"}


def _possible(rule: str, text: Column) -> Column:
    """Cheap necessary condition, so clean text skips the expensive pattern."""
    if rule == "EMAIL":
        return text.contains("@")
    if rule in ("PHONE", "SSN", "CREDIT_CARD"):
        return text.rlike(r"\d[ -]?\d[ -]?\d")
    if rule == "API_KEY":
        return text.rlike(r"(?i)(?:sk|pk|key|token|secret)[_-]?[A-Za-z0-9]{20}")
    return text.rlike("(?i)bearer")


def scrub_pii(
    df: DataFrame,
    columns: tuple[str, ...] = ("input", "output"),
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Replace every hit in ``columns`` with ``[REDACTED-<LABEL>]``; null stays null."""
    for rule, pattern in RULES:
        label = (labels or {}).get(rule, rule)
        df = df.withColumns(
            {
                name: F.when(
                    _possible(rule, F.col(name)),
                    F.regexp_replace(name, pattern, f"[REDACTED-{label}]"),
                ).otherwise(F.col(name))
                for name in columns
            }
        )
    return df


def scrub_pii_sdk(
    df: DataFrame, enabled: bool = True, columns: tuple[str, ...] = ("input", "output")
) -> DataFrame:
    """Client-side form: same rules, its own label for bearer tokens, can be switched off."""
    return scrub_pii(df, columns, CLIENT_LABELS) if enabled else df


def pii_hits(df: DataFrame, column: str) -> DataFrame:
    """Add ``hits_<rule>`` counts; each rule sees the text left by the rules before it."""
    out = df.withColumn("_text", F.col(column))
    for rule, pattern in RULES:
        possible = _possible(rule, F.col("_text"))
        out = out.withColumn(
            f"hits_{rule.lower()}",
            F.when(possible, F.regexp_count("_text", F.lit(pattern))).otherwise(0),
        ).withColumn(
            "_text",
            F.when(
                F.col(f"hits_{rule.lower()}") > 0,
                F.regexp_replace("_text", pattern, f"[REDACTED-{rule}]"),
            ).otherwise(F.col("_text")),
        )
    return out.drop("_text")


def pii_report(df: DataFrame, column: str = "input", by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Rows and hits per rule for each group."""
    rules = [rule for rule, _ in RULES]
    counts = pii_hits(df.select(*by, column), column).groupBy(*by)
    sums = counts.agg(
        *[F.sum(f"hits_{r.lower()}").alias(r) for r in rules],
        *[F.count_if(F.col(f"hits_{r.lower()}") > 0).alias(f"rows_{r}") for r in rules],
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.col(r).alias("hits"), F.col(f"rows_{r}").alias("rows"))
                for r in rules
            ]
        )
    )
    return sums.select(*by, pairs.alias("_r")).select(*by, "_r.rule", "_r.hits", "_r.rows")
