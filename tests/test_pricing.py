import pytest
from pyspark.sql import functions as F

from spanmill.functions import pricing

SCHEMA = "provider string, model string, input_tokens int, output_tokens int, cost_usd double"


def cost(spark, build, *row):
    return build(spark.createDataFrame([row], SCHEMA)).first()["cost_usd"]


@pytest.mark.parametrize(
    "row, expected",
    [
        (("openai", "gpt-4o", 1000, 500, None), 0.0075),
        (("openai", "gpt-4o-mini", 2000, 1000, None), 0.0009),
        (("anthropic", "claude-3-5-sonnet", 500, 250, None), 0.00525),
        (("ollama", "llama3", 1000, 1000, None), 0.0),
        (("openai", "gpt-99-unknown", 1000, 1000, None), None),
        ((None, "gpt-4o", 1000, 1000, None), None),
        (("", "gpt-4o", 1000, 1000, 0.5), 0.5),
        (("custom", "my-model", 10, 10, 0.042), 0.042),
        (("anthropic", "claude-3-haiku-20240307", 1000, 1000, None), 0.0015),
        (("OpenAI", "GPT-4o-2099-01-01", 1000, 500, None), 0.0075),
        (("openai", "gpt-4o", None, 500, 0.1), 0.1),
        (("openai", "gpt-4o-2099-01-01\n", 1000, 500, None), None),
    ],
)
def test_compute_cost(spark, row, expected):
    got = cost(spark, pricing.compute_cost, *row)
    assert got == (None if expected is None else pytest.approx(expected, abs=1e-9))


@pytest.mark.parametrize(
    "build, model, tokens, expected",
    [
        (pricing.cost_sdk_openai, "gpt-4o", (1000, 500), 0.0125),
        (pricing.cost_sdk_openai, "gpt-4o-2099-01-01", (1000, 500), 0.0125),
        (pricing.cost_sdk_openai, "text-embedding-3-small", (1000, 0), 0.00002),
        (pricing.cost_sdk_openai, "GPT-4o", (1000, 500), None),
        (pricing.cost_proxy_openai, "gpt-4o", (1000, 1000), 0.02),
        (pricing.cost_proxy_openai, "gpt-4o-2024-05-13", (1000, 1000), None),
        (pricing.cost_proxy_anthropic, "claude-3-5-sonnet-20241022", (10**6, 10**6), 18.0),
        (pricing.cost_proxy_anthropic, "claude-3-5-sonnet-99991231", (10**6, 0), 3.0),
        (pricing.cost_proxy_anthropic, "gpt-4o", (10**6, 0), None),
        (pricing.cost_sdk_anthropic_ts, "eu.CLAUDE-2.1", (10**6, 10**6), 32.0),
        (pricing.cost_sdk_anthropic_ts, "no-such-model", (10**6, 10**6), 18.0),
        (pricing.cost_sdk_anthropic_py, "claude-3-opus-99991231", (1000, 1000), 0.09),
        (pricing.cost_sdk_anthropic_py, "claude-3-opus-9999", (1000, 1000), None),
    ],
)
def test_client_and_proxy_costs(spark, build, model, tokens, expected):
    got = cost(spark, build, None, model, *tokens, None)
    assert got == (None if expected is None else pytest.approx(expected, abs=1e-9))


def test_price_joins_do_not_shuffle(spark):
    rows = spark.createDataFrame([("openai", "gpt-4o", 1, 1, None)], SCHEMA)
    plan = pricing.compute_cost(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_drift_lists_only_differences(spark):
    rows = spark.createDataFrame(
        [("openai", "gpt-4o", 1000, 1000, 0.02), ("openai", "gpt-4o", 1000, 1000, 0.0125)], SCHEMA
    )
    drift = pricing.pricing_drift(rows).select(F.round("drift_usd", 6)).collect()
    assert [r[0] for r in drift] == [0.0075]
