"""Model prices and the ways a model name is matched to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: USD per 1 000 tokens (input, output), central price list ---
INGEST_PRICES = {
    "openai": {
        "gpt-4o": (0.0025, 0.01),
        "gpt-4o-2024-05-13": (0.005, 0.015),
        "gpt-4o-2024-08-06": (0.0025, 0.01),
        "gpt-4o-mini": (0.00015, 0.0006),
        "gpt-4o-mini-2024-07-18": (0.00015, 0.0006),
        "gpt-4.1": (0.002, 0.008),
        "gpt-4.1-mini": (0.0004, 0.0016),
        "gpt-4.1-nano": (0.0001, 0.0004),
        "o1": (0.015, 0.06),
        "o1-mini": (0.003, 0.012),
        "o1-preview": (0.015, 0.06),
        "o3": (0.01, 0.04),
        "o3-mini": (0.0011, 0.0044),
        "o4-mini": (0.0011, 0.0044),
        "gpt-4-turbo": (0.01, 0.03),
        "gpt-4-turbo-2024-04-09": (0.01, 0.03),
        "gpt-4-turbo-preview": (0.01, 0.03),
        "gpt-4": (0.03, 0.06),
        "gpt-4-32k": (0.06, 0.12),
        "gpt-3.5-turbo": (0.0005, 0.0015),
        "gpt-3.5-turbo-0125": (0.0005, 0.0015),
        "gpt-3.5-turbo-instruct": (0.0015, 0.002),
    },
    "anthropic": {
        "claude-opus-4-6": (0.015, 0.075),
        "claude-sonnet-4-6": (0.003, 0.015),
        "claude-3-5-sonnet-20241022": (0.003, 0.015),
        "claude-3-5-sonnet-20240620": (0.003, 0.015),
        "claude-3-5-sonnet": (0.003, 0.015),
        "claude-3-5-haiku": (0.0008, 0.004),
        "claude-3-opus-20240229": (0.015, 0.075),
        "claude-3-opus": (0.015, 0.075),
        "claude-3-sonnet-20240229": (0.003, 0.015),
        "claude-3-haiku-20240307": (0.00025, 0.00125),
        "claude-3-haiku": (0.00025, 0.00125),
    },
    "google": {
        "gemini-2.5-pro": (0.00125, 0.01),
        "gemini-2.5-flash": (0.00015, 0.0006),
        "gemini-2.0-flash": (0.0001, 0.0004),
        "gemini-1.5-pro": (0.00125, 0.005),
        "gemini-1.5-flash": (0.000075, 0.0003),
        "gemini-1.0-pro": (0.0005, 0.0015),
    },
    "mistral": {
        "mistral-large-latest": (0.002, 0.006),
        "mistral-large": (0.002, 0.006),
        "mistral-medium-latest": (0.0027, 0.0081),
        "mistral-small-latest": (0.0002, 0.0006),
        "mistral-small": (0.0002, 0.0006),
        "codestral": (0.0003, 0.0009),
        "open-mixtral-8x22b": (0.002, 0.006),
        "open-mixtral-8x7b": (0.0007, 0.0007),
        "open-mistral-7b": (0.00025, 0.00025),
    },
    "cohere": {
        "command-r-plus": (0.0025, 0.01),
        "command-r": (0.00015, 0.0006),
        "command": (0.001, 0.002),
        "command-light": (0.0003, 0.0006),
    },
    "deepseek": {
        "deepseek-chat": (0.00014, 0.00028),
        "deepseek-reasoner": (0.00055, 0.00219),
        "deepseek-coder": (0.00014, 0.00028),
    },
    "ollama": {"*": (0.0, 0.0)},
    "local": {"*": (0.0, 0.0)},
}

# --- Fixed values: USD per 1 000 tokens, proxy list for OpenAI calls ---
PROXY_OPENAI_PRICES = {
    "gpt-4o": (0.005, 0.015),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4": (0.03, 0.06),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "o1": (0.015, 0.06),
    "o1-mini": (0.003, 0.012),
    "o3": (0.01, 0.04),
    "o3-mini": (0.0011, 0.0044),
    "o4-mini": (0.0011, 0.0044),
}

# --- Fixed values: USD per 1 000 000 tokens, proxy list for Anthropic calls; order matters ---
PROXY_ANTHROPIC_PRICES = {
    "claude-3-5-sonnet": (3.0, 15.0),
    "claude-3-5-haiku": (0.8, 4.0),
    "claude-3-opus": (15.0, 75.0),
    "claude-3-sonnet": (3.0, 15.0),
    "claude-3-haiku": (0.25, 1.25),
    "claude-4-sonnet": (3.0, 15.0),
    "claude-4-opus": (15.0, 75.0),
}

# --- Fixed values: USD per 1 000 tokens, client list for OpenAI calls ---
CLIENT_OPENAI_PRICES = {
    "gpt-4o": (0.005, 0.015),
    "gpt-4o-2024-05-13": (0.005, 0.015),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o-mini-2024-07-18": (0.00015, 0.0006),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4-turbo-2024-04-09": (0.01, 0.03),
    "gpt-4-turbo-preview": (0.01, 0.03),
    "gpt-4": (0.03, 0.06),
    "gpt-4-0613": (0.03, 0.06),
    "gpt-4-32k": (0.06, 0.12),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "gpt-3.5-turbo-0125": (0.0005, 0.0015),
    "gpt-3.5-turbo-instruct": (0.0015, 0.002),
    "text-embedding-3-small": (0.00002, 0.0),
    "text-embedding-3-large": (0.00013, 0.0),
    "text-embedding-ada-002": (0.0001, 0.0),
}

# --- Fixed values: USD per 1 000 000 tokens, client list for Anthropic calls; order matters ---
CLIENT_ANTHROPIC_PRICES_CONTAINED = {
    "claude-3-5-sonnet": (3.0, 15.0),
    "claude-3-5-haiku": (0.8, 4.0),
    "claude-3-opus": (15.0, 75.0),
    "claude-3-sonnet": (3.0, 15.0),
    "claude-3-haiku": (0.25, 1.25),
    "claude-2": (8.0, 24.0),
}
CLIENT_ANTHROPIC_FALLBACK = (3.0, 15.0)

# --- Fixed values: USD per 1 000 tokens, second client list for Anthropic calls ---
CLIENT_ANTHROPIC_PRICES_EXACT = {
    "claude-3-5-sonnet-20240620": (0.003, 0.015),
    "claude-3-5-sonnet": (0.003, 0.015),
    "claude-3-opus-20240229": (0.015, 0.075),
    "claude-3-opus": (0.015, 0.075),
    "claude-3-sonnet-20240229": (0.003, 0.015),
    "claude-3-sonnet": (0.003, 0.015),
    "claude-3-haiku-20240307": (0.00025, 0.00125),
    "claude-3-haiku": (0.00025, 0.00125),
}

DASHED_DATE_SUFFIX = r"-\d{4}-\d{2}-\d{2}\z"
COMPACT_DATE_SUFFIX = r"-\d{8}\z"


def _price_rows(spark: SparkSession, rows: list[tuple[str, str, float, float]]) -> DataFrame:
    """Price list as a constant relation, so Catalyst knows its (fixed) size."""
    values = ", ".join(f"('{p}', '{m}', {i!r}D, {o!r}D)" for p, m, i, o in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(_provider, _model, _in, _out)")


def _lookup(df: DataFrame, prices: DataFrame, provider: Column, model: Column, tag: str) -> DataFrame:
    prices = prices.select(
        F.col("_provider").alias(f"_{tag}_provider"),
        F.col("_model").alias(f"_{tag}_model"),
        F.struct(F.col("_in").alias("input"), F.col("_out").alias("output")).alias(f"_{tag}"),
    )
    # The hint is safe: the list is a constant of this module with under 70 rows.
    return df.join(
        F.broadcast(prices),
        (provider == F.col(f"_{tag}_provider")) & (model == F.col(f"_{tag}_model")),
        "left",
    ).drop(f"_{tag}_provider", f"_{tag}_model")


def price_lookup(df: DataFrame) -> DataFrame:
    """Add ``price_in`` and ``price_out`` (per 1 000 tokens) for provider and model.

    Lower-cased names are matched exactly, then without a ``-YYYY-MM-DD`` suffix,
    then by the provider's wildcard. Null means the model is not priced.
    """
    rows = [
        (provider, model, *price)
        for provider, models in INGEST_PRICES.items()
        for model, price in models.items()
        if model != "*"
    ]
    listed = _price_rows(df.sparkSession, rows)
    free = F.lit(None).cast("struct<input:double,output:double>")
    for provider, models in INGEST_PRICES.items():
        if "*" in models:
            price_in, price_out = models["*"]
            free = F.when(
                F.lower("provider") == provider,
                F.struct(F.lit(price_in).alias("input"), F.lit(price_out).alias("output")),
            ).otherwise(free)
    # Empty strings count as "not given".
    provider = F.lower(F.nullif(F.col("provider"), F.lit("")))
    model = F.lower(F.nullif(F.col("model"), F.lit("")))
    stripped = F.regexp_replace(model, DASHED_DATE_SUFFIX, "")
    out = _lookup(df, listed, provider, model, "exact")
    out = _lookup(out, listed, provider, stripped, "base")
    price = F.coalesce("_exact", "_base", F.when(model.isNotNull(), free))
    return out.select(
        *df.columns, price["input"].alias("price_in"), price["output"].alias("price_out")
    )


def _per_1k(price_in: Column, price_out: Column) -> Column:
    return F.col("input_tokens") / 1000 * price_in + F.col("output_tokens") / 1000 * price_out


def compute_cost(df: DataFrame, reported: str = "cost_usd", out: str = "cost_usd") -> DataFrame:
    """Cost from the central price list; the reported cost where it has no answer."""
    return (
        price_lookup(df)
        .withColumn(out, F.coalesce(_per_1k(F.col("price_in"), F.col("price_out")), F.col(reported)))
        .drop("price_in", "price_out")
    )


def _single_list_cost(df: DataFrame, prices: dict, suffix: str | None, out: str) -> DataFrame:
    rows = _price_rows(df.sparkSession, [("", m, *price) for m, price in prices.items()])
    priced = _lookup(df, rows, F.lit(""), F.col("model"), "exact")
    price = F.col("_exact")
    if suffix is not None:
        stripped = F.regexp_replace("model", suffix, "")
        priced = _lookup(priced, rows, F.lit(""), stripped, "base")
        price = F.coalesce("_exact", "_base")
    return priced.withColumn(out, _per_1k(price["input"], price["output"])).drop("_exact", "_base")


def _first_listed(prices: dict, matches) -> Column:
    """Price of the first listed key for which ``matches(key)`` holds."""
    picked = None
    for key, (price_in, price_out) in prices.items():
        price = F.struct(F.lit(price_in).alias("input"), F.lit(price_out).alias("output"))
        picked = F.when(matches(key), price) if picked is None else picked.when(matches(key), price)
    return picked


def _per_million(price: Column) -> Column:
    return (
        F.col("input_tokens") * price["input"] + F.col("output_tokens") * price["output"]
    ) / 1000000


def cost_proxy_openai(df: DataFrame, out: str = "cost_usd") -> DataFrame:
    """Exact, case-sensitive match against the proxy's list."""
    return _single_list_cost(df, PROXY_OPENAI_PRICES, None, out)


def cost_proxy_anthropic(df: DataFrame, out: str = "cost_usd") -> DataFrame:
    """Exact match, else the first listed key that the model name starts with."""
    price = F.coalesce(
        _first_listed(PROXY_ANTHROPIC_PRICES, lambda key: F.col("model") == key),
        _first_listed(PROXY_ANTHROPIC_PRICES, lambda key: F.col("model").startswith(key)),
    )
    return df.withColumn(out, _per_million(price))


def cost_sdk_openai(df: DataFrame, out: str = "cost_usd") -> DataFrame:
    """Exact match, else without the ``-YYYY-MM-DD`` suffix; covers embedding models."""
    return _single_list_cost(df, CLIENT_OPENAI_PRICES, DASHED_DATE_SUFFIX, out)


def cost_sdk_anthropic_ts(df: DataFrame, out: str = "cost_usd") -> DataFrame:
    """First listed key contained in the lower-cased name; unknown models get 3 / 15."""
    fallback_in, fallback_out = CLIENT_ANTHROPIC_FALLBACK
    price = F.coalesce(
        _first_listed(
            CLIENT_ANTHROPIC_PRICES_CONTAINED, lambda key: F.lower("model").contains(key)
        ),
        F.struct(F.lit(fallback_in).alias("input"), F.lit(fallback_out).alias("output")),
    )
    return df.withColumn(out, _per_million(price))


def cost_sdk_anthropic_py(df: DataFrame, out: str = "cost_usd") -> DataFrame:
    """Exact match, else without a ``-YYYYMMDD`` suffix."""
    return _single_list_cost(df, CLIENT_ANTHROPIC_PRICES_EXACT, COMPACT_DATE_SUFFIX, out)


def pricing_drift(df: DataFrame, reported: str = "cost_usd", tolerance: float = 1e-9) -> DataFrame:
    """Spans whose reported cost differs from the one recomputed from the central list."""
    return (
        price_lookup(df)
        .withColumn("recomputed_cost_usd", _per_1k(F.col("price_in"), F.col("price_out")))
        .drop("price_in", "price_out")
        .withColumn("drift_usd", F.col(reported) - F.col("recomputed_cost_usd"))
        .filter(F.abs("drift_usd") > tolerance)
    )
