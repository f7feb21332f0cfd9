"""Cost and request accounting of model calls.

calls(call_id, model, prompt_tokens, completion_tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 9

# USD per million tokens (prompt, completion).
PRICE_PER_MILLION: dict[str, tuple[float, float]] = {
    "gpt-3.5-turbo": (0.5, 1.5),
    "gpt-3.5-turbo-0125": (0.5, 1.5),
    "gpt-3.5-turbo-instruct": (1.5, 2.0),
    "gpt-4o": (5.0, 15.0),
    "gpt-4o-2024-05-13": (5.0, 15.0),
    "gpt-4-turbo": (10.0, 30.0),
    "gpt-4-turbo-2024-04-09": (10.0, 30.0),
    "gpt-4": (30.0, 60.0),
    "gpt-3.5-turbo-0301": (1.5, 2.0),
    "gpt-3.5-turbo-0613": (1.5, 2.0),
    "gpt-3.5-turbo-16k-0613": (3.0, 4.0),
    "gpt-3.5-turbo-1106": (1.0, 2.0),
}

# Older list, USD per thousand tokens; the gpt-4 family prices
# completions in rows of their own.
PRICE_PER_THOUSAND: dict[str, float] = {
    "gpt-4": 0.03,
    "gpt-4-completion": 0.06,
    "gpt-4-0314-completion": 0.06,
    "gpt-4-32k": 0.06,
    "gpt-4-32k-completion": 0.12,
    "gpt-4-32k-0314-completion": 0.12,
    "gpt-3.5-turbo-16k": 0.004,
    "gpt-3.5-turbo": 0.002,
    "gpt-3.5-turbo-instruct": 0.002,
    "text-ada-001": 0.0004,
    "ada": 0.0004,
    "text-babbage-001": 0.0005,
    "babbage": 0.0005,
    "text-curie-001": 0.002,
    "curie": 0.002,
    "text-davinci-003": 0.02,
    "text-davinci-002": 0.02,
    "code-davinci-002": 0.02,
}


def _lookup(table: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.create_map(*pairs)[key]


def _known(price: Column, model: Column) -> Column:
    return F.coalesce(
        price,
        F.raise_error(F.concat(F.lit("Unknown model name: "), model)).cast("double"),
    )


def call_cost(calls: DataFrame) -> DataFrame:
    """calls with ``cost`` in USD; an unknown model is an error."""
    model = F.col("model")
    prompt = _known(_lookup({m: p for m, (p, _) in PRICE_PER_MILLION.items()}, model), model)
    completion = _known(_lookup({m: c for m, (_, c) in PRICE_PER_MILLION.items()}, model), model)
    cost = (prompt * F.col("prompt_tokens") + completion * F.col("completion_tokens")) / 1e6
    return calls.withColumn("cost", F.round(cost, DIGITS))


def unknown_models(calls: DataFrame) -> DataFrame:
    """Calls whose model has no price."""
    return calls.where(~F.col("model").isin(*PRICE_PER_MILLION))


def total_cost(calls: DataFrame) -> DataFrame:
    """(model, calls, cost): per model and, with a null model, in total."""
    return (
        call_cost(calls)
        .rollup("model")
        .agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), DIGITS).alias("cost"))
    )


def usage_cost(calls: DataFrame) -> DataFrame:
    """calls with ``cost`` by the older price list; an unknown model is an error."""
    model = F.lower("model")
    suffix = F.when(F.col("model").startswith("gpt-4"), "-completion").otherwise("")
    prompt = _known(_lookup(PRICE_PER_THOUSAND, model), F.col("model"))
    completion = _known(_lookup(PRICE_PER_THOUSAND, F.concat(model, suffix)), F.col("model"))
    cost = (
        completion * F.col("completion_tokens") / 1000 + prompt * F.col("prompt_tokens") / 1000
    )
    return calls.withColumn("cost", F.round(cost, DIGITS))


def pending_requests(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """(request, n, first_id): distinct requests(req_id, request) not answered yet."""
    distinct = requests.groupBy("request").agg(
        F.count(F.lit(1)).alias("n"), F.min("req_id").alias("first_id")
    )
    return distinct.join(answered.select("request").distinct(), "request", "left_anti")
