"""Cost queries over conversations, request queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import cost as k
from routewright.plans import tables as t


def call_cost(spark, d):
    return k.call_cost(t.calls(spark, d))


def unknown_models(spark, d):
    """Calls under a model name that the list does not have for long prompts."""
    calls = t.calls(spark, d).withColumn(
        "model", F.when(F.col("prompt_tokens") > 100, F.concat("model", F.lit("-x"))).otherwise(F.col("model"))
    )
    return k.unknown_models(calls)


def total_cost(spark, d):
    return k.total_cost(t.calls(spark, d))


def usage_cost_per_1k(spark, d):
    return k.usage_cost(t.calls(spark, d))


def pending_requests(spark, d):
    """Document texts are requests; the labelled ones are answered."""
    requests = t.load(spark, d, "documents").select(
        F.col("doc_id").alias("req_id"), F.md5("text").alias("request")
    )
    answered = requests.join(
        t.load(spark, d, "labels").select(F.col("doc_id").alias("req_id")), "req_id", "left_semi"
    )
    return k.pending_requests(requests, answered)


QUERIES = {
    f.__name__: f for f in (call_cost, unknown_models, total_cost, usage_cost_per_1k, pending_requests)
}

_CALLS = f"""WITH c AS (SELECT conv_id, role, len({t.words('text')}) AS n FROM conversations),
calls AS (SELECT conv_id AS call_id,
  CASE WHEN bool_or(role = 'system') THEN 'gpt-4' WHEN count(*) > 4 THEN 'gpt-3.5-turbo-instruct'
    ELSE 'gpt-3.5-turbo' END AS model,
  coalesce(sum(n) FILTER (role <> 'assistant'), 0)::BIGINT AS prompt_tokens,
  coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS completion_tokens FROM c GROUP BY conv_id),
price(model, p, c) AS (VALUES ('gpt-4', 30::DOUBLE, 60::DOUBLE), ('gpt-3.5-turbo-instruct', 1.5, 2.0),
  ('gpt-3.5-turbo', 0.5, 1.5)),
costs AS (SELECT calls.*, round((p * prompt_tokens + c * completion_tokens) / 1e6::DOUBLE, 9) AS cost
  FROM calls JOIN price USING (model))"""

ORACLE = {
    "call_cost": f"{_CALLS} SELECT * FROM costs",
    "unknown_models": f"""{_CALLS}
SELECT call_id, model || '-x' AS model, prompt_tokens, completion_tokens FROM calls WHERE prompt_tokens > 100""",
    "total_cost": f"""{_CALLS}
SELECT model, count(*) AS calls, round(sum(cost), 9) AS cost FROM costs GROUP BY ROLLUP (model)""",
    "usage_cost_per_1k": f"""{_CALLS}
SELECT calls.*, round(CASE WHEN model = 'gpt-4' THEN 0.06::DOUBLE ELSE 0.002 END * completion_tokens / 1000
  + CASE WHEN model = 'gpt-4' THEN 0.03::DOUBLE ELSE 0.002 END * prompt_tokens / 1000, 9) AS cost FROM calls""",
    "pending_requests": """WITH r AS (SELECT doc_id AS req_id, md5(text) AS request FROM documents)
SELECT request, count(*) AS n, min(req_id) AS first_id FROM r
WHERE request NOT IN (SELECT request FROM r JOIN labels ON doc_id = req_id) GROUP BY request""",
}
