"""Running cost of a stream of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from routewright.operators.cost import total_cost
from routewright.session import scratch_path


def running_cost(calls: DataFrame, path: str) -> StreamingQuery:
    """Start a query that keeps the total per model up to date as calls arrive.

    The state is one row per model. Each batch writes all totals to
    ``path/batch=N``; a batch that runs again replaces its own folder, and the
    largest N is the current state.
    """

    def save(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        total_cost(calls)
        .writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", scratch_path(calls.sparkSession, "running-cost"))
        .start()
    )
