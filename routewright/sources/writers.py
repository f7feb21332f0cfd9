"""Writers: records, gold SQL lines, predictions by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_instances(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One record per line (``json``) or columnar (``parquet``)."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_json_arrays(df: DataFrame, path: str, chunk: Column) -> None:
    """One JSON-array file per chunk; the caller keeps chunks of bounded size."""
    names = df.columns
    arrays = (
        df.groupBy(chunk.alias("chunk"))
        .agg(F.collect_list(F.struct(*names)).alias("records"))
        .select("chunk", F.to_json("records").alias("value"))
    )
    arrays.repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)


def gold_lines(df: DataFrame, sql: str = "sql", db: str = "db") -> DataFrame:
    """``sql <tab> db`` per record."""
    return df.select(F.concat_ws("\t", F.col(sql), F.col(db)).alias("value"))


def write_gold_tsv(df: DataFrame, path: str) -> None:
    gold_lines(df).write.mode("overwrite").text(path)


def write_predictions_by_split(df: DataFrame, path: str) -> None:
    """One folder of predictions per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def scored_sql_lines(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted SQL with its gold database, joined by question.

    predicted(qid, sql), gold(qid, db). The predicted line keeps its newline in
    front of the separator, as the scorer's input file has it.
    """
    return predicted.join(gold, "qid").select(
        "qid",
        F.concat(
            F.col("sql"), F.lit("\n\t----- bird -----\t"), F.col("db")
        ).alias("line"),
    )
