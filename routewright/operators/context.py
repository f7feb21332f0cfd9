"""Which schemas a question's prompt shows.

Contexts are flat: (qid, schema_pos, db, tbl_pos, tbl, col_pos, col). Only
``nest_context`` gathers them, per prompt. gold(qid, db) names a question's own
database, mentions(qid, db, tbl, col) its own tables and columns.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright.functions.draws import draw_below
from routewright.functions.positions import let, number_rows

_FLAT = ["qid", "schema_pos", "db", "tbl_pos", "tbl", "col_pos", "col"]


def _show(chosen: DataFrame, columns: DataFrame) -> DataFrame:
    cols = columns.select("db", "tbl_pos", "tbl", "col_pos", "col")
    return chosen.join(cols, "db").select(*_FLAT)


def context_database(gold: DataFrame, columns: DataFrame) -> DataFrame:
    """The whole gold database."""
    return _show(gold.select("qid", "db", F.lit(0).alias("schema_pos")), columns)


def context_table(gold: DataFrame, mentions: DataFrame, columns: DataFrame) -> DataFrame:
    """The gold tables with all their columns; a question without any keeps its database."""
    tables = mentions.select("qid", "db", "tbl").distinct()
    cols = columns.select("db", "tbl_pos", "tbl", "col_pos", "col")
    return (
        gold.select("qid", "db", F.lit(0).alias("schema_pos"))
        .join(tables, ["qid", "db"], "left")
        .join(cols, ["db", "tbl"], "left")
        .select(*_FLAT)
    )


def context_column(gold: DataFrame, mentions: DataFrame) -> DataFrame:
    """The gold tables with only their gold columns."""
    return (
        gold.select("qid", "db", F.lit(0).alias("schema_pos"))
        .join(mentions, ["qid", "db"], "left")
        .select(*_FLAT)
    )


def random_schemas(gold: DataFrame, columns: DataFrame, seed: str = "context") -> DataFrame:
    """(qid, schema_pos, db): two random databases, the gold one, two more random ones.

    Draws are with replacement and may repeat the gold database.
    """
    dbs = number_rows(columns.select("db").distinct(), [], "db", "db_no").select(
        F.col("db").alias("drawn"), "db_no"
    )
    n = columns.agg(F.countDistinct("db").alias("n")).scalar()
    draws = gold.select(
        "qid", F.explode(F.array(*[F.lit(i) for i in (0, 1, 3, 4)])).alias("schema_pos")
    ).withColumn("db_no", draw_below(n, F.lit(seed), "qid", "schema_pos"))
    drawn = draws.join(dbs, "db_no").select("qid", "schema_pos", F.col("drawn").alias("db"))
    return drawn.unionByName(gold.select("qid", F.lit(2).alias("schema_pos"), "db"))


def context_random(gold: DataFrame, columns: DataFrame, seed: str = "context") -> DataFrame:
    return _show(random_schemas(gold, columns, seed), columns)


def prediction_rows(pred: DataFrame) -> DataFrame:
    """(qid, schema_pos, db, tbl) of pred(qid, pred_schemas), each table once."""
    schemas = pred.select("qid", F.posexplode("pred_schemas").alias("schema_pos", "s"))
    return schemas.select(
        "qid",
        "schema_pos",
        F.col("s.database").alias("db"),
        F.explode_outer(F.array_distinct("s.tables")).alias("tbl"),
    )


def context_predicted(pred: DataFrame, columns: DataFrame, k: int) -> DataFrame:
    """The first k predicted schemas, with the tables their database really has.

    A predicted table the catalog does not have stays as a row without position,
    so that a schema without any known table is still shown, empty.
    """
    first = pred.withColumn("pred_schemas", F.slice("pred_schemas", 1, k))
    cols = columns.select("db", "tbl_pos", "tbl", "col_pos", "col")
    return prediction_rows(first).join(cols, ["db", "tbl"], "left").select(*_FLAT)


def gold_rank(pred_schemas: Column, gold_db: Column) -> Column:
    """First index of the gold database among the predictions, -1 if absent."""
    dbs = F.transform(pred_schemas, lambda s: s["database"])
    return (F.coalesce(F.array_position(dbs, gold_db), F.lit(0)) - 1).cast("int")


def context_gold_hit(pred: DataFrame, gold: DataFrame, columns: DataFrame) -> DataFrame:
    """Only the prediction for the gold database; questions that miss it have no context."""
    at = gold_rank(F.col("pred_schemas"), F.col("db"))
    hit = (
        pred.join(gold.select("qid", "db"), "qid")
        .withColumn("at", at)
        .where("at >= 0")
        .select("qid", F.slice("pred_schemas", F.greatest("at", F.lit(0)) + 1, F.lit(1)).alias("pred_schemas"))
    )
    return context_predicted(hit, columns, 1)


def _runs_of(rows: Column, fields: tuple[str, ...]) -> Column:
    """The rows of a sorted array, one array per run of equal fields; linear in the rows."""

    def begins(at: Column, xs: Column) -> Column:
        before = F.get(xs, at - 2)
        same = [F.get(xs, at - 1)[f].eqNullSafe(before[f]) for f in fields]
        return (at == 1) | ~reduce(and_, same)

    def cut(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda _, i: i + 1), lambda at: begins(at, xs))
        return let(
            starts,
            lambda s: F.transform(
                s, lambda at, j: F.slice(xs, at, F.coalesce(F.get(s, j + 1), F.size(xs) + 1) - at)
            ),
        )

    return let(rows, cut)


def nest_context(rows: DataFrame) -> DataFrame:
    """(qid, schemas) for the prompt renderers, in catalog order.

    The rows of a schema are gathered and sorted once, where the join with the
    catalog has brought them together; its tables are runs of them, cut inside
    the row. What moves to the question is a finished schema.
    """
    flat = F.struct("tbl_pos", "tbl", "col_pos", "col")
    gathered = rows.groupBy("db", "schema_pos", "qid").agg(F.sort_array(F.collect_list(flat)).alias("rows"))

    def table(xs: Column) -> Column:
        named = F.filter(xs, lambda x: x["col"].isNotNull())
        return F.struct(F.get(xs, F.lit(0))["tbl"].alias("name"), F.transform(named, lambda x: x["col"]).alias("columns"))

    known = F.filter("rows", lambda x: x["tbl_pos"].isNotNull())
    tables = F.transform(_runs_of(known, ("tbl_pos", "tbl")), table)
    schema = F.struct("schema_pos", F.col("db").alias("name"), tables.alias("tables"))
    return gathered.select("qid", schema.alias("schema")).groupBy("qid").agg(
        F.transform(
            F.sort_array(F.collect_list("schema")), lambda s: s.dropFields("schema_pos")
        ).alias("schemas")
    )
