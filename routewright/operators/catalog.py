"""Catalog building: raw schema dumps to one row per (db, table, column).

The flat form is
``columns(db, tbl_pos, tbl, tbl_norm, col_pos, col, col_norm, type, is_pk, fk_tbl, fk_col)``.
Key lookups are equi-joins on (db, column index), so a database that holds a
large share of all columns is still spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.functions.positions import let
from routewright.functions.text import normalise_name, strip
from routewright.session import cut_lineage

# Columns times key entries of a dump row that looks its keys up by itself.
ROW_LOOKUPS = 1 << 16


def lower_dump(raw: DataFrame) -> DataFrame:
    """Lower-case the original table and column names of a dump."""
    return raw.withColumn(
        "table_names_original", F.transform("table_names_original", F.lower)
    ).withColumn(
        "column_names_original",
        F.transform(
            "column_names_original",
            lambda c: F.array(F.get(c, F.lit(0)), F.lower(F.get(c, F.lit(1)))),
        ),
    )


def aligned_type(types: Column, index: Column, type_offset: int) -> Column:
    """Type of the column at ``index``; dumps that omit ``*`` have offset 1."""
    return F.get(types, index - F.lit(type_offset))


def _column_structs(type_offset: int) -> Column:
    """The real columns of a dump row, with all names looked up inside the row."""
    item = F.transform(
        "column_names_original",
        lambda c, i: F.struct(
            i.cast("bigint").alias("col_pos"),
            F.get(c, F.lit(0)).cast("int").alias("t"),
            F.lower(F.get(c, F.lit(1))).alias("col"),
            F.get(F.get(F.col("column_names"), i), F.lit(1)).alias("col_norm"),
            aligned_type(F.col("column_types"), i, type_offset).alias("type"),
        ),
    )
    return F.transform(
        F.filter(item, lambda x: x["t"] >= 0),
        lambda x: F.struct(
            x["t"].cast("bigint").alias("tbl_pos"),
            F.lower(F.get(F.col("table_names_original"), x["t"])).alias("tbl"),
            F.get(F.col("table_names"), x["t"]).alias("tbl_norm"),
            x["col_pos"].alias("col_pos"),
            x["col"].alias("col"),
            x["col_norm"].alias("col_norm"),
            x["type"].alias("type"),
        ),
    )


def _key_positions() -> Column:
    """Column indices of single (``3``) and composite (``[3, 4]``) key entries."""
    return F.flatten(
        F.transform(
            "primary_keys",
            lambda k: F.from_json(
                F.when(k.startswith("["), k).otherwise(F.concat(F.lit("["), k, F.lit("]"))),
                "array<bigint>",
            ),
        )
    )


def _declared_structs() -> Column:
    """Declared pairs with the names of their targets."""
    named = F.transform(
        "foreign_keys",
        lambda p, i: F.struct(
            i.alias("pair"),
            F.get(p, F.lit(0)).cast("bigint").alias("col_pos"),
            F.get(F.col("column_names_original"), F.get(p, F.lit(1))).alias("target"),
        ),
    )
    # A pair onto the ``*`` pseudo-column names no table and is no key.
    named = F.filter(named, lambda x: F.get(x["target"], F.lit(0)).cast("int") >= 0)
    return F.transform(
        named,
        lambda x: F.struct(
            x["pair"].alias("pair"),
            x["col_pos"].alias("col_pos"),
            F.lower(
                F.get(F.col("table_names_original"), F.get(x["target"], F.lit(0)).cast("int"))
            ).alias("fk_tbl"),
            F.lower(F.get(x["target"], F.lit(1))).alias("fk_col"),
        ),
    )


def flatten_dump(raw: DataFrame, type_offset: int = 0) -> DataFrame:
    """One row per real column; the ``*`` pseudo-column has no table and drops out.

    No array is carried on the exploded rows, and nothing is shuffled.
    """
    return raw.select(F.col("db_id").alias("db"), F.inline(_column_structs(type_offset)))


def flatten_tables(raw: DataFrame) -> DataFrame:
    """(db, tbl_pos, tbl, tbl_norm) of every table, also of those without columns."""
    return raw.select(
        F.col("db_id").alias("db"),
        F.inline(
            F.transform(
                "table_names_original",
                lambda t, i: F.struct(
                    i.cast("bigint").alias("tbl_pos"),
                    F.lower(t).alias("tbl"),
                    F.get("table_names", i).alias("tbl_norm"),
                ),
            )
        ),
    )


def primary_keys(raw: DataFrame) -> DataFrame:
    """(db, col_pos, pk_pos) of the key columns, by their first entry."""
    return (
        raw.select(F.col("db_id").alias("db"), F.posexplode(_key_positions()).alias("p", "col_pos"))
        .groupBy("db", "col_pos")
        .agg(F.min("p").alias("pk_pos"))
    )


def declared_keys(raw: DataFrame) -> DataFrame:
    """(db, col_pos, fk_tbl, fk_col) of the declared pairs; the last pair wins."""
    pairs = raw.select(F.col("db_id").alias("db"), F.inline(_declared_structs()))
    last = pairs.groupBy("db", "col_pos").agg(
        F.max_by(F.struct("fk_tbl", "fk_col"), "pair").alias("fk")
    )
    return last.select("db", "col_pos", "fk.fk_tbl", "fk.fk_col")


def first_two_keys(columns: DataFrame) -> DataFrame:
    """(db, col, first, second): the first two key columns of a name, never ``id``."""
    keys = columns.where(F.col("pk_pos").isNotNull() & (F.col("col") != "id"))
    order = Window.partitionBy("db", "col").orderBy("pk_pos")
    ranked = keys.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    target = F.struct(F.col("col_pos").alias("at"), F.col("tbl"))
    return ranked.groupBy("db", "col").agg(
        F.max(F.when(F.col("rn") == 1, target)).alias("first"),
        F.max(F.when(F.col("rn") == 2, target)).alias("second"),
    )


def _other_key(col_pos: Column) -> Column:
    """The first key column of the name that is not the column itself."""
    return F.when(F.col("first.at") != col_pos, F.col("first")).otherwise(F.col("second"))


def inferred_keys(columns: DataFrame) -> DataFrame:
    """(db, col_pos, fk_tbl, fk_col): the first other key column of the same name.

    columns(db, tbl, col_pos, col, pk_pos). Only the first two key columns of a
    (db, name) can be an answer (the second serves the first itself), so the
    name group is reduced to two rows before the join and never paired up.
    """
    return (
        columns.select("db", "col_pos", "col")
        .join(first_two_keys(columns), ["db", "col"])
        .withColumn("hit", _other_key(F.col("col_pos")))
        .where("hit is not null")
        .select("db", "col_pos", F.col("hit.tbl").alias("fk_tbl"), F.col("col").alias("fk_col"))
    )


def key_columns(raw: DataFrame) -> DataFrame:
    """(db, tbl, col_pos, col, pk_pos) of the key columns, straight from the dump row."""
    keys = F.transform(
        _key_positions(),
        lambda k, i: F.struct(
            k.alias("col_pos"),
            i.alias("p"),
            F.get(F.col("column_names_original"), k.cast("int")).alias("c"),
        ),
    )
    named = F.transform(
        keys,
        lambda x: F.struct(
            x["col_pos"].alias("col_pos"),
            x["p"].alias("p"),
            F.lower(
                F.get(F.col("table_names_original"), F.get(x["c"], F.lit(0)).cast("int"))
            ).alias("tbl"),
            F.lower(F.get(x["c"], F.lit(1))).alias("col"),
        ),
    )
    return (
        raw.select(F.col("db_id").alias("db"), F.inline(named))
        .groupBy("db", "tbl", "col_pos", "col")
        .agg(F.min("p").alias("pk_pos"))
    )


def keyed_columns(raw: DataFrame, type_offset: int = 0) -> DataFrame:
    """Flat columns with (pk_pos, declared): one pass over the dump, one shuffle.

    Columns, key entries and declared pairs leave the dump row together as facts
    about (db, col_pos) and are merged by one partial aggregation.
    """
    column = "struct<tbl_pos:bigint,tbl:string,tbl_norm:string,col:string,col_norm:string,type:string>"
    key = "struct<fk_tbl:string,fk_col:string>"

    def fact(col_pos: Column, **known: Column) -> Column:
        none = {
            "c": F.lit(None).cast(column),
            "pk_pos": F.lit(None).cast("int"),
            "pair": F.lit(None).cast("int"),
            "fk": F.lit(None).cast(key),
        }
        fields = [known.get(name, value).alias(name) for name, value in none.items()]
        return F.struct(col_pos.cast("bigint").alias("col_pos"), *fields)

    columns = F.transform(
        _column_structs(type_offset),
        lambda x: fact(
            x["col_pos"],
            c=F.struct(*[x[n].alias(n) for n in ("tbl_pos", "tbl", "tbl_norm", "col", "col_norm", "type")]),
        ),
    )
    keys = F.transform(_key_positions(), lambda k, i: fact(k, pk_pos=i))
    pairs = F.transform(
        _declared_structs(),
        lambda x: fact(
            x["col_pos"], pair=x["pair"], fk=F.struct(x["fk_tbl"].alias("fk_tbl"), x["fk_col"].alias("fk_col"))
        ),
    )
    facts = raw.select(F.col("db_id").alias("db"), F.inline(F.concat(columns, keys, pairs)))
    merged = facts.groupBy("db", "col_pos").agg(
        F.first("c", ignorenulls=True).alias("c"),
        F.min("pk_pos").alias("pk_pos"),
        F.max_by("fk", "pair").alias("declared"),
    )
    return merged.where("c is not null").select("db", "col_pos", "c.*", "pk_pos", "declared")


def _finished_structs(type_offset: int) -> Column:
    """The real columns of a dump row with (is_key, declared, hit), looked up inside the row."""
    keys = F.transform(
        F.array_distinct(_key_positions()),
        lambda k: let(
            F.get(F.col("column_names_original"), k.cast("int")),
            lambda c: F.struct(
                k.alias("at"),
                F.lower(F.get(F.col("table_names_original"), F.get(c, F.lit(0)).cast("int"))).alias("tbl"),
                F.lower(F.get(c, F.lit(1))).alias("col"),
            ),
        ),
    )

    def finished(x: Column, ks: Column, pairs: Column) -> Column:
        own = F.filter(pairs, lambda p: p["col_pos"] == x["col_pos"])
        others = F.filter(
            ks, lambda k: (k["col"] == x["col"]) & (k["col"] != "id") & (k["at"] != x["col_pos"])
        )
        return F.struct(
            *[x[n].alias(n) for n in ("tbl_pos", "tbl", "tbl_norm", "col_pos", "col", "col_norm", "type")],
            F.exists(ks, lambda k: k["at"].eqNullSafe(x["col_pos"])).alias("is_key"),
            let(own, lambda o: F.get(o, F.size(o) - 1)).alias("declared"),
            F.when(F.col("db_id").isNotNull(), F.get(others, F.lit(0))).alias("hit"),
        )

    return let(
        F.struct(keys.alias("ks"), _declared_structs().alias("pairs")),
        lambda v: F.transform(_column_structs(type_offset), lambda x: finished(x, v["ks"], v["pairs"])),
    )


def _merged_columns(raw: DataFrame, type_offset: int) -> DataFrame:
    """Flat columns with (is_key, declared, hit) by shuffles, for any dump."""
    two = first_two_keys(key_columns(raw))
    return (
        keyed_columns(raw, type_offset)
        .join(two, ["db", "col"], "left")
        .withColumn("is_key", F.col("pk_pos").isNotNull())
        .withColumn("hit", _other_key(F.col("col_pos")))
    )


def looked_up_columns(raw: DataFrame, type_offset: int = 0) -> DataFrame:
    """Flat columns with (is_key, declared, hit): no shuffle where a dump row can answer alone.

    A row whose columns times key entries stay below ``ROW_LOOKUPS`` looks its
    keys up inside the row. Larger ones, and databases of several rows, are
    merged by shuffles.
    """
    entries = F.size(_key_positions()) + F.size("foreign_keys")
    large = F.coalesce(F.size("column_names_original") * entries > ROW_LOOKUPS, F.lit(True))
    per_db = raw.groupBy("db_id").agg(F.count(F.lit(1)).alias("n"), F.max(large).alias("large"))
    odd = cut_lineage(per_db.where("n > 1 or large").select(F.col("db_id").alias("odd")))
    alone = raw.select(F.col("db_id").alias("db"), F.inline(_finished_structs(type_offset)))
    if odd.isEmpty():
        return alone
    same = F.col("db_id").eqNullSafe(F.col("odd"))
    rest = raw.join(odd, same, "left_anti")
    alone = rest.select(F.col("db_id").alias("db"), F.inline(_finished_structs(type_offset)))
    merged = _merged_columns(raw.join(odd, same, "left_semi"), type_offset)
    names = ["db", "tbl_pos", "tbl", "tbl_norm", "col_pos", "col", "col_norm", "type", "is_key"]
    shown = [*names, "declared.fk_tbl", "declared.fk_col", "hit.tbl"]
    flat = [*names, "fk_tbl", "fk_col", "hit_tbl"]
    rows = [
        side.select(*shown, F.col("declared").isNotNull(), F.col("hit").isNotNull()).toDF(*flat, "d", "h")
        for side in (alone, merged)
    ]
    both = rows[0].unionByName(rows[1])
    return both.select(
        *names,
        F.when(F.col("d"), F.struct("fk_tbl", "fk_col")).alias("declared"),
        F.when(F.col("h"), F.struct(F.col("hit_tbl").alias("tbl"))).alias("hit"),
    )


def build_catalog(raw: DataFrame, type_offset: int = 0, split_names: bool = False) -> DataFrame:
    """The whole catalog of a dump, with declared and inferred foreign keys."""
    cols = looked_up_columns(raw, type_offset)
    if split_names:
        cols = cols.withColumn("tbl_norm", normalise_name(F.col("tbl"))).withColumn(
            "col_norm", normalise_name(F.col("col"))
        )
    return cols.select(
        "db",
        "tbl_pos",
        "tbl",
        "tbl_norm",
        "col_pos",
        "col",
        "col_norm",
        "type",
        F.col("is_key").alias("is_pk"),
        F.coalesce("declared.fk_tbl", "hit.tbl").alias("fk_tbl"),
        F.when(F.col("declared").isNotNull(), F.col("declared.fk_col"))
        .when(F.col("hit").isNotNull(), F.col("col"))
        .alias("fk_col"),
    )


# Per source format, the renamed and dropped record fields.
_TOKEN_FIELDS = ["query_toks", "query_toks_no_value", "question_toks"]
RECORD_RULES: dict[str, dict] = {
    "base": {"rename": {"db_id": "db", "query": "sql"}, "drop": _TOKEN_FIELDS},
    "synonym": {
        "rename": {"db_id": "db", "query": "sql", "SpiderSynQuestion": "question"},
        "drop": ["SpiderQuestion"],
    },
    "realistic": {"rename": {"db_id": "db", "query": "sql"}, "drop": _TOKEN_FIELDS},
    "perturbed": {
        "rename": {"db_id": "db", "query": "sql"},
        "drop": [*_TOKEN_FIELDS, "q_id_spider_dev"],
    },
    "evidence": {
        "rename": {"db_id": "db", "SQL": "sql"},
        "drop": [
            "question_toks",
            "SQL_toks",
            "evidence_toks",
            "evidence",
            "question_id",
            "difficulty",
        ],
    },
    "finance": {
        "rename": {"db_id": "db", "query": "sql"},
        "drop": _TOKEN_FIELDS,
        "trim": ["question", "sql"],
    },
}


def reshape_records(records: DataFrame, rule: str) -> DataFrame:
    """Bring a source's question records to (…, question, sql, db)."""
    spec = RECORD_RULES[rule]
    out = records.withColumnsRenamed(spec["rename"]).drop(*spec["drop"])
    for name in spec.get("trim", []):
        out = out.withColumn(name, strip(F.col(name)))
    return out


def split_bad_records(records: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with a reason): records that cannot be labelled.

    A record fails when its SQL is empty, leaves a quote open, does not start a
    query, or names an unknown database.
    """
    known = columns.select("db").distinct().withColumn("_known", F.lit(True))
    sql = F.coalesce(strip(F.col("sql")), F.lit(""))
    quotes = F.length(sql) - F.length(F.replace(sql, F.lit("'"), F.lit("")))
    reason = (
        F.when(sql == "", "empty sql")
        .when(quotes % 2 == 1, "open quote")
        .when(~F.lower(sql).rlike(r"^\(*\s*(select|with)\b"), "not a query")
        .when(F.col("_known").isNull(), "unknown database")
    )
    tagged = records.join(known, "db", "left").withColumn("reason", reason).drop("_known")
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def gold_columns(columns: DataFrame, mentions: DataFrame) -> DataFrame:
    """Only the columns that some question mentions."""
    return columns.join(
        mentions.select("db", "tbl", "col").distinct(), ["db", "tbl", "col"], "left_semi"
    )


def nest_catalog(columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """catalog(db, tables): one row per database, in catalog order.

    tables(db, tbl_pos, tbl, tbl_norm) adds those that have no column.

    Columns are gathered per table first, then tables per database. The record
    format is one database per row, so its size is the database's own.
    """
    key = F.when(
        F.col("fk_tbl").isNotNull(),
        F.struct(F.col("fk_tbl").alias("table"), F.col("fk_col").alias("column")),
    )
    column = F.struct(
        F.col("col_pos").alias("pos"),
        F.col("col").alias("name"),
        F.col("col_norm").alias("normalized_name"),
        F.col("type"),
        F.col("is_pk").alias("primary_key"),
        key.alias("foreign_key"),
    )
    # One shuffle, by database, serves both steps.
    per_table = columns.repartition("db").groupBy("db", "tbl_pos", "tbl", "tbl_norm").agg(
        F.sort_array(F.collect_list(column)).alias("columns")
    )
    if tables is not None:
        names = ["db", "tbl_pos", "tbl", "tbl_norm"]
        bare = tables.select(*names).join(per_table.select(*names), names, "left_anti")
        per_table = per_table.unionByName(bare, allowMissingColumns=True)
    table = F.struct(
        F.col("tbl_pos").alias("pos"),
        F.col("tbl").alias("name"),
        F.col("tbl_norm").alias("normalized_name"),
        F.transform(
            F.coalesce("columns", F.array().cast(per_table.schema["columns"].dataType)),
            lambda c: c.dropFields("pos"),
        ).alias("columns"),
    )
    return per_table.groupBy("db").agg(
        F.transform(
            F.sort_array(F.collect_list(table)), lambda t: t.dropFields("pos")
        ).alias("tables")
    )
