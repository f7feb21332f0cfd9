"""Which tables and columns a SQL text mentions.

No SQL is parsed. A statement's tokens become rows; running sums and last values
tell each token its depth of parentheses, the part it stands in, the clause
within that part and its place in an item of a FROM clause. An item starts with
its table's name; an alias, with or without AS, is no mention, nor is the FROM
of a function's arguments (``extract(year FROM d)``) a clause. All other names
count as columns. Both are kept only if the question's own catalog has them. A
column name without its table counts for every mentioned table that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.session import cut_lineage

# Characters of statements in a task that sorts their tokens.
CHARS_AT_ONCE = 2_000_000

# What a token is, and words with a meaning of their own.
_QUOTED = r'"(?:[^"]|"")*+"|`(?:[^`]|``)*+`|\[[^\]]*\]'
_STRING = r"'(?:[^']|'')*+'"
_COMMENT = r"--[^\n]*|/\*(?s:.*?)\*/"
_TOKEN = rf"{_COMMENT}|{_STRING}|{_QUOTED}|(?U:[\w$]+)|\S"
_CLAUSES = {
    "item": ["from", "join", "into", "update"],
    "condition": ["on", "using"],
    "select": ["select"],
    "with": ["with"],
    "other": ["where", "group", "order", "having", "limit", "union", "intersect", "except", "minus",
              "window", "qualify", "set", "values", "returning"],
}
# An operand follows these, so a name behind them is no alias.
_OPERATORS = [
    "distinct", "all", "top", "and", "or", "not", "in", "like", "ilike", "rlike", "regexp", "glob",
    "similar", "to", "between", "is", "case", "when", "then", "else", "as", "over", "filter", "within",
    "escape", "collate", "div", "mod", "xor", "interval", "exists", "any", "some", "by", "asc", "desc",
]


def _dealt(statements: DataFrame) -> DataFrame:
    """Each statement in one of as many tasks as their length asks for.

    Tokens take many times the room of their text and are sorted more than once, so
    a task's share is bounded before they become rows, and no token is shuffled.
    """
    kept = cut_lineage(statements.select("qid", "db", "sql"))
    chars = kept.agg(F.sum(F.length("sql").cast("bigint")).alias("n")).first()["n"] or 0
    cores = kept.sparkSession.sparkContext.defaultParallelism
    return kept.repartition(max(cores, chars // CHARS_AT_ONCE + 1), "qid", "db")


def _tokens(statements: DataFrame) -> DataFrame:
    """(qid, db, pos, token, kind): lower-cased, without comments, names unquoted."""
    all_tokens = F.regexp_extract_all("sql", F.lit(_TOKEN), F.lit(0))
    shown = F.filter(all_tokens, lambda x: ~F.regexp_like(x, F.lit(rf"^(?:{_COMMENT})$")))
    rows = statements.select("qid", "db", F.posexplode(shown).alias("pos", "raw"))
    first = F.substring("raw", 1, 1)
    kind = (
        F.when((F.length("raw") > 1) & first.isin('"', "`", "["), "quoted")
        .when((F.length("raw") > 1) & (first == "'"), "string")
        .when(F.regexp_like("raw", F.lit(r"^\d+$")), "number")
        .when(F.regexp_like("raw", F.lit(r"^(?U:[\w$]+)$")), "word")
        .otherwise("sign")
    )
    inner = F.expr("substring(raw, 2, length(raw) - 2)")
    name = (
        F.when(kind != "quoted", F.col("raw"))
        .when(first == '"', F.replace(inner, F.lit('""'), F.lit('"')))
        .when(first == "`", F.replace(inner, F.lit("``"), F.lit("`")))
        .otherwise(inner)
    )
    return rows.select("qid", "db", "pos", F.lower(name).alias("token"), kind.alias("kind"))


def _is(kind: str, *tokens: str) -> Column:
    return (F.col("kind") == kind) & F.col("token").isin(*tokens)


def _in_parts(tokens: DataFrame) -> DataFrame:
    """Adds the neighbours of each token, its depth and the place where its part opens.

    An opening parenthesis belongs to the part it opens, a closing one to the
    part around it, where it stands for what it closes.
    """
    text = Window.partitionBy("qid", "db").orderBy("pos")
    signed = F.when(F.col("kind").isin("sign", "word"), F.col("token"))
    step = F.when(_is("sign", "("), 1).when(_is("sign", ")"), -1).otherwise(0)
    level = Window.partitionBy("qid", "db", "depth").orderBy("pos")
    return (
        tokens.withColumn("before", F.lag(signed).over(text))
        .withColumn("before_that", F.lag(signed, 2).over(text))
        .withColumn("behind", F.lead(signed).over(text))
        .withColumn("depth", F.sum(step).over(text))
        .withColumn("opened", F.last(F.when(_is("sign", "("), F.col("pos")), True).over(level))
    )


def _in_clauses(parts: DataFrame) -> DataFrame:
    """Adds the clause (null before the first), and the place and dots within an item."""
    part = Window.partitionBy("qid", "db", "depth", "opened").orderBy("pos")
    free = (F.col("kind") == "word") & (F.coalesce("before", F.lit("")) != ".") & (
        F.coalesce("behind", F.lit("")) != "."
    )
    clause = F.when(_is("sign", "(") & F.col("before").isin("from", "join"), "item")
    for name, words in _CLAUSES.items():
        clause = clause.when(free & F.col("token").isin(words), name)
    clause = clause.when(_is("sign", "(", ";"), "other")
    # Without a SELECT before it, a FROM in parentheses belongs to a function; WITH may be part of a type.
    selected = F.coalesce(F.max(clause == "select").over(part), F.lit(False))
    argument = (F.col("token") == "from") & F.col("opened").isNotNull() & ~selected
    compared = F.col("token").isin("from", "on") & (F.coalesce("last", F.lit("")) == "distinct")
    late = (F.col("token") == "with") & selected
    listed = _is("sign", ",") & F.col("region").isin("item", "condition")
    numbered = (
        parts.withColumn("last", F.lag("token").over(part))
        .withColumn("last_kind", F.lag("kind").over(part))
        .withColumn("last_but_one", F.lag("token", 2).over(part))
        .withColumn("nth", F.row_number().over(part))
        .withColumn("dots", F.count(F.when(_is("sign", "."), True)).over(part))
        .withColumn("opens", F.when(~(argument | compared | late), clause))
        .withColumn("clause_word", clause.isNotNull())
        .withColumn("region", F.last("opens", True).over(part))
        .withColumn("opens", F.when(listed, "item").otherwise(F.col("opens")))
    )
    item = F.when(F.col("opens") == "item", F.struct("nth", "dots"))
    return (
        numbered.withColumn("clause", F.last("opens", True).over(part))
        .withColumn("item", F.last(item, True).over(part))
    )


def mentioned_names(statements: DataFrame) -> DataFrame:
    """(qid, db, name, is_table): each name of statements(qid, db, sql) once per use.

    A statement has one qid. Null and empty texts name nothing.
    """
    rows = _in_clauses(_in_parts(_tokens(_dealt(statements))))
    name = F.col("kind").isin("word", "quoted")
    qualifier = F.coalesce("behind", F.lit("")) == "."
    place = F.col("nth") - F.col("item.nth") - 1
    is_table = (
        (F.col("clause") == "item") & ~F.col("clause_word") & ~qualifier & (place >= 0)
        & (place == 2 * (F.col("dots") - F.col("item.dots")))
    )
    called = (F.col("kind") == "word") & (F.coalesce("behind", F.lit("")) == "(")
    unit = (F.col("before_that") == "extract") & (F.col("before") == "(") & (F.col("behind") == "from")
    last = F.coalesce("last", F.lit(""))
    # TOP 5, TOP (5) and DISTINCT ON (a) stand before the first operand.
    limited = (F.col("last_but_one") == "top") & (F.col("last_kind") == "number") | (
        F.col("last_but_one").isin("top", "on") & (last == ")")
    )
    operand = (
        F.col("last_kind").isin("quoted", "string", "number")
        | (F.col("last_kind") == "word")
        & (~last.isin(*_OPERATORS, "select") | (F.col("last_but_one") == "."))
        | (last == ")")
    ) & ~F.coalesce(limited, F.lit(False))
    operator = (F.col("kind") == "word") & F.col("token").isin(_OPERATORS)
    alias = (last == "as") | ((F.col("clause") == "select") & F.coalesce(operand, F.lit(False)) & ~operator)
    is_column = (
        ~F.coalesce("clause", F.lit("")).isin("item", "with") & ~F.col("clause_word") & ~qualifier
        & ~called & ~alias & ~F.coalesce(unit, F.lit(False))
    )
    used = rows.where(name).select(
        "qid", "db", F.col("token").alias("name"),
        F.when(is_table, True).when(is_column, False).alias("is_table"),
    )
    return used.where("is_table is not null").distinct()


def sql_mentions(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """(qid, db, tbl_pos, tbl, col_pos, col): mentioned tables and their columns.

    statements(qid, db, sql). A mentioned table without a mentioned column has
    one row with a null column.
    """
    none = F.lit(None)
    tables = columns.select(
        "db", F.col("tbl").alias("name"), F.lit(True).alias("is_table"), "tbl",
        F.struct("tbl_pos").alias("t"), none.alias("c"),
    ).distinct()
    cols = columns.select(
        "db", F.col("col").alias("name"), F.lit(False).alias("is_table"), "tbl",
        none.alias("t"), F.struct("col_pos", "col").alias("c"),
    )
    # One table's entries in one statement are gathered: no more than the table has columns.
    hit = (
        mentioned_names(statements)
        .join(tables.unionByName(cols), ["db", "name", "is_table"])
        .groupBy("qid", "db", "tbl")
        .agg(F.collect_set("t").alias("ts"), F.collect_set("c").alias("cs"))
    )
    tabled = hit.select("qid", "db", "tbl", F.explode("ts").alias("t"), "cs")
    return tabled.select("qid", "db", "t.tbl_pos", "tbl", F.explode_outer("cs").alias("c")).select(
        "qid", "db", "tbl_pos", "tbl", "c.col_pos", "c.col"
    )


def instances(statements: DataFrame, mentions: DataFrame) -> DataFrame:
    """Question records with their schema: {database, metadata[{name, columns[]}]}.

    A record gathers only what its own SQL text names.
    """
    per_table = mentions.groupBy("qid", "tbl_pos", "tbl").agg(
        F.sort_array(
            F.collect_list(
                F.when(F.col("col").isNotNull(), F.struct("col_pos", "col"))
            )
        ).alias("cols")
    )
    item = F.struct(
        "tbl_pos",
        F.col("tbl").alias("name"),
        F.transform("cols", lambda c: c["col"]).alias("columns"),
    )
    per_question = per_table.groupBy("qid").agg(
        F.transform(
            F.sort_array(F.collect_list(item)), lambda t: t.dropFields("tbl_pos")
        ).alias("metadata")
    )
    empty = F.array().cast("array<struct<name:string,columns:array<string>>>")
    return statements.join(per_question, "qid", "left").select(
        "qid",
        "question",
        "sql",
        F.struct(
            F.col("db").alias("database"), F.coalesce("metadata", empty).alias("metadata")
        ).alias("schema"),
    )
