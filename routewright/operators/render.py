"""Rendering: retrieval documents, schema text, prompts and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def docs_column(columns: DataFrame) -> DataFrame:
    """(db, tbl, col, text): ``db table column``."""
    return columns.select(
        "db", "tbl", "col", F.concat_ws(" ", "db", "tbl_norm", "col_norm").alias("text")
    )


def _table_text(columns: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("col_pos", "col", "col_norm")))
    return columns.groupBy("db", "tbl_pos", "tbl", "tbl_norm").agg(
        F.array_join(F.transform(ordered, lambda c: c["col_norm"]), " ").alias("cols")
    )


def docs_table(columns: DataFrame) -> DataFrame:
    """(db, tbl, text): ``db table`` and all its column names."""
    return _table_text(columns).select(
        "db", "tbl", F.concat_ws(" ", "db", "tbl_norm", "cols").alias("text")
    )


def docs_database(columns: DataFrame) -> DataFrame:
    """(db, text): ``db`` and all its tables with their columns, in catalog order."""
    text = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("tbl_pos", "tbl", "tbl_norm", "cols"))),
            lambda t: F.concat_ws(" ", t["tbl_norm"], t["cols"]),
        ),
        " ",
    )
    bodies = _table_text(columns).groupBy("db").agg(text.alias("body"))
    return bodies.select("db", F.concat_ws(" ", "db", "body").alias("text"))


def schema_text(schema: Column) -> Column:
    """``db`` and one ``- table (col, col)`` line per table."""
    rows = F.transform(
        schema["metadata"],
        lambda t: F.concat(
            F.lit("- "), t["name"], F.lit(" ("), F.array_join(t["columns"], ", "), F.lit(")")
        ),
    )
    return F.concat(schema["database"], F.lit("\n"), F.array_join(rows, "\n"))


# Fixed value: the instruction in front of a schema when asking for a question.
QUESTION_INSTRUCTION = (
    "Ask a question that needs to be answered by combining the contents of all the tables, "
    "based on the database schema provided below.\n"
)


def question_prompt(schema: Column) -> Column:
    return F.concat(F.lit(QUESTION_INSTRUCTION), schema_text(schema), F.lit("\n"))


def contrastive_text(schema: Column) -> Column:
    """``table col col table col …``, paired with the question for an encoder."""
    return F.array_join(
        F.transform(
            schema["metadata"],
            lambda t: F.concat_ws(" ", t["name"], F.array_join(t["columns"], " ")),
        ),
        " ",
    )


# The SQL and database-choice prompts around a list of schemas.
SINGLE_HEAD = (
    "\n### Complete sqlite SQL query only and with no explanation\n"
    "### Sqlite SQL tables, with their properties:\n#\n# "
)
MULTI_HEAD = (
    "\n### Complete sqlite SQL query only and with no explanation\n"
    "### Sqlite SQL databases, with their tables and properties:\n#\n# "
)
CHOICE_HEAD = (
    "\nBased on the provided natural language question, find the database that can best answer "
    "this question from the list schemas below. Only output the corresponding database schema "
    "number in the [id] format, without any additional information.\n\nQuestion: "
)
CHOICE_MIDDLE = "\n\nSqlite SQL databases, with their tables and properties:\n\n"


def _table_line(table: Column) -> Column:
    quoted = F.transform(table["columns"], lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    return F.concat(table["name"], F.lit("("), F.array_join(quoted, ", "), F.lit(")"))


def _tables(schema: Column, end: str) -> Column:
    return F.array_join(
        F.transform(schema["tables"], lambda t: F.concat(_table_line(t), F.lit(end))), ""
    )


def sql_prompt_single(question: Column, schemas: Column) -> Column:
    """Schema as commented lines, without database names."""
    body = F.array_join(F.transform(schemas, lambda s: _tables(s, "\n# ")), "\n# ")
    return F.concat(F.lit(SINGLE_HEAD), body, F.lit("\n### "), question, F.lit("\nSELECT"))


def sql_prompt_multi(question: Column, schemas: Column) -> Column:
    """Schema as commented lines, each database under its name."""
    body = F.array_join(
        F.transform(schemas, lambda s: F.concat(s["name"], F.lit("\n# "), _tables(s, "\n# "))),
        "\n# ",
    )
    return F.concat(F.lit(MULTI_HEAD), body, F.lit("\n### "), question, F.lit("\nSELECT"))


def sql_prompt(question: Column, schemas: Column, n_schemas: Column | None = None) -> Column:
    """The single form when the instance has exactly one schema, else the multi form."""
    n = F.size(schemas) if n_schemas is None else n_schemas
    return F.when(n == 1, sql_prompt_single(question, schemas)).otherwise(
        sql_prompt_multi(question, schemas)
    )


def db_choice_prompt(question: Column, schemas: Column) -> Column:
    """Numbered candidate databases; the reply names one as ``[id]``."""
    body = F.array_join(
        F.transform(
            schemas,
            lambda s, i: F.concat(
                F.lit("["), i.cast("string"), F.lit("] "), s["name"], F.lit("\n"), _tables(s, "\n")
            ),
        ),
        "\n\n",
    )
    return F.concat(F.lit(CHOICE_HEAD), question, F.lit(CHOICE_MIDDLE), body)


def few_shot_messages(question: Column, schemas: Column, examples: Column) -> Column:
    """user/assistant messages of the examples, then the question's own prompt.

    examples: array of struct(question, sql, schemas). The form of all prompts
    follows the number of the instance's schemas.
    """

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    n = F.size(schemas)
    shots = F.flatten(
        F.transform(
            F.coalesce(examples, F.slice(examples, 1, 0)),
            lambda e: F.array(
                message("user", sql_prompt(e["question"], e["schemas"], n)),
                message("assistant", F.regexp_replace(e["sql"], "^SELECT", "")),
            ),
        )
    )
    own = F.array(message("user", sql_prompt(question, schemas)))
    return F.coalesce(F.concat(shots, own), own)


# Fixed value: six worked examples that ask a model for a minimal schema.
SEGMENT_PROMPT = """Hallucinate the minimal schema of a relational database that can be used to answer the natural language question. Here are some examples:

Example 1:

Question: What are the names of all stations with a latitude smaller than 37.5?

Tables:
1:station(name, latitude)

Example 2:

Question: Count the number of members in club Bootup Balitmore whose age is above 18.

Tables:
1:club(name, club id, club description, location)
2:member_of_club(club id, student id)
3:student(student id, age)

Example 3:

Question: Show the season, the player, and the name of the team that players belong to.

Tables:
1:match_season(season, team, player)
2:team(name, team identifier)

Example 4:

Question: Find the first name and age of the students who are playing both Football and Lacrosse.

Tables:
1:student(first name, age, student id)
2:sportsinfo(student id, sportname)

Example 5:

Question: What are the names of tourist attractions that can be reached by bus or is at address 254 Ottilie Junction?

Tables:
1:locations(address, location id)
2:tourist_attractions(location id, name, how to get there)

Example 6:

Question: Give the name of the highest paid instructor.

Tables:
1:instructor(name, salary)

Example 7:

Question: """


def segment_prompt(question: Column) -> Column:
    return F.concat(F.lit(SEGMENT_PROMPT), question, F.lit("\n\nTables: "))


def training_pairs(instances: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, source, target): question text (empty if there is none) and target label."""
    return instances.join(targets, "qid").select(
        "qid", F.coalesce("question", F.lit("")).alias("source"), F.col("text").alias("target")
    )
