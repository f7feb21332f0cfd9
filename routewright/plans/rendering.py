"""Rendering and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import context, graph, parsing, render
from routewright.plans import tables as t


def docs_column(spark, d):
    return render.docs_column(t.plain_columns(spark, d))


def docs_table(spark, d):
    return render.docs_table(t.plain_columns(spark, d))


def docs_database(spark, d):
    return render.docs_database(t.plain_columns(spark, d))


def stringize_schema(spark, d):
    return t.instances(spark, d).select("qid", render.schema_text(F.col("schema")).alias("text"))


def question_prompt(spark, d):
    return t.instances(spark, d).select("qid", render.question_prompt(F.col("schema")).alias("text"))


def contrastive_pair(spark, d):
    return t.instances(spark, d).select(
        "qid", "question", render.contrastive_text(F.col("schema")).alias("text")
    )


def _prompt_rows(spark, d):
    """Questions with the schemas of their order and of the order's parts' orders."""
    gold = t.gold(spark, d)
    own = context.nest_context(context.context_table(gold, t.gold_mentions(spark, d), t.plain_columns(spark, d)))
    asked = t.statements(spark, d).select("qid", "question", "sql")
    return asked.join(own, "qid")


def _twice(schemas):
    """The schema list doubled, to have more than one schema."""
    return F.concat(schemas, schemas)


def sql_prompt_single(spark, d):
    return _prompt_rows(spark, d).select(
        "qid", render.sql_prompt(F.col("question"), F.col("schemas")).alias("text")
    )


def sql_prompt_multi(spark, d):
    return _prompt_rows(spark, d).select(
        "qid", render.sql_prompt(F.col("question"), _twice(F.col("schemas"))).alias("text")
    )


def db_choice_prompt(spark, d):
    return _prompt_rows(spark, d).select(
        "qid", render.db_choice_prompt(F.col("question"), _twice(F.col("schemas"))).alias("text")
    )


def few_shot_messages(spark, d):
    """Each question's own record is its one example."""
    example = F.array(F.struct("question", "sql", "schemas"))
    messages = render.few_shot_messages(F.col("question"), F.col("schemas"), example)
    return _prompt_rows(spark, d).select("qid", F.posexplode(messages).alias("pos", "m")).select(
        "qid", "pos", "m.role", "m.content"
    )


def segment_prompt(spark, d):
    return t.questions(spark, d).select("qid", render.segment_prompt(F.col("text")).alias("text"))


def text2schema_pair(spark, d):
    targets = graph.flat_label(t.gold_mentions(spark, d), t.SEP)
    asked = t.statements(spark, d).select(
        "qid", F.when(F.col("sql") != "", F.col("question")).alias("question")
    )
    return render.training_pairs(asked, targets)


def _completions(spark, d):
    """(qid, text): numbered schema items per order; a highly taxed line lacks its number."""
    item = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.concat(
            F.when(F.col("l_tax") > 0.075, F.lit("")).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(":"))),
            F.lit(" supplier_"),
            F.col("l_suppkey").cast("string"),
            F.lit("(part "),
            F.col("l_partkey").cast("string"),
            F.lit(", ship-date, a/b)"),
        ).alias("s"),
    )
    lines = t.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("ls"))
    return lines.select(
        F.col("l_orderkey").alias("qid"),
        F.array_join(F.transform("ls", lambda x: x["s"]), "\n").alias("text"),
    )


def parse_segments(spark, d):
    return _completions(spark, d).select(
        "qid", F.posexplode(parsing.parse_segments(F.col("text"))).alias("sid", "segment")
    )


def assemble_sql(spark, d):
    """Replies are conversation turns, which have several lines."""
    turns = t.load(spark, d, "conversations")
    return turns.select("conv_id", "turn", parsing.assemble_sql(F.col("text")).alias("sql"))


def pick_database(spark, d):
    """Replies name a database by the line number, beyond the list for some."""
    reply = F.when(F.col("l_returnflag") == "A", F.lit("none of them")).otherwise(
        F.concat(F.lit("The answer is ["), F.col("l_linenumber").cast("string"), F.lit("], not [0]"))
    )
    lines = t.load(spark, d, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        parsing.pick_database(reply, F.lit(5)).alias("picked"),
    )


def strip_special_tokens(spark, d):
    text = parsing.strip_special_tokens(F.col("text"), ["<s>", "<pad>", "</s>"])
    return t.beams(spark, d).select("qid", "beam", text.alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        docs_column,
        docs_table,
        docs_database,
        stringize_schema,
        question_prompt,
        contrastive_pair,
        sql_prompt_single,
        sql_prompt_multi,
        db_choice_prompt,
        few_shot_messages,
        segment_prompt,
        text2schema_pair,
        parse_segments,
        assemble_sql,
        pick_database,
        strip_special_tokens,
    )
}


def _sql(text: str) -> str:
    """A SQL string literal, with line breaks spelled out."""
    return "'" + text.replace("'", "''") + "'"


_TB = f"""WITH {t.LINES},
tb AS (SELECT ok, db, tbl_pos, tbl, tbl_norm, string_agg(col, ',' ORDER BY col_pos) AS c,
    string_agg(col_norm, ' ' ORDER BY col_pos) AS words, string_agg('"' || col || '"', ', ' ORDER BY col_pos) AS q,
    string_agg(col, ',' ORDER BY col_pos) FILTER (col LIKE 'r%') AS r
  FROM cols GROUP BY ok, db, tbl_pos, tbl, tbl_norm)"""

_META = f"""{_TB},
meta AS (SELECT ok AS qid, db,
    coalesce(string_agg('- ' || tbl || ' (' || replace(r, ',', ', ') || ')', chr(10) ORDER BY tbl_pos), '') AS text,
    coalesce(string_agg(tbl || ' ' || replace(r, ',', ' '), ' ' ORDER BY tbl_pos), '') AS pair
  FROM tb GROUP BY ok, db)"""

_QUESTION = "'Which lines of order ' || qid || ' came back?'"

_SHOWN = f"""{_TB},
shown AS (SELECT ok AS qid, db,
    coalesce(string_agg(tbl || '(' || q || ')' || chr(10) || '# ', '' ORDER BY tbl_pos) FILTER (r IS NOT NULL), '') AS h,
    coalesce(string_agg(tbl || '(' || q || ')' || chr(10), '' ORDER BY tbl_pos) FILTER (r IS NOT NULL), '') AS p
  FROM tb GROUP BY ok, db),
asked AS (SELECT qid, db, h, p, {_QUESTION} AS question FROM shown)"""

_END = "chr(10) || '### ' || question || chr(10) || 'SELECT'"
_SINGLE = f"{_sql(render.SINGLE_HEAD)} || h || {_END}"
_ONE_MULTI = "db || chr(10) || '# ' || h"
_MULTI = f"{_sql(render.MULTI_HEAD)} || {_ONE_MULTI} || chr(10) || '# ' || {_ONE_MULTI} || {_END}"

from routewright.plans.catalog import STATEMENTS  # noqa: E402

ORACLE = {
    "docs_column": f"""WITH {t.LINES}
SELECT db, tbl, col, db || ' ' || tbl_norm || ' ' || col_norm AS text FROM cols""",
    "docs_table": f"{_TB} SELECT db, tbl, db || ' ' || tbl_norm || ' ' || words AS text FROM tb",
    "docs_database": f"""{_TB}
SELECT db,
  db || ' ' || string_agg(tbl_norm || ' ' || words, ' ' ORDER BY tbl_pos) AS text FROM tb GROUP BY db""",
    "stringize_schema": f"{_META} SELECT qid, db || chr(10) || text AS text FROM meta",
    "question_prompt": f"""{_META}
SELECT qid, {_sql(render.QUESTION_INSTRUCTION)} || db || chr(10) || text || chr(10) AS text FROM meta""",
    "contrastive_pair": f"{_META} SELECT qid, {_QUESTION} AS question, pair AS text FROM meta",
    "sql_prompt_single": f"{_SHOWN} SELECT qid, {_SINGLE} AS text FROM asked",
    "sql_prompt_multi": f"{_SHOWN} SELECT qid, {_MULTI} AS text FROM asked",
    "db_choice_prompt": f"""{_SHOWN}
SELECT qid, {_sql(render.CHOICE_HEAD)} || question || {_sql(render.CHOICE_MIDDLE)}
  || '[0] ' || db || chr(10) || p || chr(10) || chr(10) || '[1] ' || db || chr(10) || p AS text FROM asked""",
    "few_shot_messages": f"""{_SHOWN}, {STATEMENTS},
one AS (SELECT qid, {_SINGLE} AS prompt FROM asked)
SELECT qid, unnest([0, 1, 2]) AS pos, unnest(['user', 'assistant', 'user']) AS role,
  unnest([prompt, regexp_replace(sql, '^SELECT', ''), prompt]) AS content FROM one JOIN stm USING (qid)""",
    "segment_prompt": f"""SELECT item_id AS qid,
  {_sql(render.SEGMENT_PROMPT)} || text || chr(10) || chr(10) || 'Tables: ' AS text FROM benchmark""",
    "text2schema_pair": f"""WITH {t.LINES}, {t.GOLD}
SELECT qid, {_QUESTION} AS source, string_agg(tbl, '<sep>' ORDER BY tbl_pos) AS target
FROM (SELECT DISTINCT qid, tbl_pos, tbl FROM gold) GROUP BY qid""",
    "parse_segments": """WITH x AS (
  SELECT l_orderkey AS qid, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_tax > 0.075 AS bad FROM lineitem),
q AS (SELECT qid, bool_or(bad) AS bad, string_agg(CASE WHEN bad THEN '' ELSE ln || ':' END || ' supplier_' || sk
    || '(part ' || pk || ', ship-date, a/b)', chr(10) ORDER BY ln, pk, sk) AS text FROM x GROUP BY qid),
g AS (SELECT qid, ln, pk, sk, unnest(['part_' || pk, 'ship_date', 'a_b']) AS c, unnest([1, 2, 3]) AS i
  FROM x JOIN (SELECT qid FROM q WHERE NOT bad) USING (qid))
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY ln, pk, sk, i) - 1)::INT AS sid,
  'supplier_' || sk || '.' || c AS segment FROM g
UNION ALL SELECT qid, 0, text FROM q WHERE bad""",
    "assemble_sql": """SELECT conv_id, turn, 'SELECT ' || array_to_string(list_transform(
  string_split(text, chr(10)), lambda s: trim(s)), ' ') AS sql FROM conversations""",
    "pick_database": """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag = 'A' THEN 0 ELSE least(l_linenumber, 4) END AS picked FROM lineitem""",
    "strip_special_tokens": f"""WITH {t.LINES}
SELECT ok AS qid, (j - 1)::INT AS beam,
  CASE WHEN rf = 'N' THEN 'o' || ok ELSE 'o' || pk END || '<sep> s' || sk || '<sep>s' || ln AS text FROM lines""",
}
