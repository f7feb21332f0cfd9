import re

from pyspark.sql import functions as F

from routewright.functions import draws, text
from routewright.operators import parsing, render


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalise_and_tokens(spark):
    assert one(spark, text.normalise_name(F.lit("orderLine_id"))) == "order line id"
    assert one(spark, text.tokens(F.lit("Où est l'été, 2x?"))) == ["où", "est", "l", "été", "2x"]


def test_unit_draw_value(spark):
    # first 32 bits of md5('a')
    assert one(spark, draws.unit_draw(F.lit("a"))) == int("0cc175b9", 16) / 2**32


def naive_segments(completion):
    rows = []
    for line in [ln for ln in completion.splitlines() if ln]:
        bits = line.split(":")
        hit = len(bits) > 1 and re.match(
            r"(\w+)\(([\w\s,]+)\)", bits[1].strip().replace("/", " ").replace("-", " ")
        )
        if not hit:
            return [completion]
        rows += [f"{hit[1]}.{c.replace(' ', '_')}" for c in hit[2].split(", ")]
    return rows


def test_parse_segments(spark):
    cases = [
        "2:member_of_club(club id, student id)",
        "1:a(b)\n\n2:c(d-e, f/g) tail\r\n3: été(naïf x)",
        "1:a(b)\nno number(c)",
        "1:a b(c)",
        "1:a()",
        "  ",
        "1:x:y(z)",
        "",
    ]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(parsing.parse_segments(F.col("t"))).collect()]
    assert got == [naive_segments(c) for c in cases]
    assert got[0] == ["member_of_club.club_id", "member_of_club.student_id"]


def test_empty_completion_asks_question(spark):
    assert one(spark, parsing.segments_or_question(F.lit(""), F.lit("q"))) == ["q"]
    assert one(spark, parsing.segments_or_question(F.lit("1:a(b)\n2:a(b)"), F.lit("q"))) == ["a.b"]


def test_replies(spark):
    assert one(spark, parsing.assemble_sql(F.lit(" a \n\tb"))) == "SELECT a b"
    picks = ["[2]", "[9] or [1]", "none", "[99999999999]", "[x]"]
    df = spark.createDataFrame([(p,) for p in picks], "t string")
    got = [r[0] for r in df.select(parsing.pick_database(F.col("t"), F.lit(4))).collect()]
    assert got == [2, 3, 0, 3, 0]
    mark = parsing.strip_special_tokens(F.lit("<s> a<sep>b</s><pad>"), ["<s>", "<pad>", "</s>"])
    assert one(spark, mark) == "a<sep>b"


SCHEMAS = [
    ("singer", [("singer", ["singer_id", "name"]), ("song", ["song_id", "highest position"])]),
    ("voting", [("votes", ["vote_id"])]),
]
DDL = "array<struct<name:string,tables:array<struct<name:string,columns:array<string>>>>>"


def test_prompts(spark):
    df = spark.createDataFrame(
        [("q?", SCHEMAS, [("eq", "SELECT 1", SCHEMAS[:1])])],
        f"question string, schemas {DDL}, examples array<struct<question:string,sql:string,schemas:{DDL}>>",
    )
    q, s = F.col("question"), F.col("schemas")
    single = df.select(render.sql_prompt(q, F.slice(s, 1, 1))).first()[0]
    assert single == (
        "\n### Complete sqlite SQL query only and with no explanation\n"
        "### Sqlite SQL tables, with their properties:\n#\n"
        '# singer("singer_id", "name")\n# song("song_id", "highest position")\n# \n### q?\nSELECT'
    )
    multi = df.select(render.sql_prompt(q, s)).first()[0]
    assert multi == (
        "\n### Complete sqlite SQL query only and with no explanation\n"
        "### Sqlite SQL databases, with their tables and properties:\n#\n"
        '# singer\n# singer("singer_id", "name")\n# song("song_id", "highest position")\n# \n'
        '# voting\n# votes("vote_id")\n# \n### q?\nSELECT'
    )
    choice = df.select(render.db_choice_prompt(q, s)).first()[0]
    assert choice.endswith(
        'properties:\n\n[0] singer\nsinger("singer_id", "name")\n'
        'song("song_id", "highest position")\n\n\n[1] voting\nvotes("vote_id")\n'
    )
    messages = df.select(render.few_shot_messages(q, s, F.col("examples"))).first()[0]
    assert [m["role"] for m in messages] == ["user", "assistant", "user"]
    # the form of an example follows the instance, which has two schemas here
    assert "databases, with their tables" in messages[0]["content"]
    assert messages[1]["content"] == " 1"
    none = df.select(render.few_shot_messages(q, s, F.lit(None).cast(df.schema["examples"].dataType)))
    assert len(none.first()[0]) == 1


def test_schema_text(spark):
    df = spark.createDataFrame(
        [(("db", [("t1", ["a", "b"]), ("t2", ["c"])]),)],
        "schema struct<database:string,metadata:array<struct<name:string,columns:array<string>>>>",
    )
    assert df.select(render.schema_text(F.col("schema"))).first()[0] == "db\n- t1 (a, b)\n- t2 (c)"
    assert df.select(render.contrastive_text(F.col("schema"))).first()[0] == "t1 a b t2 c"
