from pyspark.sql import functions as F

from routewright.operators import catalog, labelling, parsing, render
from routewright.sources.readers import DUMP_DDL

DUMP = [
    (
        "shop",
        ["Item", "Sale"],
        ["item", "sale"],
        [["-1", "*"], ["0", "ID"], ["0", "Code"], ["1", "ID"], ["1", "Code"], ["1", "Ref"]],
        [["-1", "*"], ["0", "id"], ["0", "code"], ["1", "id"], ["1", "code"], ["1", "ref"]],
        ["number", "text", "number", "text", "text"],
        ["1", "[2, 3]"],
        [[5, 1], [5, 2]],
    )
]


def build(spark):
    return catalog.build_catalog(spark.createDataFrame(DUMP, DUMP_DDL), type_offset=1)


def test_build_catalog(spark):
    rows = {r["col_pos"]: r for r in build(spark).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]  # the * column has no table
    assert [rows[i]["tbl"] for i in range(1, 6)] == ["item", "item", "sale", "sale", "sale"]
    assert [rows[i]["type"] for i in range(1, 6)] == ["number", "text", "number", "text", "text"]
    assert [rows[i]["is_pk"] for i in range(1, 6)] == [True, True, True, False, False]
    assert (rows[5]["fk_tbl"], rows[5]["fk_col"]) == ("item", "code")  # last pair wins
    assert (rows[4]["fk_tbl"], rows[4]["fk_col"]) == ("item", "code")  # same name as a key
    assert rows[2]["fk_tbl"] is None  # not itself
    assert rows[1]["fk_tbl"] is None and rows[3]["fk_tbl"] is None  # never by the name id


def test_offset_zero_shifts_types(spark):
    raw = spark.createDataFrame(DUMP, DUMP_DDL)
    types = {r["col_pos"]: r["type"] for r in catalog.flatten_dump(raw).collect()}
    assert types[1] == "text" and types[5] is None


def test_inferred_key_of_first_and_second(spark):
    rows = [("d", f"t{i}", i, "k", i) for i in range(4)] + [("d", "z", 9, "k", None)]
    cols = spark.createDataFrame(rows, "db string, tbl string, col_pos bigint, col string, pk_pos int")
    got = {r["col_pos"]: r["fk_tbl"] for r in catalog.inferred_keys(cols).collect()}
    assert got == {0: "t1", 1: "t0", 2: "t0", 3: "t0", 9: "t0"}


def label(spark, sql):
    cols = build(spark)
    st = spark.createDataFrame([(1, "shop", sql)], "qid bigint, db string, sql string")
    return sorted(
        (r["tbl"], r["col"]) for r in labelling.sql_mentions(st, cols).select("tbl", "col").collect()
        if r["col"]
    )


def test_mentions(spark):
    assert label(spark, "SELECT code FROM Item") == [("item", "code")]
    # a bare name counts for every mentioned table that has it
    assert label(spark, "select t.CODE from Item as t, sale s where s.ref = 'id from x'") == [
        ("item", "code"),
        ("sale", "code"),
        ("sale", "ref"),
    ]
    assert label(spark, 'select count(*) from main."sale" join `item` on "ref" = id -- code') == [
        ("item", "id"),
        ("sale", "id"),
        ("sale", "ref"),
    ]
    assert label(spark, "select id from (select ref, id from sale where id > 1) x") == [
        ("sale", "id"),
        ("sale", "ref"),
    ]
    assert label(spark, "select code as ref from item union select id from sale") == [
        ("item", "code"),
        ("item", "id"),
        ("sale", "code"),
        ("sale", "id"),
    ]


def test_instances_keep_unlabelled(spark):
    cols = build(spark)
    st = spark.createDataFrame(
        [(1, "shop", "q1", "select ref from sale"), (2, "shop", "q2", "select 1")],
        "qid bigint, db string, question string, sql string",
    )
    rows = labelling.instances(st, labelling.sql_mentions(st, cols)).orderBy("qid").collect()
    assert rows[0]["schema"].asDict(True) == {
        "database": "shop",
        "metadata": [{"name": "sale", "columns": ["ref"]}],
    }
    assert rows[1]["schema"]["metadata"] == []


def test_reshape_and_rejects(spark):
    raw = spark.createDataFrame(
        [("shop", " q ", " select 1\n", [1]), ("none", "q", "select 1", [1]), ("shop", "q", "select 'x", [1]),
         ("shop", "q", "drop table x", [1]), ("shop", "q", "", [1])],
        "db_id string, question string, query string, query_toks array<int>",
    )
    rec = catalog.reshape_records(raw, "finance")
    assert rec.columns == ["db", "question", "sql"]
    good, bad = catalog.split_bad_records(rec, build(spark))
    assert [(r["question"], r["sql"]) for r in good.collect()] == [("q", "select 1")]
    assert sorted(r["reason"] for r in bad.collect()) == [
        "empty sql", "not a query", "open quote", "unknown database",
    ]


def test_synonym_rule_renames_question(spark):
    raw = spark.createDataFrame([("d", "s", "a", "b")], "db_id string, query string, SpiderSynQuestion string, SpiderQuestion string")
    assert sorted(catalog.reshape_records(raw, "synonym").columns) == ["db", "question", "sql"]


def test_database_document_is_one_row(spark):
    n = 200
    rows = [("d", i, f"t{i}", f"t{i}", 0, "c", f"c{i}") for i in range(n)]
    cols = spark.createDataFrame(
        rows, "db string, tbl_pos bigint, tbl string, tbl_norm string, col_pos bigint, col string, col_norm string"
    )
    whole = "d " + " ".join(f"t{i} c{i}" for i in range(n))
    assert [r["text"] for r in render.docs_database(cols).collect()] == [whole]


def test_gold_columns_and_nesting(spark):
    cols = build(spark)
    gold = spark.createDataFrame([("shop", "sale", "ref")] * 2, "db string, tbl string, col string")
    assert [r["col"] for r in catalog.gold_columns(cols, gold).collect()] == ["ref"]
    nested = catalog.nest_catalog(cols).first()["tables"]
    assert [t["name"] for t in nested] == ["item", "sale"]
    assert [c["name"] for c in nested[1]["columns"]] == ["id", "code", "ref"]
    assert nested[1]["columns"][2]["foreign_key"].asDict() == {"table": "item", "column": "code"}


def names_in(spark, statements):
    """Per statement its names in table position and its other ones."""
    rows = [(i, "d", q) for i, q in enumerate(statements)]
    df = spark.createDataFrame(rows, "qid bigint, db string, sql string")
    out = {q: (set(), set()) for q in statements}
    for r in labelling.mentioned_names(df).collect():
        out[rows[r["qid"]][2]][0 if r["is_table"] else 1].add(r["name"])
    return out


def test_statement_shapes(spark):
    cases = {
        "FROM `air carriers` JOIN \"order details\"": {"air carriers", "order details"},
        "SELECT a FROM (SELECT b FROM t1) x, t2": {"t1", "t2"},
        "SELECT a FROM t1 JOIN t3 ON t1.a = t3.a, t2": {"t1", "t2", "t3"},
        "SELECT a -- it's here\n FROM t1 WHERE n = 'x'": {"t1"},
        "WITH c AS (SELECT 1 FROM t1) SELECT * FROM c": {"t1", "c"},
        "SELECT a FROM s.[t 1] WHERE b IN (SELECT c FROM t2 WHERE d > (SELECT max(e) FROM t3))": {
            "t 1", "t2", "t3"},
        "SELECT 'from x' FROM t1 ORDER BY a, b": {"t1"},
        "INSERT INTO t1 SELECT * FROM t2": {"t1", "t2"},
        "INSERT INTO t1 (a, b) VALUES (1, 2), (3, 4)": {"t1"},
        "UPDATE t1 SET a = 1, b = 2 WHERE c = 3": {"t1"},
        "DELETE FROM s.t1 WHERE a = 1": {"t1"},
        'SELECT a FROM "it""s" AS x, [t 2] y': {'it"s', "t 2"},
        "SELECT a FROM (t1 JOIN t2 ON t1.a = t2.b) JOIN t3 USING (c)": {"t1", "t2", "t3"},
        "SELECT a FROM t1 WHERE b IS DISTINCT FROM c": {"t1"},
        "SELECT a FROM t1 LEFT OUTER JOIN t2 z ON f(t1.a, t2.b) = 1, t4": {"t1", "t2", "t4"},
        "SELECT a FROM " + "(SELECT a FROM " * 300 + "t1" + ") x" * 300: {"t1"},
        "SELECT 'it''s FROM " + "x''" * 20000 + "' FROM t1": {"t1"},
        "": set(),
        ") FROM t1 ) (": {"t1"},
    }
    assert {q: got[0] for q, got in names_in(spark, cases).items()} == cases


def test_aliases_and_function_arguments_are_no_columns(spark):
    cases = {
        "SELECT t.a, \"b c\", count(d) FROM t1 x JOIN t2 ON x.e = t2.f WHERE g IN (SELECT h FROM t3)": {
            "a", "b c", "d", "e", "f", "g", "h"},
        "SELECT a.name cnt FROM t1 a": {"name"},
        "SELECT MAX(y) name FROM t1": {"y"},
        "SELECT CASE WHEN a = 1 THEN b ELSE c END d, e AS f, 'x' g, 1 h FROM t1": {"a", "b", "c", "e"},
        "SELECT DISTINCT a, b c FROM t1 WHERE NOT d AND e LIKE f": {"a", "b", "d", "e", "f"},
        "SELECT DISTINCT ON (a) b, c FROM t1": {"a", "b", "c"},
        "SELECT TOP 5 a, b FROM t1": {"a", "b"},
        "SELECT a + b c, -d, t.top e FROM t t": {"a", "b", "d", "top"},
        "SELECT extract(year FROM dt) FROM t1": {"dt"},
        "SELECT substring(name FROM 2), trim(both x FROM y) FROM t1": {"name", "both", "x", "y"},
        "SELECT a FROM t1 x, t2 y ORDER BY b DESC, c": {"a", "b", "c"},
        "SELECT a /* b */ FROM t1 -- c": {"a"},
    }
    # Words of the language stay; a catalog seldom has a column of such a name.
    words = {"desc", "by", "distinct", "and", "not", "like", "case", "when", "then", "else", "end", "in", "as",
             "from", "top"}
    for q, (_, got) in names_in(spark, cases).items():
        assert got - (words - cases[q]) == cases[q], q


def test_declared_pair_onto_the_pseudo_column_is_no_key(spark):
    *head, keys, pairs = DUMP[0]
    raw = spark.createDataFrame([(*head, keys, [*pairs, [5, 0], [2, 0]])], DUMP_DDL)
    rows = {r["col_pos"]: r for r in catalog.build_catalog(raw, type_offset=1).collect()}
    assert (rows[5]["fk_tbl"], rows[5]["fk_col"]) == ("item", "code")
    assert rows[2]["fk_tbl"] is None and rows[2]["fk_col"] is None


def test_tables_without_columns_stay(spark):
    *head, keys, pairs = DUMP[0]
    names = [["Item", "Empty", "Sale"], ["item", "empty one", "sale"]]
    moved = [[["2" if t == "1" else t, c] for t, c in x] for x in head[3:5]]
    raw = spark.createDataFrame([(head[0], *names, *moved, head[5], keys, pairs)], DUMP_DDL)
    tables = catalog.flatten_tables(raw)
    assert [(r["tbl_pos"], r["tbl"]) for r in tables.collect()] == [(0, "item"), (1, "empty"), (2, "sale")]
    nested = catalog.nest_catalog(catalog.build_catalog(raw, type_offset=1), tables).first()["tables"]
    assert [(t["name"], len(t["columns"])) for t in nested] == [("item", 2), ("empty", 0), ("sale", 3)]


def test_empty_schema_list_stays_empty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([], "[3]"), (["a", "b"], "[9]")], "s array<string>, r string")
    got = [r[0] for r in df.select(parsing.picked_schema(F.col("s"), F.col("r"))).collect()]
    assert got == [[], ["b"]]


def test_tokens_are_dealt_by_length_and_not_shuffled(spark, monkeypatch):
    """A task's statements are bounded before their tokens become rows."""
    monkeypatch.setattr(labelling, "CHARS_AT_ONCE", 200)
    sql = "select code from item where id in (select ref from sale)"
    statements = spark.createDataFrame(
        [(i, "shop", sql) for i in range(100)] + [(100, "shop", None), (101, None, sql)],
        "qid bigint, db string, sql string",
    )
    dealt = labelling._dealt(statements)
    assert dealt.rdd.getNumPartitions() == 101 * len(sql) // 200 + 1
    parts = labelling._in_parts(labelling._tokens(dealt))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    names = labelling.mentioned_names(statements).where("is_table").groupBy("name").count().collect()
    assert sorted((r["name"], r["count"]) for r in names) == [("item", 101), ("sale", 101)]
