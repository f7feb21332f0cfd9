"""Catalogs and contexts that are put together inside rows."""

from routewright.operators import catalog, context
from routewright.operators import graph as g
from routewright.plans import synthesis, tables
from routewright.sources.readers import DUMP_DDL

_NAMES = [["-1", "*"], ["0", "ID"], ["0", "Code"], ["1", "ID"], ["1", "Code"], ["1", "Ref"], ["1", "Code"]]


def _dump(db, keys, pairs):
    return (db, ["Item", "Sale"], ["item", "sale"], _NAMES, _NAMES, list("ntntnt"), keys, pairs)


def _rows(df):
    return sorted(df.collect(), key=repr)


ROWS = [
    _dump("a", ["1", "[2, 4]"], [[5, 1], [5, 2], [1, 0]]),
    _dump("b", ["[6, 2]", "4", "0", "99"], [[2, 4]]),
    _dump("c", ["7"], [[6, 3], [6, 5]]),
    _dump(None, ["2", "4"], [[5, 2]]),
    _dump("d", [], []),
]


def test_keys_are_looked_up_without_a_shuffle_and_alike(spark, monkeypatch):
    raw = spark.createDataFrame(ROWS, DUMP_DDL)
    inside = catalog.build_catalog(raw, type_offset=1)
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
    got = _rows(inside)
    monkeypatch.setattr(catalog, "ROW_LOOKUPS", -1)  # every row counts as large
    assert _rows(catalog.build_catalog(raw, type_offset=1)) == got
    a = {r["col_pos"]: (r["is_pk"], r["fk_tbl"], r["fk_col"]) for r in got if r["db"] == "a"}
    assert a[2] == (True, "sale", "code") and a[4] == (True, "item", "code") and a[5] == (False, "item", "code")


def test_databases_of_several_rows_are_merged(spark):
    raw = spark.createDataFrame([*ROWS, _dump("a", ["3"], [[5, 4]])], DUMP_DDL)
    got = [r for r in _rows(catalog.build_catalog(raw, type_offset=1)) if r["db"] == "a"]
    assert [r["col_pos"] for r in sorted(got, key=lambda r: r["col_pos"])] == [1, 2, 3, 4, 5, 6]
    once = catalog.build_catalog(spark.createDataFrame(ROWS, DUMP_DDL), type_offset=1)
    others = [r for r in _rows(catalog.build_catalog(raw, type_offset=1)) if r["db"] != "a"]
    assert others == [r for r in _rows(once) if r["db"] != "a"]


def test_clique_members_take_one_shuffle(spark):
    rows = [("x", "t", "t", "k"), ("x", "u", "t", "k"), ("x", "u", "t", "k"), ("y", "t", "t", "k"), (None, "u", "t", "k")]
    columns = spark.createDataFrame(rows, "db string, tbl string, fk_tbl string, fk_col string")
    members = g.clique_members(columns)
    assert members._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r["db"], r["tbl"], r["size"]) for r in members.collect()) == [("x", "t", 2), ("x", "u", 2)]


def test_a_context_is_gathered_twice_and_keeps_odd_rows(spark):
    rows = [
        (1, 1, "b", 0, "t", 2, "y"), (1, 1, "b", 0, "t", 1, "x"), (1, 1, "b", 1, "t", 3, "z"),
        (1, 0, "a", None, "gone", None, None), (1, 2, "b", 0, "t", 1, "x"), (1, 2, "b", 0, "t", 1, "x"),
        (1, 3, "c", 0, "empty", None, None), (2, 0, None, None, None, None, None),
    ]
    ddl = "qid bigint, schema_pos int, db string, tbl_pos bigint, tbl string, col_pos bigint, col string"
    nested = context.nest_context(spark.createDataFrame(rows, ddl))
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("ObjectHashAggregate") == 4  # two steps, each in two parts
    got = {
        r["qid"]: [(s["name"], [(t["name"], t["columns"]) for t in s["tables"]]) for s in r["schemas"]]
        for r in nested.collect()
    }
    assert got == {
        1: [("a", []), ("b", [("t", ["x", "y"]), ("t", ["z"])]), ("b", [("t", ["x", "x"])]), ("c", [("empty", [])])],
        2: [(None, [])],
    }


def test_synthetic_schemas_write_one_dump(spark, tmp_path, monkeypatch):
    """The histogram, the walks and the drawn columns read the same dump."""
    lines = [(o, i, o * 10 + i, i % 2, "NRA"[i % 3], "FO"[o % 2], 0.05) for o in (1, 2, 3) for i in (1, 2, 3, 4)]
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    kinds = "l_returnflag string, l_linestatus string, l_tax double"
    spark.createDataFrame(lines, f"{names}, {kinds}").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    written, dump = [], tables.schema_dump
    monkeypatch.setattr(tables, "schema_dump", lambda *a: written.append(a) or dump(*a))
    drawn = synthesis.draw_columns(spark, str(tmp_path)).collect()
    assert len(written) == 1
    assert {x["db"] for x in drawn} <= {"o1", "o2", "o3"}
    assert len(synthesis.assemble_synthetic(spark, str(tmp_path)).collect()) == 3
    assert len(written) == 2
