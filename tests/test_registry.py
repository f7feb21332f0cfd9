import __spark_entry__ as entry
from routewright.plans import registry


def test_every_query_has_sql():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(queries) == set(oracle)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"qid", "db_pos", "db", "tables"}


def test_entry_has_all_registered_queries():
    assert set(registry.queries()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql())
