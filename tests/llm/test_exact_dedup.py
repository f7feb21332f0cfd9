import hashlib
from collections import Counter, defaultdict

import rows as R

from routewright.llm import exact_dedup as E


def _plain(docs):
    ids = defaultdict(list)
    for d in docs:
        ids[d[1] or ""].append(d[0])
    out = []
    for text, members in ids.items():
        known = [m for m in members if m is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for m in members:
            kept = m == keep and left > 0
            left -= kept
            out.append((m, keep, len(members), kept, sha))
    return Counter(out)


def test_groups_equal_brute_force(spark):
    docs = R.documents()
    df = R.clashing(spark.createDataFrame(docs, R.SCHEMA).repartition(5))
    assert Counter(tuple(r) for r in E.exact_dedup(df).collect()) == _plain(docs)


def test_ties_of_a_frequent_text_leave_one(spark):
    docs = [(7, "same", None, None, None)] * 30 + [(3, "same", None, None, None)] * 5
    got = E.exact_dedup(spark.createDataFrame(docs, R.SCHEMA)).collect()
    assert sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {7}


def test_drop_keeps_columns_and_one_of_each(spark):
    docs = R.documents()
    df = R.clashing(spark.createDataFrame(docs, R.SCHEMA))
    got = E.drop_copies(df)
    assert got.columns == df.columns
    assert Counter(r.text or "" for r in got.collect()) == Counter({(d[1] or ""): 1 for d in docs})


def test_without_rows(spark):
    empty = spark.createDataFrame([], R.SCHEMA)
    assert E.exact_dedup(empty).count() == 0 and E.drop_copies(empty).count() == 0
