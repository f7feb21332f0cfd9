from collections import Counter, defaultdict

import pytest
import rows as R

from routewright.llm import mixing as M


def _targets(sizes: dict, weights=(5.0, 2.0, 1.0)) -> dict:
    """Share by weight, stop at three times, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_targets_and_whole_copies(spark):
    docs = [d for d in R.documents(n=600) if d[0] not in (2005, 2006)]
    got = M.mix_sources(spark.createDataFrame(docs, R.SCHEMA).repartition(4)).collect()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(R.words(d[1]))
    want = _targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(
        (d[0], d[3], len(R.words(d[1]))) for d in docs
    )
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 80, (s, taken[s], t)


def test_large_documents_do_not_miss_the_target(spark):
    docs = [(i, "w " * (5000 if i == 0 else 20), "en", f"s{i % 3}", 1) for i in range(3000)]
    got = M.mix_sources(spark.createDataFrame(docs, R.SCHEMA)).collect()
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 20


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(R.documents(n=300), R.SCHEMA)
    runs = [sorted(map(str, M.mix_sources(df.repartition(n)).collect())) for n in (1, 6)]
    assert runs[0] == runs[1]


def test_chances_are_kept():
    import numpy as np
    import pyarrow as pa

    total = np.zeros(40)
    for seed in range(400):
        rng = np.random.default_rng(seed)
        block = pa.table(
            {
                "size": pa.array([900] + [10] * 39),
                "tie": pa.array(rng.permutation(40) + seed * 1000),
                "frac": pa.array([0.3] * 40),
                "block": pa.array([0] * 40),
            }
        )
        total += M._round_block(block, True)["frac"].to_numpy()
    assert abs(total[0] / 400 - 0.3) < 0.08 and abs(total[1:].mean() / 400 - 0.3) < 0.03


def test_mix_takes_effect(spark):
    docs = R.documents(n=300)
    df = R.clashing(spark.createDataFrame(docs, R.SCHEMA))
    got = M.apply_mix(df)
    assert got.columns == df.columns
    copies = Counter()
    for r in M.mix_sources(df).collect():
        copies[(r.doc_id, r.source, r.size)] += r.copies
    assert Counter((r.doc_id, r.source, len(R.words(r.text))) for r in got.collect()) == +copies


def test_without_rows_or_words(spark):
    assert M.mix_sources(spark.createDataFrame([], R.SCHEMA)).count() == 0
    assert M.apply_mix(spark.createDataFrame([], R.SCHEMA)).count() == 0
    blank = [(1, "", "en", "a", 0), (2, None, "en", None, 0)]
    got = M.mix_sources(spark.createDataFrame(blank, R.SCHEMA)).collect()
    assert [(r.size, r.target, r.copies * r.size) for r in got] == [(0, 0.0, 0)] * 2
