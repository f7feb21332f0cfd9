from collections import Counter, defaultdict

import numpy as np
import rows as R
from test_near_dup import _plain as near_groups
from tokenizers import Tokenizer

import corpus_pipeline as C
from routewright.llm import packing as P

TOKENIZER = Tokenizer.from_file(P.VOCABULARY)


def _write(spark, tmp_path, docs):
    path = str(tmp_path)
    spark.createDataFrame(docs, R.SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_every_stage_follows_its_input(spark, tmp_path):
    docs = [d for d in R.documents(n=120)]
    path = _write(spark, tmp_path, docs)
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        before = now
        stage(spark, now, path).write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == before.columns
    # Blanks go, and the text of 2004, whose letters were not learned.
    letters = [d for d in docs if any(c.isalpha() for c in d[1] or "") and d[0] != 2004]
    assert Counter(tuple(r) for r in seen["language_id"]) == Counter(letters)
    assert Counter(r.text for r in seen["exact_dedup"]) == Counter({d[1]: 1 for d in letters})
    rows = [tuple(r) for r in seen["exact_dedup"]]
    _, groups = near_groups(rows)
    assert len(seen["near_dedup"]) == len(set(groups))
    stay = {r.text for r in seen["near_dedup"]}
    assert all(any(rows[j][1] in stay for j in range(len(rows)) if groups[j] == g) for g in groups)
    copies = Counter(r.text for r in seen["mixing"])
    assert set(copies) <= stay and max(copies.values()) <= 3
    _check_mix(seen["near_dedup"], copies)
    # Every copy that the mix takes is packed whole, in pieces of its own ids.
    pieces, whole = defaultdict(list), Counter()
    for r in seen["packing"]:
        pieces[r.doc_id].append(r)
        whole[r.doc_id] += r.length
    rows = {r.doc_id: r for r in seen["mixing"]}
    times = Counter(r.doc_id for r in seen["mixing"])
    for i, r in rows.items():
        ids = [*encoded(r.text), P.END_ID]
        assert whole[i] == times[i] * len(ids)
        for p in pieces[i]:
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length]
    assert set(whole) == set(rows)


def encoded(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def _check_mix(before, copies):
    """Words taken of each source against the shares 5, 2, 1 with ceilings at 3 times its size."""
    size, largest = Counter(), Counter()
    for r in before:
        n = len(R.words(r.text))
        size[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 3 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    taken = Counter()
    for r in before:
        taken[r.source] += copies[r.text] * len(R.words(r.text))
    for s in names:
        assert abs(taken[s] - goal[s]) <= largest[s]


def test_extra_columns_with_clashing_names_do_no_harm(spark, tmp_path):
    path = str(tmp_path)
    R.clashing(spark.createDataFrame(R.documents(n=30), R.SCHEMA)).write.parquet(f"{path}/documents.parquet")
    plain = _write(spark, tmp_path / "plain", R.documents(n=30))
    names = ["doc_id", "start", "length", "doc_tokens"]
    got, wanted = (C.run(spark, p).select(names).collect() for p in (path, plain))
    assert Counter(map(tuple, got)) == Counter(map(tuple, wanted)) and got


def test_run_is_all_stages(spark, tmp_path):
    path = _write(spark, tmp_path, R.documents(n=30))
    assert C.run(spark, path).columns[:4] == ["doc_id", "start", "length", "doc_tokens"]


def test_without_rows(spark, tmp_path):
    assert C.run(spark, _write(spark, tmp_path, [])).count() == 0
