import random

import pytest

from routewright.llm import chat_snapshots as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _logs(seed=1):
    """Snapshots of a few chats, copies, a common first turn, and odd rows."""
    rng = random.Random(seed)
    rows, conv = [], 0
    for chat in range(12):
        said = [("user", "hello")] + [
            (rng.choice(["user", "assistant"]), f"t{chat % 5} {rng.randrange(3)}") for _ in range(rng.randint(0, 9))
        ]
        for n in sorted(rng.sample(range(1, len(said) + 1), rng.randint(1, len(said)))):
            start = rng.choice([0, 5, 3000])
            step = rng.choice([1, 1, 700])
            rows += [(conv, start + i * step, r, t) for i, (r, t) in enumerate(said[:n])]
            conv += 1
    rows += [(900 + i, j, "user", f"copy {j}") for i in range(30) for j in range(3)]
    rows += [(950, None, "user", "late number"), (950, 1, None, None), (950, 1, None, None), (951, 1, "user", "")]
    rows += [(None, 0, "user", "nobody"), (952, 0, "user", "copy 0"), (952, 1, "user", "copy 1")]
    return rows + [(953, 7, "b", "x"), (953, 7, "a", "x")]


def _plain(rows):
    chats = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            chats.setdefault(c, set()).add((turn is not None, turn or 0, role or "", text or ""))
    said = {c: tuple(x[2:] for x in sorted(s)) for c, s in chats.items()}
    begun = {s[:n] for s in said.values() for n in range(1, len(s))}
    kept = {}
    for c in sorted(said):
        if said[c] not in begun:
            kept.setdefault(said[c], c)
    return {c: s for s, c in kept.items()}


@pytest.mark.parametrize("run", [1024, 2])
def test_maximal_conversations_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(C, "RUN", run)
    rows = _logs()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("pos", "h1", "n", "run"):
        df = df.selectExpr("*", f"'x' as {name}")
    got = {r.conv_id: r for r in C.render(df).collect()}
    want = _plain(rows)
    assert set(got) == set(want)
    for c, said in want.items():
        assert got[c].n_turns == len(said) and got[c].part == 0
        assert got[c].text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in said)


def test_long_conversations_are_rendered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 4)
    rows = [(1, i, "user", str(i)) for i in range(10)] + [(2, i, "user", str(i)) for i in range(9)]
    got = C.render(spark.createDataFrame(rows, SCHEMA)).orderBy("part").collect()
    assert [(r.conv_id, r.part, r.text.count("<|im_start|>")) for r in got] == [(1, 0, 4), (1, 1, 4), (1, 2, 2)]


def test_without_rows(spark):
    assert C.render(spark.createDataFrame([], SCHEMA)).count() == 0
