import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from routewright.operators import graph, synth


def fixture(spark, seed=1, n_db=3, n_tbl=9):
    """Random foreign keys; some table pairs share several keys."""
    rng = random.Random(seed)
    rows = []
    for d in range(n_db):
        for i in range(n_tbl):
            for c in range(3):
                target = rng.randrange(n_tbl) if rng.random() < 0.6 else None
                rows.append(
                    (f"d{d}", i, f"t{i}", c, f"c{c}", None if target is None else f"t{target}",
                     None if target is None else f"c{rng.randrange(2)}")
                )
    cols = spark.createDataFrame(
        rows, "db string, tbl_pos int, tbl string, col_pos int, col string, fk_tbl string, fk_col string"
    )
    groups = collections.defaultdict(set)
    for db, _, tbl, _, _, ft, fc in rows:
        if ft:
            groups[db, f"{ft}.{fc}"] |= {tbl, ft}
    near = collections.defaultdict(set)
    for (db, _), tables in groups.items():
        for a in tables:
            near[db, a] |= tables - {a}
    return cols, graph.clique_members(cols), near


def test_cliques_and_pairs(spark):
    cols, members, near = fixture(spark)
    tables = [f"t{i}" for i in range(9)]
    pairs = [(f"d{d}", a, b) for d in range(3) for a in tables for b in tables]
    df = spark.createDataFrame(pairs, "db string, a string, b string")
    got = {(r["db"], r["a"], r["b"]) for r in graph.linked_pairs(df, members).collect()}
    assert got == {(db, a, b) for db, a, b in pairs if b in near[db, a]}
    size = {(r["db"], r["key"]): r["n_edges"] for r in graph.clique_sizes(members).collect()}
    assert all(n >= 2 for n in size.values())


def test_neighbours_and_frontier(spark):
    cols, members, near = fixture(spark)
    states = spark.createDataFrame(
        [(1, None, None), (2, "d0", None), (3, "d1", "t0"), (3, "d1", "t4"), (4, "d2", "t2")],
        "sid bigint, db string, tbl string",
    )
    rows = graph.frontier(states, cols, members).collect()
    assert {r["nxt"] for r in rows if r["sid"] is None and r["db"] is None} == {"d0", "d1", "d2"}
    assert {r["nxt"] for r in rows if r["sid"] is None and r["db"] == "d0"} == {f"t{i}" for i in range(9)}
    assert {r["nxt"] for r in rows if r["sid"] == 3} == (near["d1", "t0"] | near["d1", "t4"]) - {"t0", "t4"}
    assert {r["nxt"] for r in rows if r["sid"] == 4} == near["d2", "t2"]


def test_frontier_without_listing_it(spark):
    """Sizes, draws and membership of states of one to four tables."""
    cols, members, near = fixture(spark, seed=4)
    rng = random.Random(6)
    states = {i: (f"d{rng.randrange(3)}", rng.sample([f"t{j}" for j in range(9)], rng.randrange(1, 5))) for i in range(60)}
    rows = [(i, db, x) for i, (db, xs) in states.items() for x in xs]
    chosen = spark.createDataFrame(rows, "sid bigint, db string, tbl string")
    want = {i: set().union(*(near[db, x] for x in xs)) - set(xs) for i, (db, xs) in states.items()}
    places = graph.clique_places(members, least=1).cache()
    spans = graph.frontier_spans(chosen, places).cache()
    sizes = {r["sid"]: r["n"] for r in graph.frontier_sizes(spans).collect()}
    assert all(sizes.get(i, 0) == len(w) for i, w in want.items())
    drawn = collections.defaultdict(collections.Counter)
    for seed in range(12):
        for r in graph.frontier_draws(spans, places, str(seed)).collect():
            assert r["nxt"] in want[r["sid"]]
            drawn[r["sid"]][r["nxt"]] += 1
    assert set(drawn) == {i for i, w in want.items() if w}
    assert sum(len(c) for c in drawn.values()) > 0.7 * sum(min(12, len(w)) for w in want.values())
    asked = spark.createDataFrame(
        [(i, db, f"t{j}") for i, (db, _) in states.items() for j in range(9)], "sid bigint, db string, nxt string"
    )
    held = collections.defaultdict(set)
    for r in graph.frontier_holds(asked, chosen, members).collect():
        held[r["sid"]].add(r["nxt"])
    assert all(held[i] == w for i, w in want.items())


def test_frontier_of_a_giant_clique_has_a_row_per_key(spark):
    members = spark.range(20_000).select(
        F.lit("g").alias("db"), F.struct(F.lit("hub").alias("fk_tbl"), F.lit("id").alias("fk_col")).alias("key"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("tbl"), F.lit(20_000).cast("bigint").alias("size"),
    )
    chosen = members.where("tbl in ('t1', 't7', 't9')").select(F.lit(1).cast("bigint").alias("sid"), "db", "tbl")
    spans = graph.frontier_spans(chosen, graph.clique_places(members, least=1))
    row, = spans.collect()
    assert (row["lo"], row["hi"], len(row["skips"])) == (0, 19_997, 3)


def test_check_routes(spark):
    cols, members, near = fixture(spark, seed=2)
    rng = random.Random(5)
    routes = {i: (f"d{rng.randrange(3)}", [f"t{rng.randrange(10)}" for _ in range(rng.randrange(1, 4))]) for i in range(60)}
    steps = [(i, db, p, t) for i, (db, ts) in routes.items() for p, t in enumerate(ts)]
    df = spark.createDataFrame(steps, "rid bigint, db string, pos int, tbl string")
    got = {r["rid"]: r["valid"] for r in graph.check_routes(df, cols, members).collect()}

    def valid(db, ts):
        for p, t in enumerate(ts):
            if t == "t9" or t in ts[:p] or (p and not any(t in near[db, o] for o in ts[:p])):
                return False
        return True

    assert got == {i: valid(db, ts) for i, (db, ts) in routes.items()}
    assert set(got.values()) == {True, False}


def test_serialise_is_depth_first(spark):
    cols, members, near = fixture(spark, seed=3)
    mentions = spark.createDataFrame(
        [(q, f"d{q % 3}", i, f"t{i}") for q in range(6) for i in range(q % 3, 9, 2)],
        "qid bigint, db string, tbl_pos int, tbl string",
    )
    for seed in (None, "x"):
        for r in graph.serialise(mentions, members, "|", seed).collect():
            db, *order = r["text"].split("|")
            own = {f"t{i}" for i in range(r["qid"] % 3, 9, 2)}
            assert db == f"d{r['qid'] % 3}" and set(order) == own and len(order) == len(own)
            # a table that follows another and is not its neighbour closes all its open neighbours
            for i in range(1, len(order)):
                if order[i] not in near[db, order[i - 1]]:
                    assert not (near[db, order[i - 1]] & own) - set(order[: i])


def test_labels(spark):
    got = spark.range(1).select(graph.deserialise(F.lit("db<sep> t1<sep>t2"), "<sep>").alias("s")).first()["s"]
    assert (got["database"], got["tables"]) == ("db", ["t1", "t2"])
    alone = spark.range(1).select(graph.deserialise(F.lit("db"), "<sep>").alias("s")).first()["s"]
    assert alone["tables"] == []
    index = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")], "tbl string, db string")
    labels = spark.createDataFrame(
        [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "a"), (3, 0, "nope")], "qid bigint, pos int, tbl string"
    )
    voted = {r["qid"]: r["db"] for r in graph.vote_database(labels, index).collect()}
    assert voted == {1: "y", 2: "z", 3: ""}


def test_votes_with_heavy_names(spark):
    rng = random.Random(11)
    has = {f"t{i}": sorted(rng.sample(range(30), 28 if i < 3 else rng.randrange(1, 5))) for i in range(12)}
    index = spark.createDataFrame([(t, f"d{d:02}") for t, ds in has.items() for d in ds], "tbl string, db string")
    lists = {q: [f"t{rng.choice([0, 1, 2, *range(13)])}" for _ in range(rng.randrange(1, 6))] for q in range(80)}
    labels = spark.createDataFrame([(q, p, t) for q, ts in lists.items() for p, t in enumerate(ts)], "qid bigint, pos int, tbl string")
    want = {}
    for q, ts in lists.items():
        votes, seen = collections.Counter(), {}
        for p, t in enumerate(ts):
            for d in has.get(t, ()):
                votes[f"d{d:02}"] += 1
                seen.setdefault(f"d{d:02}", p)
        want[q] = min(votes, key=lambda d: (-votes[d], seen[d], d)) if votes else ""
    assert {r["qid"]: r["db"] for r in graph.vote_database(labels, index).collect()} == want


def test_widespread_names_are_not_listed_where_others_outvote_them(spark):
    """"id" is in every database; two rare tables of one database settle the list."""
    index = [("id", f"d{i}") for i in range(2000)] + [("a", "d7"), ("b", "d7"), ("a", "d9")]
    lists = spark.createDataFrame([(["a", "b", "id"],), (["id"],)], "names array<string>")
    index = spark.createDataFrame(index, "tbl string, db string")
    known = graph.listed_names(lists, index)
    floors = spark.createDataFrame([(["a", "b", "id"], 3), (["id"], 1)], "names array<string>, floor int")
    opened = {(tuple(r.names), r.tbl) for r in graph.opening_names(known, floors).collect()}
    assert opened == {(("a", "b", "id"), "b"), (("id",), "id")}
    got = {tuple(r.names): r.db for r in graph.best_of_lists(lists, index).collect()}
    assert got == {("a", "b", "id"): "d7", ("id",): "d0"}


def walk_rows(spark, cols, members, n=3000, walk_len=8, **options):
    starts = spark.range(n).withColumnRenamed("id", "walk_id")
    return synth.random_walks(starts, cols, members, walk_len, **options).collect()


def check_walks(rows, near, n, walk_len):
    assert len(rows) == n
    first, nxt = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in rows:
        path = r["path"]
        first[r["db"], path[0]] += 1
        for a, b in zip(path, path[1:]):
            assert b in near[r["db"], a]
            nxt[r["db"], a][b] += 1
        assert len(path) == walk_len - 2 or not near[r["db"], path[-1]]
    assert len(first) == 27 and min(first.values()) > n / 27 * 0.6
    for node, seen in nxt.items():
        total, degree = sum(seen.values()), len(near[node])
        if total > 400:  # every distinct neighbour has the same chance
            assert set(seen) == near[node]
            expected = total / degree
            chi = sum((c - expected) ** 2 / expected for c in seen.values())
            assert chi < degree + 6 * (2 * degree) ** 0.5 + 6


def test_walks_visit_distinct_neighbours_alike(spark):
    cols, members, near = fixture(spark, seed=7)
    check_walks(walk_rows(spark, cols, members), near, 3000, 8)


def test_giant_clique_does_not_change_other_walks(spark):
    """One key that 400 tables share, in a database of its own."""
    cols, members, near = fixture(spark, seed=7)
    n = 400
    more = spark.createDataFrame(
        [("giant", i, f"g{i}", 0, "c", "g0", "id") for i in range(n)],
        "db string, tbl_pos bigint, tbl string, col_pos bigint, col string, fk_tbl string, fk_col string",
    )
    starts = spark.range(300).withColumnRenamed("id", "walk_id")
    small = synth._starts(starts, cols, "walk")
    walks = synth.random_walks(starts, more, graph.clique_members(more), 6).collect()
    assert len(walks) == 300 and all(len(r["path"]) == 4 for r in walks)
    assert all(a != b for r in walks for a, b in zip(r["path"], r["path"][1:]))
    assert len({t for r in walks for t in r["path"]}) > 300
    # The same starts walk the same way whether or not the giant is there.
    alone = synth.walk_from(small, members, 6).collect()
    both = synth.walk_from(small, members.unionByName(graph.clique_members(more)), 6).collect()
    assert sorted(alone) == sorted(both)


def test_walks_return_or_wander_as_weighted(spark):
    """A ring with a chord: back, near and far steps by their weights."""
    ring = [("r", i, f"t{i}", j, "c", f"t{k}", f"k{i}{k}") for i in range(6)
            for j, k in enumerate([(i + 1) % 6, (i + 2) % 6])]
    cols = spark.createDataFrame(
        ring, "db string, tbl_pos bigint, tbl string, col_pos bigint, col string, fk_tbl string, fk_col string"
    )
    members = graph.clique_members(cols)
    near = {i: {(i + d) % 6 for d in (1, 2, -1, -2)} for i in range(6)}
    kinds = collections.Counter()
    for r in walk_rows(spark, cols, members, n=3000, walk_len=6, p=0.25, q=4.0):
        path = [int(t[1:]) for t in r["path"]]
        for a, b, c in zip(path, path[1:], path[2:]):
            kinds["back" if c == a else "near" if c in near[a] else "far"] += 1
    shares = {k: n / sum(kinds.values()) for k, n in kinds.items()}
    # Of four neighbours one is the last table; two or one are linked with it too.
    weights = collections.Counter()
    for a in range(6):
        for b in near[a]:
            w = {c: 4.0 if c == a else 1.0 if c in near[a] else 0.25 for c in near[b]}
            for c, x in w.items():
                weights["back" if c == a else "near" if c in near[a] else "far"] += x / sum(w.values()) / 24
    for k, w in weights.items():
        assert abs(shares.get(k, 0) - w) < 0.03


def test_walks_do_not_depend_on_partitioning(spark):
    cols, members, _ = fixture(spark)
    a = walk_rows(spark, cols.repartition(1), members.repartition(1), 200)
    b = walk_rows(spark, cols.repartition(17), members.repartition(17), 200)
    assert sorted(a) == sorted(b)


def test_numbering_is_dense(spark):
    from routewright.functions.positions import number_rows

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("x"))
    rows = number_rows(df, ["g"], "x", "no").collect()
    for g in range(3):
        numbers = sorted(r["no"] for r in rows if r["g"] == g)
        assert numbers == list(range(len(numbers)))


def test_votes_carry_no_lists_and_count_once(spark, monkeypatch):
    """A list goes by its number; where its rarest name settles it, nothing is counted again."""
    seen, counted = [], graph._best_votes
    monkeypatch.setattr(graph, "_best_votes", lambda *a: seen.append(a[0]) or counted(*a))
    index = spark.createDataFrame(
        [(f"t{i}", f"d{i // 3}") for i in range(30)] + [(f"t{i}", f"d{i % 7}x") for i in range(30)], "tbl string, db string"
    )
    lists = spark.createDataFrame([([f"t{i}", f"t{i + 1}", f"t{i + 2}"],) for i in range(0, 30, 3)], "names array<string>")
    got = {r.names[0]: r.db for r in graph.best_of_lists(lists, index).collect()}
    assert got == {f"t{i}": f"d{i // 3}" for i in range(0, 30, 3)}
    assert all("names" not in x.columns for x in seen)
    assert seen[0].count() == 20 and seen[1].count() == 0


@pytest.mark.parametrize("paired", [0, 3, 16])
def test_votes_beside_the_rarest_name(spark, monkeypatch, paired):
    """Only databases with another name of the list are counted, however many names they have."""
    monkeypatch.setattr(graph, "PAIRED", paired)
    rng = random.Random(21)
    rows = {(f"t{rng.randrange(14)}", f"d{d:02}") for d in range(25) for _ in range(rng.randrange(1, 8))}
    index = spark.createDataFrame(sorted(rows) + [("t1", None)], "tbl string, db string")
    lists = [tuple(f"t{rng.randrange(16)}" for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    named = spark.createDataFrame([(list(x),) for x in sorted(set(lists))], "names array<string>")
    beside, real = [], graph._beside
    monkeypatch.setattr(graph, "_beside", lambda *a: beside.append((a[0], real(*a))) or beside[-1][1])
    got = {tuple(x.names): x.db for x in graph.best_of_lists(named, index).collect()}
    want = {}
    for x in set(lists):
        votes = {d: [(-x.count(t), x.index(t)) for t in set(x) if (t, d) in rows] for _, d in rows}
        best = min(((sum(v for v, _ in w), min(i for _, i in w), d) for d, w in votes.items() if w), default=None)
        if best:
            want[x] = best[2]
    assert got == want
    rarest, found = beside[0][0].collect(), beside[0][1].collect()
    dbs = {x.lid: {d for t, d in rows if t == x.tbl} for x in rarest}
    assert all(x.db in dbs[x.lid] for x in found) and len(found) < sum(map(len, dbs.values()))


def test_kinds_are_numbered_side_by_side(spark):
    from routewright.functions.positions import number_rows

    rng = random.Random(5)
    rows = [(g, sorted(rng.sample("abc", rng.randrange(3))), f"x{i}") for i in range(200) for g in ("u", "v")]
    df = spark.createDataFrame(rows, "g string, kind array<string>, x string")
    found = number_rows(df, ["g"], "x", "no", kind="kind")
    # The rows, their slices' sizes and those by group, which serve the numbers and the kinds' places.
    assert found._jdf.queryExecution().executedPlan().toString().count(" Exchange ") <= 4
    got = found.collect()
    for g in "uv":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.no)
        assert [r.no for r in mine] == list(range(200))
        places = {}
        for r in mine:
            places.setdefault(tuple(r.kind), []).append(r.no)
            by_hash = [(hashlib.md5(y.x.encode()).hexdigest()[:2], y.x) for y in mine if y.kind == r.kind]
            assert by_hash == sorted(by_hash)
        assert list(places) == sorted(places)
        assert all((r.lo, r.n) == (places[tuple(r.kind)][0], len(places[tuple(r.kind)])) for r in mine)


def test_walks_from_rows_are_those_by_key(spark, monkeypatch):
    """A database of few members is walked in one row, with no join per step."""
    cols, members, _ = fixture(spark, seed=5, n_db=4, n_tbl=8)
    bare = spark.createDataFrame(
        [("d0", 0, None, 0, "c0", "t1", "c0"), ("e", 0, "alone", 0, "c0", None, None)], cols.schema
    )
    odd = graph.clique_members(cols.unionByName(bare))
    begun = spark.range(300).select(
        F.col("id").alias("walk_id"),
        F.concat(F.lit("d"), F.col("id") % 5).alias("db"),
        F.concat(F.lit("t"), F.col("id") % 9).alias("tbl"),
    )
    steps = []
    real = synth._step
    monkeypatch.setattr(synth, "_step", lambda *a: steps.append(1) or real(*a))
    for named, p, q in ((members, 1.0, 1.0), (members, 0.5, 2.0), (odd, 2.0, 0.5)):
        walks = []
        for most in (64, 0):
            monkeypatch.setattr(synth, "GATHERED", most)
            monkeypatch.setattr(synth, "PROPOSALS", 1)
            steps.clear()
            rows = synth.walk_from(begun, named, 9, p=p, q=q).collect()
            walks.append(sorted((r["walk_id"], r["db"], r["path"]) for r in rows))
            assert bool(steps) == (most == 0 or named is odd)
        assert walks[0] == walks[1] and len(walks[0]) == 300
        assert max(len(path) for _, _, path in walks[0]) == 7
