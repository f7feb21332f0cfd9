"""Synthetic schemas: histograms, random walks over the schema graph, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.functions.draws import draw_below, unit_draw
from routewright.functions.positions import number_rows
from routewright.operators.graph import clique_places
from routewright.session import cut_lineage

# Proposals that one job makes for every walk.
STEPS_AT_ONCE = 8
# A database of at most so many clique members is walked from one row, which lists
# fewer than GATHERED times its members as neighbours; others go key by key.
GATHERED = 64
# Proposals per table of a walk in one pass over such rows, where weights thin them out.
PROPOSALS = 4


def cardinalities(instances: DataFrame) -> DataFrame:
    """(what, size, n): tables per question and columns per mentioned table."""
    metadata = F.col("schema.metadata")
    sizes = F.concat(
        F.array(F.struct(F.lit("table").alias("what"), F.size(metadata).alias("size"))),
        F.transform(
            metadata,
            lambda t: F.struct(F.lit("column").alias("what"), F.size(t["columns"]).alias("size")),
        ),
    )
    return (
        instances.select(F.inline(sizes))
        .groupBy("what", "size")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def max_tables(instances: DataFrame) -> DataFrame:
    """One row: the largest number of tables, and the walk length it asks for."""
    top = F.max(F.size("schema.metadata"))
    return instances.agg(top.alias("max_tables"), (2 + 2 * top).alias("walk_len"))


def weighted_draw(
    df: DataFrame, histogram: DataFrame, what: str, out: str, *key: Column | str
) -> DataFrame:
    """Add ``out``, a size drawn with the histogram's weights.

    The histogram has one row per distinct size, so its running sums fit in one
    scalar subquery.
    """
    running = F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    steps = (
        histogram.where(F.col("what") == what)
        .select("size", running.alias("hi"))
        .agg(F.sort_array(F.collect_list(F.struct("hi", "size"))).alias("steps"))
    ).scalar()
    total = F.element_at("_steps", -1)["hi"]
    return (
        df.withColumn("_steps", steps)
        .withColumn("_draw", draw_below(total, *key))
        .withColumn(out, F.get(F.filter("_steps", lambda s: s["hi"] > F.col("_draw")), F.lit(0))["size"])
        .drop("_steps", "_draw")
    )


def _lines(places: DataFrame) -> DataFrame:
    """(db, tbl, lines, total): each table with its distinct neighbours on one line.

    ``lines`` holds (key, lo, hi, skips) in key order: [lo, hi) are the members of
    the key that share no smaller key with the table, and ``skips`` the slots of
    the others and of the table itself. So one number in [0, total) names one
    distinct neighbour, and no pair of tables is listed: those to be skipped are
    found by ``low``. A table has at most as many keys as columns take part in.
    """
    kinds = places.select("db", "key", "low", "lo", "n").distinct()
    each = kinds.where(F.size("low") > 0).withColumn("x", F.explode("low"))
    met = (
        each.select("db", "key", "low", "x")
        .join(each.select("db", "key", "x", "lo", "n"), ["db", "key", "x"])
        .groupBy("db", "key", "low")
        .agg(F.sort_array(F.collect_set(F.struct("lo", "n"))).alias("met"))
    )
    itself = F.array(F.struct(F.col("slot").alias("lo"), F.lit(1).cast("bigint").alias("n")))
    skips = F.coalesce("met", itself)
    left = F.col("size") - F.aggregate("skips", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    upto = Window.partitionBy("db", "tbl").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    laid = (
        places.select("db", "key", "tbl", "size", "low", "slot")
        .join(met, ["db", "key", "low"], "left")
        .withColumn("skips", skips)
        .withColumn("left", left)
        .withColumn("hi", F.sum("left").over(upto))
        .withColumn("lo", F.col("hi") - F.col("left"))
    )
    return laid.groupBy("db", "tbl").agg(
        F.sort_array(F.collect_list(F.struct("key", "lo", "hi", "skips"))).alias("lines"),
        F.max("hi").alias("total"),
    )


def _starts(starts: DataFrame, columns: DataFrame, seed: str) -> DataFrame:
    """(walk_id, db, tbl): a database by equal chance, then one of its tables."""
    tables = cut_lineage(
        number_rows(columns.select("db", "tbl").distinct(), ["db"], "tbl", "tbl_no")
    )
    dbs = number_rows(tables.groupBy("db").agg(F.count(F.lit(1)).alias("n_tbl")), [], "db", "db_no")
    n_dbs = tables.agg(F.countDistinct("db").alias("n")).scalar()
    at_db = starts.select(
        "walk_id", draw_below(n_dbs, F.lit(seed), "walk_id", F.lit("db")).alias("db_no")
    ).join(dbs, "db_no")
    return (
        at_db.withColumn("tbl_no", draw_below(F.col("n_tbl"), F.lit(seed), "walk_id", F.lit("tbl")))
        .join(tables, ["db", "tbl_no"])
        .select("walk_id", "db", "tbl")
    )


def _step(state: DataFrame, places: DataFrame, most: int, p: float, q: float, seed: str) -> DataFrame:
    """One proposal per unfinished walk: a distinct neighbour by equal chance.

    With equal weights it is always taken. Else ``p`` and ``q`` thin the
    proposals out; how many that takes depends on the weights, not on the graph.
    """
    going = (F.size("path") < most) & (F.col("total") > 0)
    pick = draw_below(F.col("total"), F.lit(seed), "walk_id", F.size("path"), "attempt")
    at = F.get(
        F.filter("lines", lambda x: (x["lo"] <= F.col("pick")) & (F.col("pick") < x["hi"])), F.lit(0)
    )
    slot = F.aggregate(
        "at.skips",
        F.col("pick") - F.col("at.lo"),
        lambda r, x: r + F.when(r >= x["lo"], x["n"]).otherwise(0),
    )
    # Finished walks look for a place that no key has, each its own.
    aimed = (
        state.withColumn("pick", F.when(going, pick))
        .withColumn("at", at)
        .withColumn("key", F.col("at.key"))
        .withColumn("slot", F.coalesce(slot, -1 - F.pmod(F.xxhash64("walk_id"), F.lit(1 << 20))))
    )
    if p == q == 1:
        # Nothing is drawn again, so neither the line nor the last table goes along.
        moved = F.when(F.col("nxt").isNotNull(), F.concat("path", F.array("nxt"))).otherwise(F.col("path"))
        bare = aimed.select("walk_id", "db", "path", "attempt", "key", "slot")
        return bare.join(places, ["db", "key", "slot"], "left").select(
            "walk_id", "db", moved.alias("path"), "attempt",
            F.col("nxt_lines").alias("lines"), F.col("nxt_total").alias("total"),
        )
    met = aimed.join(places, ["db", "key", "slot"], "left")
    keys = F.transform("lines", lambda x: x["key"])
    near = F.exists("nxt_lines", lambda x: F.array_contains("prev_keys", x["key"]))
    weight = (
        F.when(F.col("prev").isNull(), 1.0)
        .when(F.col("nxt") == F.col("prev"), 1 / p)
        .when(near, 1.0)
        .otherwise(1 / q)
    )
    luck = unit_draw(F.lit(seed), F.lit("accept"), "walk_id", F.size("path"), "attempt")
    accepted = F.col("nxt").isNotNull() & (luck * max(1.0, 1 / p, 1 / q) < weight)

    def after(moved: Column, stayed: str) -> Column:
        return F.when(F.col("ok"), moved).otherwise(F.col(stayed))

    return met.withColumn("ok", F.coalesce(accepted, F.lit(False))).select(
        "walk_id",
        "db",
        after(F.col("nxt"), "tbl").alias("tbl"),
        after(F.concat("path", F.array("nxt")), "path").alias("path"),
        F.when(F.col("ok"), 0).otherwise(F.col("attempt") + 1).alias("attempt"),
        after(F.col("nxt_lines"), "lines").alias("lines"),
        after(F.col("nxt_total"), "total").alias("total"),
        after(F.col("tbl"), "prev").alias("prev"),
        after(keys, "prev_keys").alias("prev_keys"),
    )


def random_walks(
    starts: DataFrame,
    columns: DataFrame,
    members: DataFrame,
    walk_len: int,
    seed: str = "walk",
    p: float = 1.0,
    q: float = 1.0,
) -> DataFrame:
    """(walk_id, db, path): walks source -> db -> table -> linked table …

    starts(walk_id). ``walk_len`` counts all nodes, so a path has up to
    ``walk_len - 2`` tables; a walk ends early at a table without neighbours.
    A step goes to one of the distinct neighbours: back to the last table with
    weight 1 / p, to a table linked with the last one too (from the first table:
    to any) with weight 1, elsewhere with weight 1 / q. Every database is walked
    alike, through its keys, and no pair of tables is listed.
    """
    return walk_from(_starts(starts, columns, seed), members, walk_len, seed, p, q)


def _neighbour_rows(members: DataFrame) -> DataFrame:
    """(db, names, nbrs): a database's tables and, by their numbers, the neighbours of each.

    Neighbours stand in the order of ``_lines``: by the first shared key, then by
    their slot of ``clique_places``. For databases of few members only.
    """
    keyed = members.groupBy("db", "key").agg(F.collect_list("tbl").alias("tbls"))
    keys = F.sort_array(F.collect_list(F.struct("key", F.array_sort("tbls").alias("tbls"))))
    in_key = keyed.groupBy("db").agg(F.transform(keys, lambda k: k["tbls"]).alias("keys"))

    def shared(tbls: Column, i: Column) -> Column:
        """Smaller keys that two members of this one have."""
        below = F.filter(F.sequence(F.lit(0), i), lambda j: j < i)
        return F.filter(below, lambda j: F.size(F.array_intersect(F.get("keys", j), tbls)) >= 2)

    def slots(k: Column) -> Column:
        place = F.transform(
            k["tbls"],
            lambda t: F.struct(
                F.filter(k["low"], lambda j: F.array_contains(F.get("keys", j), t)).alias("low"),
                F.substring(F.md5(t), 1, 2).alias("slice"),
                t.alias("tbl"),
            ),
        )
        return F.transform(F.array_sort(place), lambda x: x["tbl"])

    lows = F.transform("keys", lambda k, i: F.struct(k.alias("tbls"), shared(k, i).alias("low")))
    placed = cut_lineage(
        in_key.withColumn("lows", lows).select(
            "db",
            F.array_sort(F.array_distinct(F.flatten("keys"))).alias("names"),
            F.transform("lows", slots).alias("keys"),
        )
    )

    def near(t: Column) -> Column:
        met = F.array_distinct(F.flatten(F.filter("keys", lambda k: F.array_contains(k, t))))
        return F.transform(F.array_remove(met, t), lambda x: F.array_position("names", x).cast("int") - 1)

    return cut_lineage(placed.select("db", "names", F.transform("names", near).alias("nbrs")))


def _walk_rows(begun: DataFrame, rows: DataFrame, most: int, p: float, q: float, seed: str) -> DataFrame:
    """(walk_id, db, path) of walks in databases of ``_neighbour_rows``, all steps in the row.

    The draws are those of ``_step``. Walks that were refused too often go on in
    another pass.
    """
    thinned = (p, q) != (1, 1)
    state = begun.select("walk_id", "db", F.array("at").alias("way"), F.lit(0).alias("attempt"))
    done: DataFrame | None = None

    def near(way: Column) -> Column:
        return F.get("nbrs", F.element_at(way, -1))

    def going(s: Column) -> Column:
        return (F.size(s["way"]) < most) & (F.size(near(s["way"])) > 0)

    def move(s: Column, nxt: Column) -> Column:
        moved = F.struct(F.concat(s["way"], F.array(nxt)).alias("way"), F.lit(0).alias("attempt"))
        if not thinned:
            return moved
        prev = F.get(s["way"], F.size(s["way"]) - 2)
        weight = (
            F.when(prev.isNull(), 1.0)
            .when(nxt == prev, 1 / p)
            .when(F.array_contains(F.get("nbrs", prev), nxt), 1.0)
            .otherwise(1 / q)
        )
        luck = unit_draw(F.lit(seed), F.lit("accept"), "walk_id", F.size(s["way"]), s["attempt"])
        stayed = F.struct(s["way"].alias("way"), (s["attempt"] + 1).alias("attempt"))
        return F.when(luck * max(1.0, 1 / p, 1 / q) < weight, moved).otherwise(stayed)

    def step(s: Column, _: Column) -> Column:
        at = near(s["way"])
        pick = draw_below(F.size(at), F.lit(seed), "walk_id", F.size(s["way"]), s["attempt"])
        # The list of one holds the draw, so that it is made once.
        drawn = F.transform(F.array(F.get(at, pick.cast("int"))), lambda nxt: move(s, nxt))
        return F.when(going(s), F.get(drawn, F.lit(0))).otherwise(s)

    tries = PROPOSALS * most if thinned else most - 1
    while True:
        s = F.struct("way", "attempt")
        if tries > 0:
            s = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), s, step)
        walked = cut_lineage(
            state.join(rows, "db").withColumn("s", s).select(
                "walk_id",
                "db",
                "s.way",
                "s.attempt",
                F.transform("s.way", lambda i: F.get("names", i)).alias("path"),
                going(F.col("s")).alias("going"),
            )
        )
        ended = walked.where(~F.col("going")).select("walk_id", "db", "path")
        done = ended if done is None else done.unionByName(ended)
        state = walked.where("going").select("walk_id", "db", "way", "attempt")
        if not thinned or state.isEmpty():
            return done


def walk_from(
    begun: DataFrame,
    members: DataFrame,
    walk_len: int,
    seed: str = "walk",
    p: float = 1.0,
    q: float = 1.0,
) -> DataFrame:
    """(walk_id, db, path) of begun(walk_id, db, tbl), as ``random_walks`` goes on.

    Walks through a database of few clique members are made whole from one row,
    and one join by database serves all their steps. Other databases are walked
    key by key, a join per step.
    """
    members = cut_lineage(members)
    sizes = cut_lineage(
        members.groupBy("db").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("tbl").isNull()).alias("unnamed")
        )
    )
    # A null names no table to go to, which only the steps by key tell apart.
    small = (F.col("n") <= GATHERED) & ~F.col("unnamed")
    few = members.join(sizes.where(small).select("db"), "db", "left_semi")
    rows = _neighbour_rows(few)
    at = F.coalesce(F.array_position("names", F.col("tbl")).cast("int") - 1, F.lit(-1))
    begun = cut_lineage(
        begun.join(rows.select("db", "names"), "db", "left").select("walk_id", "db", "tbl", at.alias("at"))
    )
    inside = _walk_rows(begun.where("at >= 0"), rows, walk_len - 2, p, q, seed)
    others = begun.where("at < 0").select("walk_id", "db", "tbl")
    wide = sizes.where(~small & F.col("db").isNotNull()).select("db")
    if wide.isEmpty():
        return inside.unionByName(others.select("walk_id", "db", F.array("tbl").alias("path")))
    by_key = _walk_keys(others, members.join(wide, "db", "left_semi"), walk_len, seed, p, q)
    return inside.unionByName(by_key)


def _walk_keys(
    begun: DataFrame, members: DataFrame, walk_len: int, seed: str, p: float, q: float
) -> DataFrame:
    """``walk_from`` by keys: a join per step, and no pair of tables is listed."""
    most = walk_len - 2
    placed = cut_lineage(clique_places(cut_lineage(members)))
    lines = cut_lineage(_lines(placed))
    places = cut_lineage(
        placed.select("db", "key", "slot", F.col("tbl").alias("nxt"))
        .join(
            lines.select(
                "db",
                F.col("tbl").alias("nxt"),
                F.col("lines").alias("nxt_lines"),
                F.col("total").alias("nxt_total"),
            ),
            ["db", "nxt"],
        )
    )
    last = [
        "tbl",
        F.lit(None).cast("string").alias("prev"),
        F.transform("lines", lambda x: x["key"]).alias("prev_keys"),
    ]
    state = begun.join(lines, ["db", "tbl"], "left").select(
        "walk_id",
        "db",
        F.array("tbl").alias("path"),
        F.lit(0).alias("attempt"),
        "lines",
        "total",
        *(last if (p, q) != (1, 1) else []),
    )
    going = (F.size("path") < most) & F.coalesce(F.col("total") > 0, F.lit(False))
    done: DataFrame | None = None
    while True:
        for _ in range(STEPS_AT_ONCE):
            state = _step(state, places, most, p, q, seed)
        state = cut_lineage(state)
        # Finished walks leave the state.
        ended = state.where(~going).select("walk_id", "db", "path")
        done = ended if done is None else done.unionByName(ended)
        state = state.where(going)
        if state.isEmpty():
            return done


def dedupe_walks(walks: DataFrame) -> DataFrame:
    """(walk_id, db, tables): distinct tables in order of their first visit."""
    return walks.select("walk_id", "db", F.array_distinct("path").alias("tables"))


def truncate_walks(walks: DataFrame, histogram: DataFrame) -> DataFrame:
    """Keep as many leading tables as a drawn question would have."""
    drawn = weighted_draw(walks, histogram, "table", "n", F.lit("n_tables"), "walk_id")
    return drawn.select(
        "walk_id", "db", F.slice("tables", F.lit(1), F.least("n", F.size("tables"))).alias("tables")
    )


def drawn_positions(n: Column, k: Column, *key: Column | str) -> Column:
    """k distinct numbers below n, every set alike: the j-th draw is from the first
    n - k + j numbers, and where it falls on a number taken before, the last of those
    is taken instead."""
    none = F.array().cast("array<bigint>")

    def take(taken: Column, j: Column) -> Column:
        drawn = draw_below(j + 1, *key, j.cast("string"))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, drawn), j).otherwise(drawn)))

    steps = F.when(k > 0, F.sequence(n - k, n - 1)).otherwise(none)
    return F.aggregate(steps, none, take)


def sample_columns(walks: DataFrame, columns: DataFrame, histogram: DataFrame) -> DataFrame:
    """(walk_id, db, pos, tbl, draw_pos, col): drawn columns, without replacement.

    Positions are drawn from the number of a table's columns and only the drawn
    ones are joined, so a table of many columns costs what is drawn from it.
    """
    visits = walks.select("walk_id", "db", F.posexplode("tables").alias("pos", "tbl"))
    numbered = cut_lineage(
        number_rows(columns.select("db", "tbl", "col_pos", "col"), ["db", "tbl"], "col_pos", "col_no")
    )
    sizes = numbered.groupBy("db", "tbl").agg(F.count(F.lit(1)).alias("n_cols"))
    sized = weighted_draw(visits, histogram, "column", "k", F.lit("n_columns"), "walk_id", "tbl")
    least = F.least(F.col("k").cast("bigint"), F.col("n_cols"))
    drawn = drawn_positions(F.col("n_cols"), least, F.lit("column"), "walk_id", "tbl")
    return (
        sized.join(sizes, ["db", "tbl"])
        .select("walk_id", "db", "pos", "tbl", F.posexplode(drawn).alias("draw_pos", "col_no"))
        .join(numbered, ["db", "tbl", "col_no"])
        .select("walk_id", "db", "pos", "tbl", (F.col("draw_pos") + 1).alias("draw_pos"), "col")
    )


def assemble_synthetic(walks: DataFrame, drawn: DataFrame) -> DataFrame:
    """Synthetic instances: the schema of each walk, with an empty SQL text."""
    visits = walks.select("walk_id", "db", F.posexplode_outer("tables").alias("pos", "tbl"))
    cols = drawn.groupBy("walk_id", "pos").agg(
        F.sort_array(F.collect_list(F.struct("draw_pos", "col"))).alias("cols")
    )
    item = F.struct(
        "pos",
        F.col("tbl").alias("name"),
        F.coalesce(F.transform("cols", lambda c: c["col"]), F.array().cast("array<string>")).alias(
            "columns"
        ),
    )
    nested = (
        visits.join(cols, ["walk_id", "pos"], "left")
        .groupBy("walk_id", "db")
        .agg(F.sort_array(F.collect_list(F.when(F.col("tbl").isNotNull(), item))).alias("m"))
    )
    return nested.select(
        F.col("walk_id").alias("qid"),
        F.lit("").alias("sql"),
        F.struct(
            F.col("db").alias("database"),
            F.transform("m", lambda t: t.dropFields("pos")).alias("metadata"),
        ).alias("schema"),
    )


def train_validation_split(
    df: DataFrame, key: str, share: float = 0.1, seed: str = "split"
) -> DataFrame:
    """Add ``split``: a seeded ``share`` of the rows is for validation."""
    draw = unit_draw(F.lit(seed), key)
    return df.withColumn("split", F.when(draw < share, "validation").otherwise("train"))
