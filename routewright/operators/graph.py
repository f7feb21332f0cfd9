"""Schema graph: tree edges, foreign-key cliques, frontiers and routes.

All tables around one referenced key are linked with each other. That clique is
kept in hub form, one row per (db, key, table), which is linear in its size;
its pairs are tested or looked up through the hub and never enumerated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewright.functions.draws import draw_below
from routewright.functions.positions import number_rows
from routewright.session import cut_lineage

ROOT = "source"
# Databases of at most so many names list all pairs of them when votes are counted.
PAIRED = 16


def tree_edges(columns: DataFrame) -> DataFrame:
    """source -> database and database -> table edges."""
    dbs = columns.select(
        F.lit(ROOT).alias("src"),
        F.lit("").alias("src_in"),
        F.col("db").alias("dst"),
        F.lit(ROOT).alias("dst_in"),
    )
    tables = columns.select(
        F.col("db").alias("src"),
        F.lit(ROOT).alias("src_in"),
        F.col("tbl").alias("dst"),
        F.col("db").alias("dst_in"),
    )
    return dbs.unionByName(tables).distinct()


def clique_members(columns: DataFrame) -> DataFrame:
    """(db, key, tbl, size): owner and referencing tables of each key, two or more.

    ``key`` holds the referenced table and column side by side, as both may
    have dots in their names.
    """
    key = F.struct("fk_tbl", "fk_col").alias("key")
    # One shuffle, by key: members are told apart and counted where they arrive.
    linked = columns.where("fk_tbl is not null and db is not null").select("db", key, "tbl")
    members = (
        linked.repartition("db", "key")
        .select("db", "key", F.explode(F.array("tbl", "key.fk_tbl")).alias("tbl"))
        .distinct()
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("db", "key"))
    return members.withColumn("size", size).where("size > 1")


def clique_sizes(members: DataFrame) -> DataFrame:
    """(db, key, n_tables, n_edges): ordered pairs each clique stands for."""
    return members.groupBy("db", "key").agg(
        F.count(F.lit(1)).alias("n_tables"),
        (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("n_edges"),
    )


def linked_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those of the given (db, a, b) pairs that are edges."""
    hub = members.select("db", "key", "tbl")
    left = pairs.where("a <> b").join(hub.withColumnRenamed("tbl", "a"), ["db", "a"])
    return (
        left.join(hub.withColumnRenamed("tbl", "b"), ["db", "key", "b"], "left_semi")
        .select(*pairs.columns)
        .distinct()
    )


def neighbours(chosen: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, db, nxt): tables linked to any chosen (sid, db, tbl), less the chosen.

    Each state meets a key once, however many of its tables share it.
    """
    hub = members.select("db", "key", "tbl")
    keys = chosen.join(hub, ["db", "tbl"]).select("sid", "db", "key").distinct()
    reached = keys.join(hub, ["db", "key"]).select("sid", "db", F.col("tbl").alias("nxt")).distinct()
    taken = chosen.select("sid", "db", F.col("tbl").alias("nxt"))
    return reached.join(taken, ["sid", "db", "nxt"], "left_anti")


def frontier_spans(chosen: DataFrame, places: DataFrame) -> DataFrame:
    """(sid, db, key, lo, hi, skips): the neighbours of each state, by key and unlisted.

    chosen(sid, db, tbl), and ``places`` of ``clique_places`` with all smaller keys. The distinct tables
    that may follow a state lie on [0, total), key by key. [lo, hi) are those of
    the key's members that share no smaller key of the state and are not chosen;
    ``skips`` are the slots of the others. A state has a row per key, however
    many tables share it.
    """
    at = cut_lineage(
        chosen.select("sid", "db", "tbl")
        .distinct()
        .join(places.select("db", "tbl", "key", "size", "slot", F.col("lo").alias("kind"), "low"), ["db", "tbl"])
    )
    keys = at.select("sid", "db", "key", "size").distinct()
    kinds = places.where(F.size("low") > 0).select("db", "key", "low", "lo", "n").distinct()
    before = (
        keys.join(kinds.withColumn("x", F.explode("low")), ["db", "key"])
        .join(keys.select("sid", "db", F.col("key").alias("x")), ["sid", "db", "x"], "left_semi")
        .select("sid", "db", "key", "lo", "n")
        .distinct()
    )
    own = at.join(
        before.select("sid", "db", "key", F.col("lo").alias("kind")), ["sid", "db", "key", "kind"], "left_anti"
    ).select("sid", "db", "key", F.col("slot").alias("lo"), F.lit(1).cast("bigint").alias("n"))
    skips = (
        before.unionByName(own)
        .groupBy("sid", "db", "key")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("skips"), F.sum("n").alias("out"))
    )
    upto = Window.partitionBy("sid", "db").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("size") - F.coalesce("out", F.lit(0))
    hi = F.sum(left).over(upto)
    return keys.join(skips, ["sid", "db", "key"], "left").select(
        "sid", "db", "key", (hi - left).alias("lo"), hi.alias("hi"), "skips"
    )


def frontier_sizes(spans: DataFrame) -> DataFrame:
    """(sid, db, n): how many tables may follow each state."""
    return spans.groupBy("sid", "db").agg(F.max("hi").alias("n"))


def frontier_draws(spans: DataFrame, places: DataFrame, seed: str = "frontier") -> DataFrame:
    """(sid, db, nxt): one table that may follow each state, all alike."""
    picked = frontier_sizes(spans).where("n > 0").withColumn(
        "pick", draw_below(F.col("n"), F.lit(seed), "sid", "db")
    )
    at = spans.join(picked, ["sid", "db"]).where("lo <= pick and pick < hi")
    slot = F.aggregate(
        F.coalesce("skips", F.filter(F.array(F.struct("lo", F.col("hi").alias("n"))), lambda _: F.lit(False))),
        F.col("pick") - F.col("lo"),
        lambda r, x: r + F.when(r >= x["lo"], x["n"]).otherwise(0),
    )
    return at.select("sid", "db", "key", slot.alias("slot")).join(
        places.select("db", "key", "slot", F.col("tbl").alias("nxt")), ["db", "key", "slot"]
    ).select("sid", "db", "nxt")


def frontier_holds(asked: DataFrame, chosen: DataFrame, members: DataFrame) -> DataFrame:
    """Those (sid, db, nxt) that may follow their state; nothing else is looked at."""
    hub = members.select("db", "key", "tbl")
    keys = chosen.join(hub, ["db", "tbl"]).select("sid", "db", "key").distinct()
    reached = (
        asked.join(hub.withColumnRenamed("tbl", "nxt"), ["db", "nxt"])
        .join(keys, ["sid", "db", "key"], "left_semi")
        .select("sid", "db", "nxt")
        .distinct()
    )
    return reached.join(chosen.select("sid", "db", F.col("tbl").alias("nxt")), ["sid", "db", "nxt"], "left_anti")


def clique_places(members: DataFrame, least: int = 2) -> DataFrame:
    """(db, key, tbl, size, low, slot, lo, n): every member's place on its key.

    ``low`` lists the smaller keys of the member that at least ``least`` members of
    this key have. Members with the same ``low`` meet the same others first
    elsewhere, so they stand side by side: [lo, lo + n) are their slots. Steps from
    one table ask for two members, itself and another; states of several tables
    ask for one.
    """
    mine = members.select("db", "key", "tbl")
    both = mine.join(mine.select("db", "tbl", F.col("key").alias("low")), ["db", "tbl"]).where(
        "low < key"
    )
    shared = both.groupBy("db", "key", "low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    lows = (
        both.join(shared.drop("n"), ["db", "key", "low"])
        .groupBy("db", "key", "tbl")
        .agg(F.sort_array(F.collect_list("low")).alias("low"))
    )
    none = F.filter(F.array("key"), lambda _: F.lit(False))
    marked = cut_lineage(
        members.join(lows, ["db", "key", "tbl"], "left").withColumn("low", F.coalesce("low", none))
    )
    return number_rows(marked, ["db", "key"], "tbl", "slot", kind="low")


def frontier(states: DataFrame, columns: DataFrame, members: DataFrame) -> DataFrame:
    """What may follow a partial schema: (sid, db, nxt).

    states(sid, db, tbl): no db yet means any database, no table yet any table
    of the database, otherwise the neighbours of the chosen tables. States
    without a table differ only by their node, so they are answered once per
    node under ``sid`` null.
    """
    edges = tree_edges(columns)
    nodes = states.where("tbl is null").select(
        F.coalesce("db", F.lit(ROOT)).alias("src"),
        F.when(F.col("db").isNull(), "").otherwise(ROOT).alias("src_in"),
    ).distinct()
    opened = nodes.join(edges, ["src", "src_in"]).select(
        F.lit(None).cast("bigint").alias("sid"),
        F.when(F.col("src_in") != "", F.col("src")).alias("db"),
        F.col("dst").alias("nxt"),
    )
    return opened.unionByName(neighbours(states.where("tbl is not null"), members))


def check_routes(steps: DataFrame, columns: DataFrame, members: DataFrame) -> DataFrame:
    """(rid, valid, n_tables): may each table of a decoded route follow the ones before?

    steps(rid, db, pos, tbl). A table is legal if it is new, belongs to the
    database, and is the first or shares a key with an earlier one: that is,
    some key of it was already seen at a smaller position.
    """
    tables = columns.select("db", "tbl").distinct().withColumn("known", F.lit(True))
    base = steps.join(tables, ["db", "tbl"], "left")
    hub = members.select("db", "key", "tbl")
    by_key = Window.partitionBy("rid", "key")
    reach = (
        steps.join(hub, ["db", "tbl"])
        .withColumn("first", F.min("pos").over(by_key))
        .where("first < pos")
        .select("rid", "pos", "tbl")
        .distinct()
        .withColumn("linked", F.lit(True))
    )
    repeat = F.min("pos").over(Window.partitionBy("rid", "tbl")) < F.col("pos")
    start = F.min("pos").over(Window.partitionBy("rid")) == F.col("pos")
    legal = (
        F.col("known").isNotNull() & ~F.col("again") & (F.col("start") | F.col("linked").isNotNull())
    )
    return (
        base.withColumn("again", repeat)
        .withColumn("start", start)
        .join(reach, ["rid", "pos", "tbl"], "left")
        .groupBy("rid")
        .agg(F.bool_and(legal).alias("valid"), F.count(F.lit(1)).alias("n_tables"))
    )


def table_index(columns: DataFrame) -> DataFrame:
    """Inverted map as rows: (tbl, db)."""
    return columns.select("tbl", "db").distinct()


def vote_database(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, db): database named by most tables of a flat table list.

    labels(qid, pos, tbl); ties go to the database seen first, that is by the
    earliest table, then by name. Lists that name no known table get an empty
    database.

    Equal lists are answered once. Of a list, the table that the fewest databases
    have is looked up first; the best of these databases, counted over the whole
    list, is a floor. Tables that all together have fewer votes than the floor can
    bring no database in, so of those, taken from the most widespread one on, no
    databases are listed: their votes are only tested.
    """
    rows = labels.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tbl"))).alias("at")
    )
    lists = cut_lineage(rows.select("qid", F.transform("at", lambda x: x["tbl"]).alias("names")))
    best = best_of_lists(lists.select("names").distinct(), index)
    return lists.join(best, "names", "left").select("qid", F.coalesce("db", F.lit("")).alias("db"))


def listed_names(lists: DataFrame, index: DataFrame, key: str = "names") -> DataFrame:
    """(key, tbl, n, uses, first): known tables of each list, and how many databases have each."""
    widths = index.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))
    each = lists.select(key, F.posexplode("names").alias("i", "tbl"))
    return (
        each.groupBy(key, "tbl")
        .agg(F.count(F.lit(1)).alias("uses"), F.min("i").alias("first"))
        .join(widths, "tbl")
    )


def opening_names(known: DataFrame, floors: DataFrame, key: str = "names") -> DataFrame:
    """Tables of each list whose databases must be listed, given (key, floor)."""
    widest = Window.partitionBy(key).orderBy(F.desc("n"), "tbl")
    upto = F.sum("uses").over(widest.rowsBetween(Window.unboundedPreceding, 0))
    return known.join(floors, key).withColumn("upto", upto).where("upto >= floor")


def _beside(rarest: DataFrame, known: DataFrame, index: DataFrame) -> DataFrame:
    """(lid, db, uses, first): votes of a list's other names in databases that hold its rarest one.

    Databases of few names list their pairs of names, which the pairs asked for meet.
    Of larger ones those with the rarest name are tested for each of the others.
    """
    others = known.join(rarest.select("lid", F.col("tbl").alias("beside")), "lid").where("tbl <> beside")
    sized = index.where("tbl is not null and db is not null").withColumn(
        "size", F.count(F.lit(1)).over(Window.partitionBy("db"))
    )
    names = sized.where(F.col("size") <= PAIRED).groupBy("db").agg(F.sort_array(F.collect_set("tbl")).alias("t"))
    both = F.transform(
        "t", lambda a, i: F.transform(F.slice("t", i + 2, PAIRED), lambda b: F.struct(a.alias("a"), b.alias("b")))
    )
    pairs = names.select("db", F.inline(F.flatten(both)))
    asked = others.withColumns({"a": F.least("tbl", "beside"), "b": F.greatest("tbl", "beside")})
    large = sized.where(F.col("size") > PAIRED).select("tbl", "db")
    tested = others.join(large.withColumnRenamed("tbl", "beside"), "beside").join(large, ["tbl", "db"], "left_semi")
    votes = ["lid", "db", "uses", "first"]
    hits = asked.join(pairs, ["a", "b"]).select(*votes).unionByName(tested.select(*votes))
    return hits.groupBy("lid", "db").agg(F.sum("uses").alias("uses"), F.min("first").alias("first"))


def _best_votes(
    reached: DataFrame, known: DataFrame, index: DataFrame, rarest: DataFrame | None = None
) -> DataFrame:
    """(lid, best): the winner of the (lid, db) reached, by votes of the whole list.

    Those reached by the ``rarest`` name have its votes for sure, so only databases that
    hold another name as well are counted; the first of the others stands for them.
    """

    def ranked(votes: Column, seen: Column) -> Column:
        return F.struct((-votes).alias("v"), seen.alias("seen"), "db").alias("best")

    if rarest is None:
        named = reached.join(known.select("lid", "tbl", "uses", "first"), "lid")
        votes = named.join(index, ["tbl", "db"], "left_semi").groupBy("lid", "db").agg(
            F.sum("uses").alias("votes"), F.min("first").alias("seen")
        )
        found = votes.select("lid", ranked(F.col("votes"), F.col("seen")))
    else:
        sure = reached.where("db is not null").select("lid", ranked(F.col("uses"), F.col("first")))
        own = rarest.select("lid", F.col("uses").alias("own"), F.col("first").alias("at"))
        more = _beside(rarest, known, index).join(own, "lid").select(
            "lid", ranked(F.col("own") + F.col("uses"), F.least("at", "first"))
        )
        found = sure.groupBy("lid").agg(F.min("best").alias("best")).unionByName(more)
    return found.groupBy("lid").agg(F.min("best").alias("best"))


def best_of_lists(lists: DataFrame, index: DataFrame) -> DataFrame:
    """(names, db) of distinct lists of table names.

    A list goes by a number, so that no step carries its names along. Where only its
    rarest name is opened, the databases of that have been counted for the floor.
    """
    index = cut_lineage(index.select("tbl", "db"))
    numbered = cut_lineage(lists.withColumn("lid", F.monotonically_increasing_id()))
    known = cut_lineage(listed_names(numbered, index, "lid"))
    # The last in the order of opening_names.
    narrow = Window.partitionBy("lid").orderBy("n", F.desc("tbl"))
    nth = known.withColumn("nth", F.row_number().over(narrow)).where("nth = 1")
    rarest = cut_lineage(nth.select("lid", "tbl", "uses", "first"))
    reached = rarest.join(index, "tbl").select("lid", "db", "uses", "first")
    counted = cut_lineage(_best_votes(reached, known, index, rarest))
    floors = counted.select("lid", (-F.col("best.v")).alias("floor"))
    n_opened = F.count(F.lit(1)).over(Window.partitionBy("lid"))
    further = cut_lineage(
        opening_names(known, floors, "lid").select("lid", "tbl", n_opened.alias("opened")).where("opened > 1")
    )
    more = _best_votes(further.join(index, "tbl").select("lid", "db").distinct(), known, index)
    settled = counted.join(further.select("lid").distinct(), "lid", "left_anti")
    best = settled.unionByName(more).select("lid", F.col("best.db").alias("db"))
    return numbered.join(best, "lid").select("names", "db")


def voted_schema(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, db, tables): the voted database with the list's tables in order.

    A list that names no known table has an empty database and no tables.
    """
    listed = labels.groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "tbl"))), lambda x: x["tbl"]).alias("all")
    )
    none = F.array().cast("array<string>")
    tables = F.when(F.col("db") == "", none).otherwise(F.col("all")).alias("tables")
    return vote_database(labels, index).join(listed, "qid").select("qid", "db", tables)


def has_separator(name: Column, separator: str) -> Column:
    """True for a name that would break a serialised schema."""
    return name.contains(separator)


def separator_rejects(columns: DataFrame, separator: str) -> DataFrame:
    """Database and table names that contain the separator."""
    names = columns.select(F.explode(F.array("db", "tbl")).alias("name")).distinct()
    return names.where(has_separator(F.col("name"), separator))


def deserialise(text: Column, separator: str) -> Column:
    """``db<sep>t1<sep>t2`` to struct(database, tables)."""
    parts = F.split(
        F.replace(text, F.lit(separator + " "), F.lit(separator)), _literal(separator)
    )
    return F.struct(
        F.get(parts, F.lit(0)).alias("database"),
        F.slice(parts, F.lit(2), F.size(parts)).alias("tables"),
    )


def label_tables(text: Column, separator: str) -> Column:
    """``t1<sep>t2`` to its tables."""
    return F.split(
        F.replace(text, F.lit(separator + " "), F.lit(separator)), _literal(separator)
    )


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def _preorder(tables: list[str], links: list[dict]) -> list[str]:
    """Depth-first order of one question's tables; the last child goes first."""
    by_key: dict[str, list[str]] = {}
    keys_of: dict[str, list[str]] = {}
    for link in links:
        by_key.setdefault(link["key"], []).append(link["tbl"])
        keys_of.setdefault(link["tbl"], []).append(link["key"])
    rank = {t: i for i, t in enumerate(tables)}
    order: dict[str, None] = {}
    stack = list(tables)
    while stack and len(order) < len(rank):
        table = stack.pop()
        if table in order:
            continue
        order[table] = None
        near = {t for k in keys_of.get(table, ()) for t in by_key[k]}
        stack.extend(sorted((t for t in near if t not in order), key=rank.__getitem__))
    return list(order)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _preorder_udf(tables: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([_preorder(list(t), list(k)) for t, k in zip(tables, links, strict=True)])


def serialise(
    mentions: DataFrame, members: DataFrame, separator: str, seed: str | None = None
) -> DataFrame:
    """(qid, text): ``db<sep>table…`` in depth-first order of the schema graph.

    mentions(qid, db, tbl_pos, tbl). Only the question's own tables and the keys
    they share are gathered. Children keep catalog order, or a seeded random one.
    """
    tables = mentions.select("qid", "db", "tbl_pos", "tbl").distinct()
    hub = members.select("db", F.to_json("key").alias("key"), "tbl")
    order = F.col("tbl_pos") if seed is None else F.md5(F.concat_ws("|", F.lit(seed), "qid", "tbl"))
    linked = tables.join(hub, ["db", "tbl"], "left").groupBy("qid", "db", "tbl_pos", "tbl").agg(
        F.collect_list(F.when(F.col("key").isNotNull(), F.struct("tbl", "key"))).alias("links")
    )
    record = linked.groupBy("qid", "db").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "tbl"))).alias("tables"),
        F.flatten(F.collect_list("links")).alias("links"),
    )
    ordered = _preorder_udf(F.transform("tables", lambda t: t["tbl"]), F.col("links"))
    return record.select(
        "qid", F.array_join(F.concat(F.array("db"), ordered), separator).alias("text")
    )


def flat_label(mentions: DataFrame, separator: str, seed: str | None = None) -> DataFrame:
    """(qid, text): the question's tables only, in catalog or seeded random order."""
    order = F.col("tbl_pos") if seed is None else F.md5(F.concat_ws("|", F.lit(seed), "qid", "tbl"))
    tables = mentions.select("qid", "tbl_pos", "tbl").distinct()
    listed = tables.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "tbl"))).alias("tables")
    )
    return listed.select(
        "qid", F.array_join(F.transform("tables", lambda t: t["tbl"]), separator).alias("text")
    )
