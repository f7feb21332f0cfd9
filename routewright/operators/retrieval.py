"""Sparse retrieval: BM25 index, exact top-k search, roll-up to databases.

The index keeps one row of term counts per document. A query whose terms have few
postings lists them; one that shares words with many documents meets all of them
block by block (``block_scan``), so that no pair of a query and a document leaves
its task. Both are exact.

``prune`` is the variant by upper bounds. Documents are dealt to blocks; the
largest number of uses and the shortest length of every term and block bound its
part of any score there. Each query's rare terms are scored alone, the best
documents of that in full, and the k-th of these is a floor. Only blocks and
documents whose bound reaches it are listed, which is little where rare words
decide and much where all words are common.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routewright.functions.draws import unit_draw
from routewright.functions.numbers import rounded
from routewright.functions.text import tokens
from routewright.operators.block_scan import best_of_blocks, packed
from routewright.session import cut_lineage

K1 = 1.2
B = 0.75
CUTOFF = 100
TOP_DATABASES = 5
SCORE_DIGITS = 6
# Documents of a block on average.
BLOCK_DOCS = 1024
# Rare terms of a query are scored alone while they have so many postings per wanted document.
PROBED = 16
# So many times the wanted documents are scored in full for a floor.
HEADS = 2
# A term is widespread, and a query's postings are too many to be listed, from this share (1 / WIDE)
# of the documents on.
WIDE = 256
# Hits of a query stay where its most frequent term is, unless that term's hits are more than this.
HOME_HITS = 1 << 20
# A bound must miss the floor by this to count; far above the error of a sum, and rounding.
SLACK = 1e-5


@dataclass(frozen=True)
class Bm25Index:
    """vectors(doc_id, db, len, terms[(term, tf)]), lengths(doc_id, len), stats(n_docs, avg_len),
    df(term, df, tf, len): in how many documents, most uses and least length there."""

    vectors: DataFrame
    lengths: DataFrame
    stats: DataFrame
    df: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(doc_id, db, term, tf, len, block)."""
        n_blocks = F.ceil(self.stats.select("n_docs").scalar() / BLOCK_DOCS)
        block = F.pmod(F.xxhash64("doc_id"), F.greatest(n_blocks, F.lit(1))).alias("block")
        flat = self.vectors.where("doc_id is not null").select(
            "doc_id", "db", "len", F.explode("terms").alias("t")
        )
        return flat.select("doc_id", "db", "t.term", "t.tf", "len", block)

    @property
    def bounds(self) -> DataFrame:
        """(term, block, tf, len): most uses and least length there."""
        most, least = F.max("tf").alias("tf"), F.min("len").alias("len")
        return self.postings.groupBy("term", "block").agg(most, least)

    def write(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Bm25Index:
        return Bm25Index(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(Bm25Index)])


def count_postings(docs: DataFrame) -> DataFrame:
    """(doc_id, db, term, tf) of docs(doc_id, db, text); rows of one doc_id are its parts.

    Term counts are pre-aggregated before the shuffle, so a giant document
    moves one row per distinct term and task. An empty document is one posting
    without a term, so that it still counts for the averages.
    """
    words = docs.select("doc_id", "db", F.explode_outer(tokens(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "db", "term").agg(F.count("term").alias("tf"))


def document_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, db, len, terms[(term, tf)]) of docs(doc_id, db, text); parts count together.

    The texts are shuffled once, by document; words are counted, gathered and
    summed where they arrive.
    """
    counted = count_postings(docs.repartition("doc_id"))
    term = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    rows = counted.groupBy("doc_id", "db").agg(
        F.sum("tf").alias("n"), F.collect_list(term).alias("terms")
    )
    whole = F.sum("n").over(Window.partitionBy("doc_id"))
    return rows.select("doc_id", "db", whole.alias("len"), "terms")


def build_index(docs: DataFrame) -> Bm25Index:
    n = F.coalesce(F.size(tokens(F.col("text"))).cast("bigint"), F.lit(0).cast("bigint"))
    lengths = docs.groupBy("doc_id").agg(F.sum(F.when(F.col("text").isNull(), 0).otherwise(n)).alias("len"))
    return index_of(document_vectors(docs), lengths)


def index_of(vectors: DataFrame, lengths: DataFrame) -> Bm25Index:
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    said = vectors.where("doc_id is not null").select("len", F.inline("terms"))
    df = said.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("tf").alias("tf"), F.min("len").alias("len")
    )
    return Bm25Index(vectors, lengths, stats, df)


def stored_index(docs: DataFrame) -> Bm25Index:
    """An index that is written once: texts are read and words counted a single time."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("db"))
    kept = cut_lineage(document_vectors(docs).withColumn("first", nth == 1))
    vectors = kept.drop("first")
    lengths = kept.where("first").select("doc_id", "len")
    index = index_of(vectors, lengths)
    return Bm25Index(vectors, lengths, cut_lineage(index.stats), cut_lineage(index.df))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid…, term, qtf) of queries(qid…, text); a repeated word counts each time."""
    keys = [c for c in queries.columns if c != "text"]
    words = queries.select(*keys, F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf"))


def _idf(index: Bm25Index) -> Column:
    n = index.stats.select("n_docs").scalar()
    return F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _tf_part(tf: Column, length: Column, avg: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def _weighted(index: Bm25Index, queries: DataFrame) -> tuple[DataFrame, list[str]]:
    """(keys…, term, df, tf, len, w): weights and bounds of the query terms that documents have."""
    terms = query_terms(queries)
    keys = [c for c in terms.columns if c not in ("term", "qtf")]
    weight = (F.col("qtf") * _idf(index)).alias("w")
    return terms.join(index.df, "term").select(*keys, "term", "df", "tf", "len", weight), keys


def match_postings(index: Bm25Index, queries: DataFrame) -> tuple[DataFrame, list[str]]:
    """(keys…, doc_id, db, len, tf, w): all postings that meet a query term."""
    weighted, keys = _weighted(index, queries)
    return index.postings.join(weighted.drop("df", "tf", "len"), "term"), keys


def score_documents(
    index: Bm25Index, queries: DataFrame, k1: float = K1, b: float = B
) -> DataFrame:
    """(keys…, doc_id, db, score): every document that shares a term with a query."""
    hits, keys = match_postings(index, queries)
    avg = index.stats.select("avg_len").scalar()
    part = _tf_part(F.col("tf"), F.col("len"), avg, k1, b) * F.col("w")
    return hits.groupBy("doc_id", "db", *keys).agg(
        F.round(F.sum(part), SCORE_DIGITS).alias("score")
    )


def top_k(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best k rows per key by (score desc, doc_id); the cut is made per task first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Pruned:
    """Steps of a search, for what they list; all hold the keys of a query."""

    # Query terms with their floor, sum of the other terms' bounds, and whether they can lift
    # a document over the floor.
    terms: DataFrame
    # Partial scores from the rare terms alone.
    probed: DataFrame
    # Terms of the blocks that are read, and the documents that can reach the floor.
    blocks: DataFrame
    candidates: DataFrame
    scored: DataFrame


def prune(
    index: Bm25Index, queries: DataFrame, k: int = CUTOFF, k1: float = K1, b: float = B
) -> Pruned:
    """Score all documents that can be among the k best of a query, and few others.

    A query whose terms are all rare is done after the first step. For others the
    terms are sorted by bound; those that together stay below the floor cannot
    bring a document in, so only documents of the remaining ones are looked at.
    """
    avg = index.stats.select("avg_len").scalar()
    weighted, keys = _weighted(index, queries)
    part = _tf_part(F.col("tf"), F.col("len"), avg, k1, b) * F.col("w")
    by_df = Window.partitionBy(*keys).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys)
    rare = (F.sum("df").over(by_df) <= PROBED * k) | (F.row_number().over(by_df) == 1)
    terms = cut_lineage(
        weighted.withColumn("top", part)
        .withColumn("rare", rare)
        .withColumn("done", F.min("rare").over(own))
        .drop("tf", "len")
    )

    def partial(asked: DataFrame, on: list[str]) -> DataFrame:
        return index.postings.join(asked, on).groupBy(*keys, "doc_id", "db").agg(F.sum(part).alias("s"))

    probe = partial(terms.where("rare").select(*keys, "term", "w"), ["term"])
    probed = cut_lineage(
        probe.join(terms.select(*keys, "done").distinct(), keys).select(*probe.columns, "done")
    )
    # The best of them are scored in full: a floor that common terms have raised as well.
    by_score = Window.partitionBy(*keys).orderBy(F.desc("s"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by_score))

    heads = ranked(probed.where("not done")).where(F.col("rank") <= HEADS * k).select(*keys, "doc_id")
    whole_heads = (
        heads.join(terms.select(*keys, "term", "w"), keys)
        .join(index.postings.select("doc_id", "term", "tf", "len"), ["doc_id", "term"])
        .groupBy(*keys, "doc_id")
        .agg(F.sum(part).alias("s"))
    )
    floors = (
        ranked(whole_heads)
        .where(F.col("rank") == k)
        .select(*keys, (F.col("s") * (1 - SLACK) - SLACK).alias("floor"))
    )
    by_top = Window.partitionBy(*keys).orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
    lifted = terms.where("not done").join(floors, keys, "left").na.fill(0.0, ["floor"])
    lifted = lifted.withColumn("lifts", F.sum("top").over(by_top) >= F.col("floor"))
    rest = F.sum(F.when(~F.col("lifts"), F.col("top")).otherwise(0.0)).over(own)
    lifted = cut_lineage(lifted.withColumn("rest", rest))

    by_block = Window.partitionBy(*keys, "block")
    blocks = (
        lifted.where("lifts")
        .join(index.bounds, "term")
        .withColumn("bound", F.sum(part).over(by_block) + F.col("rest"))
        .where("bound >= floor")
        .select(*keys, "term", "block", "w")
    )
    known = partial(blocks, ["term", "block"])
    limits = lifted.select(*keys, "floor", "rest").distinct()
    candidates = cut_lineage(
        known.join(limits, keys).where("s + rest >= floor").select(*known.columns)
    )
    others = lifted.where("not lifts").select(*keys, "term", "w")
    more = (
        candidates.select(*keys, "doc_id")
        .join(others, keys)
        .join(index.postings.select("doc_id", "term", "tf", "len"), ["doc_id", "term"])
        .groupBy(*keys, "doc_id")
        .agg(F.sum(part).alias("more"))
    )
    full = candidates.join(more, [*keys, "doc_id"], "left").select(
        *keys, "doc_id", "db", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s")
    )
    scored = probed.where("done").select(*full.columns).unionByName(full)
    scored = scored.select(
        "doc_id", "db", *keys, F.round("s", SCORE_DIGITS).alias("score")
    )
    return Pruned(lifted, probed, blocks, candidates, scored)


def _alone(keys: list[str]) -> Column:
    """A home that no term is: the query's own."""
    return F.concat(F.lit("\0"), F.xxhash64(*keys).cast("string"))


def _listed(index: Bm25Index, asked: DataFrame, keys: list[str], grid: list[tuple[float, float]], k: int) -> DataFrame:
    """(home, keys…, pair, doc_id, db, s) of all documents that share a term with a query, by shuffles.

    A query's home is one of its terms: the hits of that term are summed up where its
    postings are, and one shuffle brings the hits of the other terms there. Widespread
    terms that nobody asks for stay where they are.
    """
    avg, n = index.stats.select("avg_len").scalar(), index.stats.select("n_docs").scalar()
    wide = index.df.where(F.col("df") * WIDE > n).select("term").join(asked, "term", "left_anti")
    postings = index.postings.drop("block").join(F.broadcast(wide), "term", "left_anti")
    hit = [*keys, "doc_id", "db", "tf", "len", "w"]
    own = postings.join(asked.where("term = home").drop("home"), "term").select(F.col("term").alias("home"), *hit)
    moved = postings.join(asked.where("term <> home"), "term").select("home", *hit).repartition("home")
    sums = [
        F.sum(_tf_part(F.col("tf"), F.col("len"), avg, k1, b) * F.col("w")).alias(f"s{i}")
        for i, (k1, b) in enumerate(grid)
    ]
    pairs = [F.struct(F.lit(i).alias("pair"), F.col(f"s{i}").alias("s")) for i in range(len(grid))]
    return own.unionByName(moved).groupBy("home", *keys, "doc_id", "db").agg(*sums).select(
        "home", *keys, "doc_id", "db", F.inline(F.array(*pairs))
    ).select("home", *keys, "pair", "doc_id", "db", "s")


def grid_runs(
    index: Bm25Index, queries: DataFrame, grid: list[tuple[float, float]], k: int = CUTOFF
) -> DataFrame:
    """run(home, pair, keys…, doc_id, db, score, rank): exact top-k for each (k1, b), by its number.

    Queries whose terms have few postings list them; the others meet all
    documents block by block, where only the best are kept. All rows of a query
    have one ``home``; grouped by it as well, a run of the first kind is not shuffled.
    """
    weighted, keys = _weighted(index, queries)
    asked = query_terms(queries).groupBy("term").agg(F.count(F.lit(1)).alias("asked"))
    own = Window.partitionBy(*keys)
    uses = F.sum("df").over(own)
    few = (uses <= PROBED * k) | (uses * WIDE <= index.stats.select("n_docs").scalar())
    most = F.max(F.when(F.col("df") * F.col("asked") <= HOME_HITS, F.struct("df", "term"))).over(own)
    terms = cut_lineage(
        weighted.join(asked, "term")
        .withColumns({"few": few, "home": F.coalesce(most["term"], _alone(keys))})
        .select(*keys, "term", "w", "few", F.when(F.col("few"), F.col("home")).alias("home"))
    )
    listed = _listed(index, terms.where("few").drop("few"), keys, grid, k)
    order = ["home", "pair", *keys]
    shown = F.round("s", SCORE_DIGITS).alias("score")
    columns = [*order, "doc_id", "db", shown]
    run = top_k(listed.select(*columns), order, k)
    many = terms.where("not few").drop("few", "home")
    if many.isEmpty():
        return run
    avg = index.stats.first().avg_len
    packs = cut_lineage(packed(index.vectors.where("doc_id is not null")), wide=True)
    met = best_of_blocks(packs, many, keys, avg, grid, k).withColumn("home", _alone(keys))
    return run.unionByName(top_k(met.select(*columns), order, k))


def search(
    index: Bm25Index, queries: DataFrame, k: int = CUTOFF, k1: float = K1, b: float = B, homes: bool = False
) -> DataFrame:
    """run(keys…, doc_id, db, score, rank): exact top-k of queries(keys…, text).

    With ``homes`` the column home says where the rows of a query are (see grid_runs).
    """
    keys = [c for c in queries.columns if c != "text"]
    run = grid_runs(index, queries, [(k1, b)], k)
    return run.select("doc_id", "db", *keys, "score", "rank", *["home"] * homes)


def _own(run: DataFrame) -> list[str]:
    """The columns that tell a question; with its home, its rows are grouped where they are."""
    return ["home", "qid"] if "home" in run.columns else ["qid"]


def roll_up(run: DataFrame) -> DataFrame:
    """(qid, db, score): mean score of a database's retrieved documents; run may have a home."""
    scores = run.groupBy(*_own(run), "db").agg(rounded(F.avg("score")).alias("score"))
    return scores.select("qid", "db", "score")


def predicted_rows(run: DataFrame, top: int = TOP_DATABASES) -> DataFrame:
    """run with (db_score, db_rank): rows of the best databases of each question.

    One pass over the run, which is already grouped by question.
    """
    by_db = Window.partitionBy(*_own(run), "db")
    order = Window.partitionBy(*_own(run)).orderBy(F.desc("db_score"), F.asc("db"))
    return (
        run.withColumn("db_score", rounded(F.avg("score").over(by_db)))
        .withColumn("db_rank", F.dense_rank().over(order))
        .where(F.col("db_rank") <= top)
    )


def predicted_schemas(run: DataFrame, queries: DataFrame, top: int = TOP_DATABASES) -> DataFrame:
    """pred(qid, pred_schemas): best databases with their documents in rank order.

    A list holds at most the run's cutoff of documents. Questions that retrieved
    nothing keep an empty list.
    """
    rows = predicted_rows(run, top)
    schemas = rows.groupBy(*_own(run), "db_rank", "db").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("t")))),
            lambda x: x["t"],
        ).alias("tables")
    )
    pred = schemas.groupBy(*_own(run)).agg(
        F.transform(
            F.sort_array(
                F.collect_list(F.struct("db_rank", F.col("db").alias("database"), "tables"))
            ),
            lambda x: x.dropFields("db_rank"),
        ).alias("pred_schemas")
    )
    empty = F.array().cast("array<struct<database:string,tables:array<string>>>")
    return queries.select("qid").join(pred.select("qid", "pred_schemas"), "qid", "left").select(
        "qid", F.coalesce("pred_schemas", empty).alias("pred_schemas")
    )


def beam_aggregate(beams: DataFrame) -> DataFrame:
    """pred(qid, pred_schemas) of decoded beams(qid, beam, database, tables).

    Databases in first-seen order, tables by frequency, then first seen. Counts
    are taken per table before the lists are gathered.
    """
    tables = beams.select(
        "qid", "database", "beam", F.posexplode_outer("tables").alias("pos", "tbl")
    )
    counted = tables.groupBy("qid", "database", "tbl").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("beam", "pos")).alias("first")
    )
    listed = counted.groupBy("qid", "database").agg(
        F.min("first.beam").alias("seen"),
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("tbl").isNotNull(), F.struct((-F.col("n")).alias("m"), "first", "tbl")
                    )
                )
            ),
            lambda x: x["tbl"],
        ).alias("tables"),
    )
    return listed.groupBy("qid").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seen", "database", "tables"))),
            lambda x: x.dropFields("seen"),
        ).alias("pred_schemas")
    )


def autotune(
    index: Bm25Index,
    queries: DataFrame,
    qrels: DataFrame,
    grid: list[tuple[float, float]],
    k: int = CUTOFF,
    at: int = 10,
) -> DataFrame:
    """(k1, b, recall): mean recall@``at`` of every parameter pair, in one job.

    All pairs are scored side by side over the same documents; only the best
    rows of each are kept.
    """
    keys = [c for c in queries.columns if c != "text"]
    pairs_of = F.array(
        *[F.struct(F.lit(float(x)).alias("k1"), F.lit(float(y)).alias("b")) for x, y in grid]
    )
    run = grid_runs(index, queries, grid, min(k, at)).select(
        *keys, "doc_id", F.get(pairs_of, F.col("pair")).alias("p")
    ).select(*keys, "doc_id", "p.*")
    found = run.join(qrels.select(*keys, "doc_id"), [*keys, "doc_id"]).groupBy("k1", "b", *keys).agg(
        F.count(F.lit(1)).alias("tp")
    )
    gold = qrels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rel"))
    pairs = gold.select(
        *keys,
        "n_rel",
        F.inline(pairs_of),
    )
    per_query = pairs.join(found, ["k1", "b", *keys], "left")
    return per_query.groupBy("k1", "b").agg(
        rounded(F.avg(F.coalesce("tp", F.lit(0)) / F.col("n_rel"))).alias("recall")
    )


def best_parameters(tuned: DataFrame) -> DataFrame:
    """The parameter pair of the best recall; ties go to the smaller pair."""
    return tuned.orderBy(F.desc("recall"), "k1", "b").limit(1)


def tune(
    index: Bm25Index,
    queries: DataFrame,
    qrels: DataFrame,
    grid: list[tuple[float, float]],
    shares: tuple[float, ...] = (0.25, 0.5, 1.0),
    at: int = 10,
    seed: str = "tune",
) -> tuple[float, float]:
    """The parameter pair of the best recall@``at``, by successive halving.

    Each round measures the pairs that are left on a larger seeded share of the
    queries and keeps the better half; the last round uses all queries. Ties go
    to the smaller pair. Only queries with relevant documents count.
    """
    keys = [c for c in queries.columns if c != "text"]
    draw = unit_draw(F.lit(seed), *keys)
    left = sorted((float(k1), float(b)) for k1, b in grid)
    for share in shares:
        asked, wanted = queries.where(draw < share), qrels.where(draw < share)
        found = autotune(index, asked, wanted, left, at, at).collect()
        order = {(r.k1, r.b): -r.recall for r in found}
        left = sorted(left, key=lambda pair: (order.get(pair, 0.0), pair))
        left = sorted(left[: max(1, -(-len(left) // 2))])
    best = min(left, key=lambda pair: (order.get(pair, 0.0), pair))
    return best


def few_shot_documents(train: DataFrame) -> DataFrame:
    """Index documents of training questions: (doc_id, db, text, question, sql)."""
    return train.select(
        F.col("qid").alias("doc_id"), "db", F.col("question").alias("text"), "question", "sql"
    )


def few_shot_examples(
    index: Bm25Index, queries: DataFrame, train: DataFrame, columns: DataFrame, k: int = 5
) -> DataFrame:
    """(qid, rank, question, sql, db, tbl_pos, tbl, col_pos, col): the k nearest training
    questions of each question, with the whole schema of their database, flat."""
    run = search(index, queries, k).select("qid", "rank", F.col("doc_id").alias("_doc"))
    shots = run.join(train.withColumnRenamed("qid", "_doc"), "_doc").select(
        "qid", "rank", "question", "sql", "db"
    )
    return shots.join(columns.select("db", "tbl_pos", "tbl", "col_pos", "col"), "db")
