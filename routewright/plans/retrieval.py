"""Retrieval queries: BM25 over documents, dense search, segment cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewright.operators import cover, dense, graph, parsing
from routewright.operators import retrieval as r
from routewright.plans import tables as t

GRID = [(k1, b) for k1 in (0.9, 1.2, 2.0) for b in (0.4, 0.75)]

# Parameters that tuning chooses from, and the shares of the questions of its rounds.
RANGE = [(k1, b) for k1 in (0.6, 0.9, 1.2, 1.6, 2.0) for b in (0.25, 0.5, 0.75, 0.9)]
SHARES = (0.25, 0.5, 1.0)


def _index(spark: SparkSession, d: str) -> r.Bm25Index:
    return r.stored_index(t.documents(spark, d))


def _run(spark: SparkSession, d: str, k: int = r.CUTOFF) -> DataFrame:
    return r.search(_index(spark, d), t.questions(spark, d), k)


def bm25_index(spark, d):
    return r.count_postings(t.documents(spark, d)).where("term is not null")


def bm25_lengths(spark, d):
    return r.build_index(t.documents(spark, d)).lengths


def bm25_search(spark, d):
    return _run(spark, d)


def bm25_autotune(spark, d):
    return r.autotune(_index(spark, d), t.questions(spark, d), t.text_qrels(spark, d), GRID)


def bm25_search_tuned(spark, d):
    """Search with the parameters that tuning finds best."""
    index, questions = _index(spark, d), t.questions(spark, d)
    k1, b = r.tune(index, questions, t.keep(t.text_qrels(spark, d)), RANGE, SHARES)
    return r.search(index, questions, k1=k1, b=b).withColumns({"k1": F.lit(k1), "b": F.lit(b)})


def db_rollup(spark, d):
    return r.roll_up(_run(spark, d))


def _flat_pred(pred: DataFrame) -> DataFrame:
    return pred.select(
        "qid", F.posexplode_outer("pred_schemas").alias("pos", "s")
    ).select(
        "qid",
        F.col("pos").cast("bigint").alias("db_pos"),
        F.col("s.database").alias("db"),
        F.array_join("s.tables", ",").alias("tables"),
    )


def pred_schemas(spark, d):
    q = t.questions(spark, d)
    return _flat_pred(r.predicted_schemas(r.search(_index(spark, d), q), q))


def decoded_beams(spark, d):
    text = parsing.strip_special_tokens(F.col("text"), ["<s>", "<pad>", "</s>"])
    return t.beams(spark, d).select("qid", "beam", graph.deserialise(text, t.SEP).alias("s")).select(
        "qid", "beam", "s.database", "s.tables"
    )


def beam_predictions(spark, d):
    return r.beam_aggregate(decoded_beams(spark, d))


def beam_aggregate(spark, d):
    return _flat_pred(beam_predictions(spark, d))


def _train(spark, d) -> DataFrame:
    """Every conversation turn is a training question of its conversation."""
    turns = t.load(spark, d, "conversations")
    return turns.select(
        (F.col("conv_id") * t.TURNS + F.col("turn")).alias("qid"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("db"),
        F.col("text").alias("question"),
        F.concat(F.lit("SELECT "), "role").alias("sql"),
    )


def _train_columns(spark, d) -> DataFrame:
    """The turns of a conversation are the tables of its database."""
    turns = t.load(spark, d, "conversations")
    return turns.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("db"),
        F.col("turn").alias("tbl_pos"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("tbl"),
        F.lit(0).alias("col_pos"),
        F.col("role").alias("col"),
    )


def few_shot_docs(spark, d):
    return r.few_shot_documents(_train(spark, d))


def few_shot_examples(spark, d):
    train = _train(spark, d)
    index = r.stored_index(r.few_shot_documents(train))
    return r.few_shot_examples(index, t.questions(spark, d), train, _train_columns(spark, d)).select(
        "qid", "rank", "question", "sql", "db", "tbl", "col"
    )


def _segment_queries(spark, d) -> DataFrame:
    q = t.questions(spark, d).withColumnRenamed("text", "question")
    return cover.segment_queries(q, t.segments(spark, d))


def segment_queries(spark, d):
    return _segment_queries(spark, d)


def _matrix(spark, d) -> tuple[DataFrame, DataFrame]:
    q = _segment_queries(spark, d)
    return cover.score_matrix(r.search(_index(spark, d), q)), q


def segment_score_matrix(spark, d):
    return _matrix(spark, d)[0].select("qid", "sid", "doc_id", "score", "best", "n_docs")


def segment_entropy_weight(spark, d):
    matrix, q = _matrix(spark, d)
    return cover.segment_weights(matrix, q).select(
        "qid", "sid", F.round("entropy", 6).alias("entropy"), F.round("weight", 6).alias("weight")
    )


def _covered(spark, d) -> DataFrame:
    matrix, q = _matrix(spark, d)
    # the run feeds both the weights and the choice: search once
    matrix = t.keep(matrix)
    weights = cover.segment_weights(matrix, q)
    # Equal weights must stay equal, whatever the order of a sum.
    return cover.greedy_cover(matrix, weights.withColumn("weight", F.round("weight", 6)))


def segment_cover_greedy(spark, d):
    return _covered(spark, d).withColumn("score", F.round("score", 6))


def covered_pred_schemas(spark, d):
    return _flat_pred(r.predicted_schemas(_covered(spark, d), t.questions(spark, d)))


def masked_mean_pool(spark, d):
    return (
        dense.masked_mean_pool(t.label_vectors(spark, d))
        .select("text_id", F.posexplode("vec").alias("dim", "x"))
        .withColumn("x", F.round("x", 6))
    )


def cls_pool(spark, d):
    return dense.cls_pool(t.label_vectors(spark, d)).select(
        "text_id", F.posexplode("vec").alias("dim", "x")
    ).withColumn("x", F.round(F.col("x").cast("double"), 6))


def dense_run(spark, d, k: int = 100) -> DataFrame:
    q = dense.masked_mean_pool(t.label_vectors(spark, d)).withColumnRenamed("text_id", "qid")
    return dense.dense_search(q, t.vectors(spark, d), k)


def dense_search(spark, d):
    return dense_run(spark, d)


def _vector_run(spark, d, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth vector asks for its neighbours; a label is a database."""
    asked = t.vectors(spark, d).where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid")
    dbs = t.load(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("db")
    )
    run = dense.dense_search(asked, t.vectors(spark, d), k)
    return run.join(dbs, "doc_id").select("qid", "doc_id", "db", "score", "rank"), asked


def dense_vector_search(spark, d):
    return _vector_run(spark, d)[0]


def dense_db_rollup(spark, d):
    return r.roll_up(_vector_run(spark, d)[0])


def dense_pred_schemas(spark, d):
    return _flat_pred(r.predicted_schemas(*_vector_run(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_index,
        bm25_lengths,
        bm25_search,
        bm25_autotune,
        bm25_search_tuned,
        db_rollup,
        pred_schemas,
        beam_aggregate,
        few_shot_docs,
        few_shot_examples,
        segment_queries,
        segment_score_matrix,
        segment_entropy_weight,
        segment_cover_greedy,
        covered_pred_schemas,
        masked_mean_pool,
        cls_pool,
        dense_search,
        dense_vector_search,
        dense_db_rollup,
        dense_pred_schemas,
    )
}

_SEARCH = f"WITH {t.BM25}, {t.BENCH}, {t.bm25_run('bench', 'qid', 100)}"
_SEG = f"WITH {t.BM25}, {t.SEGMENTS}, {t.bm25_run('segq', 'qid, sid', 100)}"


def _beams_sql() -> str:
    return f"""WITH {t.LINES},
beams AS (
  SELECT ok AS qid, j - 1 AS beam, CASE WHEN rf = 'N' THEN 'o' || ok ELSE 'o' || pk END AS db,
         ['s' || sk, 's' || ln] AS tables FROM lines),
one AS (SELECT qid, beam, db, unnest(tables) AS tbl, generate_subscripts(tables, 1) AS pos FROM beams),
cnt AS (SELECT qid, db, tbl, count(*) AS n, min(beam * 10 + pos) AS first FROM one GROUP BY ALL),
lst AS (SELECT qid, db, min(first) AS seen,
        string_agg(tbl, ',' ORDER BY n DESC, first) AS tables FROM cnt GROUP BY qid, db)"""


def _scores_sql(grid: list[tuple[float, float]]) -> str:
    """``sc``: every document's score for every question and parameter pair."""
    wide = ", ".join(f"({k1}::DOUBLE, {b}::DOUBLE)" for k1, b in grid)
    return f"""WITH {t.BM25}, {t.BENCH}, {t.TEXT_REL},
grid(k1, b) AS (VALUES {wide}),
qt AS (SELECT qid, term, count(*) AS qtf FROM (
  SELECT qid, unnest({t.words('text')}) AS term FROM bench) GROUP BY ALL),
sc AS (
  SELECT k1, b, qid, doc_id, db, round(sum(qtf * idf * tf * (k1 + 1)
    / (tf + k1 * (1 - b + b * n / avg_len))), 6) AS score
  FROM qt JOIN dfs USING (term) JOIN post USING (term) JOIN len USING (doc_id), st, grid
  GROUP BY k1, b, qid, doc_id, db),
run AS (SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY score DESC, doc_id) AS rank FROM sc),
per AS (SELECT k1, b, qid, coalesce(tp, 0) / n AS r
  FROM (SELECT qid, count(*) AS n FROM trel GROUP BY qid) g CROSS JOIN grid
  LEFT JOIN (SELECT k1, b, run.qid, count(*) AS tp FROM run JOIN trel USING (qid, doc_id) WHERE rank <= 10
    GROUP BY ALL) f USING (k1, b, qid))"""


def _halving_sql() -> str:
    """``winner``: the pair that is left after each round keeps the better half."""
    rounds, left, n = [], "grid", len(RANGE)
    for i, share in enumerate(SHARES):
        n = -(-n // 2) if i < len(SHARES) - 1 else 1
        rounds.append(f"""left{i} AS (SELECT k1, b FROM {left} LEFT JOIN (
    SELECT k1, b, round(avg(r) + 1e-9, 6) AS recall FROM per WHERE {t.draw("'tune|' || qid")} < {share} GROUP BY k1, b)
  USING (k1, b) ORDER BY coalesce(recall, 0) DESC, k1, b LIMIT {n})""")
        left = f"left{i}"
    return ",\n".join(rounds)


_MATRIX = f"""{_SEG},
best AS (SELECT qid, doc_id, max(score) AS best FROM run GROUP BY ALL),
nd AS (SELECT qid, count(*) AS n_docs FROM best GROUP BY qid)"""

_VECTORS = """WITH e AS (SELECT vec_id, 'l' || label AS db, embedding::DOUBLE[] AS v FROM embeddings),
sc AS (SELECT q.vec_id AS qid, x.vec_id AS doc_id, x.db, round(list_cosine_similarity(q.v, x.v), 6) AS score
  FROM e q, e x WHERE q.vec_id % 50 = 0),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc)
  WHERE rank <= 100)"""

_WEIGHTS = f"""{_MATRIX},
full_m AS (
  SELECT qid, sid, b.doc_id, (coalesce(score, 0) + 1) / 2 AS c
  FROM segq JOIN best b USING (qid) LEFT JOIN run USING (qid, sid, doc_id)),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY qid, sid) AS p FROM full_m),
e AS (SELECT qid, sid, -sum(p * ln(p)) AS entropy FROM p GROUP BY ALL),
sw AS (SELECT qid, sid, round(entropy, 6) AS entropy,
  round(1 / (1 + exp(-(avg(entropy) OVER (PARTITION BY qid) - entropy))), 6) AS weight FROM e)"""

# One pick per round: the best cell of an uncovered segment and an unused document.
_COVER = f"""{_WEIGHTS.replace('WITH ', 'WITH RECURSIVE ', 1)},
nos AS (SELECT qid, doc_id, any_value(db) AS db,
  row_number() OVER (PARTITION BY qid ORDER BY min(sid * 1000 + rank)) AS docno FROM run GROUP BY qid, doc_id),
cells AS (SELECT sw.qid, sw.sid, docno, coalesce((score + 1) / 2, 0.5) * weight AS gain
  FROM sw JOIN nos USING (qid) LEFT JOIN run ON run.qid = sw.qid AND run.sid = sw.sid AND run.doc_id = nos.doc_id),
sizes AS (SELECT qid, count(DISTINCT sid) AS n_segs, least(20, count(DISTINCT docno)) AS most FROM cells GROUP BY qid),
state AS (
  SELECT qid, 0 AS i, []::BIGINT[] AS covered, []::BIGINT[] AS used, NULL::DOUBLE AS gain FROM sizes
  UNION ALL
  SELECT qid, i + 1,
    CASE WHEN len(covered) + 1 = n_segs THEN []::BIGINT[] ELSE list_append(covered, best.sid) END,
    list_append(used, best.docno), -best.g
  FROM (SELECT state.qid, i, covered, used, n_segs,
      min({{'g': -c.gain, 'sid': c.sid, 'docno': c.docno}}) AS best
    FROM state JOIN sizes USING (qid) JOIN cells c ON c.qid = state.qid
      AND NOT list_contains(covered, c.sid) AND NOT list_contains(used, c.docno)
    WHERE i < most GROUP BY state.qid, i, covered, used, n_segs)),
picked AS (SELECT state.qid, nos.doc_id, nos.db, gain AS score, i AS rank
  FROM state JOIN nos ON nos.qid = state.qid AND nos.docno = used[i] WHERE i > 0)"""

ORACLE = {
    "segment_cover_greedy": f"""{_COVER}
SELECT qid, doc_id, db, round(score, 6) AS score, rank::INT AS rank FROM picked""",
    "covered_pred_schemas": f"""{_COVER},
dbs AS (SELECT qid, db, round(avg(score) + 1e-9, 6) AS s, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS tables
  FROM picked GROUP BY qid, db),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, db) - 1 AS db_pos FROM dbs)
SELECT b.qid, db_pos, db, tables FROM (SELECT item_id AS qid FROM benchmark) b LEFT JOIN (SELECT * FROM top WHERE db_pos < 5) USING (qid)""",
    "bm25_index": f"WITH {t.BM25} SELECT doc_id, db, term, tf FROM post",
    "bm25_lengths": f"WITH {t.BM25} SELECT doc_id, n::BIGINT AS len FROM len",
    "bm25_search": f"{_SEARCH} SELECT qid, doc_id, db, score, rank::INT AS rank FROM run",
    "bm25_autotune": f"{_scores_sql(GRID)} SELECT k1, b, round(avg(r) + 1e-9, 6) AS recall FROM per GROUP BY k1, b",
    "bm25_search_tuned": f"""{_scores_sql(RANGE)}, {_halving_sql()}
SELECT qid, doc_id, db, score, rank::INT AS rank, k1, b
FROM run JOIN left{len(SHARES) - 1} USING (k1, b) WHERE rank <= 100""",
    "db_rollup": f"{_SEARCH} SELECT qid, db, round(avg(score) + 1e-9, 6) AS score FROM run GROUP BY ALL",
    "pred_schemas": f"""{_SEARCH},
dbs AS (SELECT qid, db, round(avg(score) + 1e-9, 6) AS s, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS tables
  FROM run GROUP BY qid, db),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, db) - 1 AS db_pos FROM dbs)
SELECT b.qid, db_pos, db, tables FROM bench b LEFT JOIN (SELECT * FROM top WHERE db_pos < 5) USING (qid)""",
    "beam_aggregate": f"""{_beams_sql()}
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY seen) - 1 AS db_pos, db, tables FROM lst""",
    "few_shot_docs": f"""SELECT conv_id * {t.TURNS} + turn AS doc_id, 'c' || conv_id AS db, text,
  text AS question, 'SELECT ' || role AS sql FROM conversations""",
    "few_shot_examples": f"""WITH docs AS (
  SELECT conv_id * {t.TURNS} + turn AS doc_id, 'c' || conv_id AS source, text, role, conv_id
  FROM conversations), {t.BM25.replace('FROM documents', 'FROM docs')}, {t.BENCH},
{t.bm25_run('bench', 'qid', 5)}
SELECT qid, rank::INT AS rank, d.text AS question, 'SELECT ' || d.role AS sql, d.source AS db,
  't' || c.turn AS tbl, c.role AS col
FROM run JOIN docs d USING (doc_id) JOIN conversations c USING (conv_id)""",
    "segment_queries": f"WITH {t.SEGMENTS} SELECT qid, sid::INT AS sid, text FROM segq",
    "segment_score_matrix": f"""{_MATRIX}
SELECT qid, sid::INT AS sid, doc_id, score, best, n_docs
FROM run JOIN best USING (qid, doc_id) JOIN nd USING (qid)""",
    "segment_entropy_weight": f"{_WEIGHTS} SELECT qid, sid::INT AS sid, entropy, weight FROM sw",
    "masked_mean_pool": f"""WITH {t.POOLED}
SELECT qid::BIGINT AS text_id, dim::INT AS dim, round(x, 6) AS x FROM pooled""",
    "cls_pool": """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)
SELECT label::BIGINT AS text_id, (generate_subscripts(v, 1) - 1)::INT AS dim,
  round(unnest(v)::DOUBLE, 6) AS x FROM f""",
    "dense_vector_search": f"{_VECTORS} SELECT qid, doc_id, db, score, rank::INT AS rank FROM run",
    "dense_db_rollup": f"{_VECTORS} SELECT qid, db, round(avg(score) + 1e-9, 6) AS score FROM run GROUP BY ALL",
    "dense_pred_schemas": f"""{_VECTORS},
dbs AS (SELECT qid, db, round(avg(score) + 1e-9, 6) AS s, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS tables
  FROM run GROUP BY qid, db),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, db) - 1 AS db_pos FROM dbs)
SELECT qid, db_pos, db, tables FROM top WHERE db_pos < 5""",
    "dense_search": f"""WITH {t.POOLED},
sc AS (SELECT qid::BIGINT AS qid, vec_id AS doc_id,
  round(list_cosine_similarity(vec, embedding::DOUBLE[]), 6) AS score FROM qvec, embeddings)
SELECT qid, doc_id, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc)
WHERE rank <= 100""",
}
