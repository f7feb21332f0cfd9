"""Registered queries over the given tables, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewright.llm import (
    ball_search,
    chat_snapshots,
    context_mixing,
    exact_dedup,
    hamming_search,
    language_id,
    line_rules,
    mixing,
    near_dup,
    packing,
    quality,
    token_alignment,
    url_rules,
)
from routewright.llm.common import load


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.render(load(spark, sf_dir, "conversations"))


def op3_association_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(load(spark, sf_dir, "pages")).drop("met_tokens")


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.decompose(load(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "bucket",
    )


def op5_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return hamming_search.search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.label(load(spark, sf_dir, "documents"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup(load(spark, sf_dir, "documents"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(load(spark, sf_dir, "documents"))


def op10_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(load(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "source", "copies",
    )


def alignment_rows(aligned: DataFrame, most: int = token_alignment.FREQUENT_PAIRS) -> DataFrame:
    """Counts of the links, with a digest in place of the groups."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    digested = aligned.withColumn("groups_sha256", digest).drop("groups")
    return token_alignment.count_links(digested, most=most)


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_rows(token_alignment.align(load(spark, sf_dir, "documents")))


def op12_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (load(spark, sf_dir, t) for t in ("documents", "labels"))
    return line_rules.judge(docs, labels).drop("boilerplate")


QUERIES = {
    f.__name__: f
    for f in (
        op1_bradley_terry_quality,
        op2_snapshot_collapse,
        op3_association_url_rules,
        op4_power_of_two_packing,
        op5_heavy_hitter_dedup,
        op6_multi_index_hashing,
        op7_crf_language_id,
        op8_bbit_minhash,
        op9_context_mixing,
        op10_pivotal_mixing,
        op11_interval_alignment,
        op12_ball_tree_search,
        op13_line_labelling,
    )
}

ORACLE = {
    "op2_snapshot_collapse": """
WITH t0 AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t0),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS said FROM t GROUP BY conv_id),
begun AS (SELECT DISTINCT said[1:n] AS said FROM (SELECT said, unnest(range(1, len(said))) AS n FROM c)),
kept AS (SELECT min(conv_id) AS conv_id, len(said) AS n_turns FROM c
  WHERE said NOT IN (SELECT said FROM begun) GROUP BY said)
SELECT conv_id, (pos - 1) // 1024 AS part, n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN kept USING (conv_id) GROUP BY ALL""",
    "op6_multi_index_hashing": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0 AND NOT isnan(x), FALSE)) AS code
  FROM embeddings WHERE len(embedding) = 64),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
    len(list_filter(list_zip(q.code, v.code), lambda x: x[1] <> x[2]))::INT AS distance
  FROM e q, e v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, distance, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id NULLS LAST) AS rank FROM d)
WHERE rank <= 10""",
    "op12_ball_tree_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
stat AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS total FROM d),
uses AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM uses GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM tf, stat GROUP BY term, n_docs),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, row, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term), stat GROUP BY item_id, row, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10""",
    "op5_heavy_hitter_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
