import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import rows as R
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routewright.llm import queries as Q
from routewright.llm import token_alignment as T

_A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_CHAR = T.byte_level_alphabet()
_ALIGNER = T.Aligner(T.VOCABULARY_A, T.VOCABULARY_B)

ODD = [
    "▁ as a char", "a ▁", "<|endoftext|> x", "</s> <s> <unk> <0x41>", " ", "  ", "\n", "a ", "a \n b",
    "\n\n  foo  bar\t\tbaz \r\n", "x  y", "a　\n b", "\x00 \x1c \x1f a", "é É \U0001f600‍\U0001f469",
    "don't we'll  I'm", "12345 678,90", "a\x0b b\x0c c\rd", ";\r x;\r\n", "中文 рус", "a" * 3000,
]


def _plain(text):
    """Tokens, groups and links by walking the bytes."""
    none = ([], [], "", [])
    if not text:
        return none
    raw = (" " + text).encode()
    a = [(i, bytes(_CHAR[c] for c in _A.id_to_token(i))) for i in _A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in _B.encode(text):
        p = _B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if _B.is_byte(i) else p.replace("▁", " ").encode()))
    if any(b"".join(x[1] for x in side) != raw for side in (a, b)):
        return none
    ends = [set(np.cumsum([len(x[1]) for x in side]).tolist()) for side in (a, b)]
    stops = sorted(ends[0] & ends[1])
    links = []
    spans = []
    for side in (a, b):
        at, own = 0, []
        for i, piece in side:
            own.append((at, at + len(piece), i))
            at += len(piece)
        spans.append(own)
    parts = [[[], []] for _ in stops]
    for k, own in enumerate(spans):
        for _, e, i in own:
            parts[bisect.bisect_left(stops, e)][k].append(str(i))
    groups = ["|".join(map(",".join, p)) for p in parts]
    j = 0
    for s, e, i in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    return [x[0] for x in a], [x[0] for x in b], ";".join(groups), links


def _expected(docs):
    plain = [(d[0], _plain(d[1])) for d in docs]
    count = Counter(p for _, x in plain for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(
        (
            (
                d, len(a), len(b), g.count("|") if g else 0, len(links), sum(count[p] == best[p[0]] for p in links),
                sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if a else "",
            )
            for d, (a, b, g, links) in plain
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def docs():
    return R.documents() + [(3000 + i, t, "en", "s0", 1) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("most", [T.FREQUENT_PAIRS, 40, 0])
def test_rows_are_those_of_a_plain_walk(spark, docs, most):
    aligned = T.align(R.clashing(spark.createDataFrame(docs, R.SCHEMA).repartition(3)))
    got = Q.alignment_rows(aligned, most).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == _expected(docs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé1,.!\n \t\r 　中<|>_"), max_size=25), max_size=4))
def test_cut_texts_have_the_tokens_of_whole_texts(texts):
    got = T.align_texts(_ALIGNER, pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        a, b, groups, links = _plain(t)
        assert got["groups"][i].as_py() == groups and got["n_a"][i].as_py() == len(a)
        assert got["n_b"][i].as_py() == len(b) and got["n_links"][i].as_py() == len(links)
        pairs = Counter(x * _ALIGNER.b_size + y for x, y in links)
        assert dict(zip(got["pairs"][i].as_py(), got["uses"][i].as_py(), strict=True)) == pairs


def test_running_maxima_give_the_groups():
    start, end = np.array([0, 4, 5, 0, 2, 5]), np.array([4, 5, 9, 2, 5, 9])
    assert T.coalesce(start, end).tolist() == [0, 0, 1, 0, 0, 1]


def test_no_frequent_pair_beyond_the_bound(spark):
    counts = spark.range(1, 500).select(F.col("id").alias("pair"), F.col("id").alias("n_docs"))
    least = T.frequent_from(counts, 100)
    n = counts.where(F.floor(F.log2(F.col("n_docs").cast("double")) * 8) >= least).count()
    assert 0 < n <= 100


def test_without_rows(spark):
    assert Q.alignment_rows(T.align(spark.createDataFrame([], R.SCHEMA))).count() == 0
