from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import rows as R
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routewright.llm import packing as P

_TOKENIZER = Tokenizer.from_file(P.VOCABULARY)
_ENCODER = P.WordEncoder(P.VOCABULARY)


def _plain(text):
    return [*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_word_by_word_ids_equal_whole_text_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ends, ids = _ENCODER.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == _plain(t)[:-1]


def test_special_tokens_and_case():
    texts = ["A <|ENDOFTEXT|> <|endoftext|>x", "It's DON'T 4a5", "\u0130I \u212a ALL caps"]
    ends, ids = _ENCODER.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [
        _plain(t)[:-1] for t in texts
    ]


def test_pieces_hold_each_id_once(spark):
    docs = R.documents()
    got = P.decompose(R.clashing(spark.createDataFrame(docs, R.SCHEMA).repartition(3))).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    texts = defaultdict(list)
    for d in docs:
        texts[d[0]].append(_plain(d[1]))
    for doc_id, wanted in texts.items():
        pieces = [r for r in got if r.doc_id == doc_id]
        assert sum(r.length for r in pieces) == sum(map(len, wanted))
        for r in pieces:
            assert r.length & (r.length - 1) == 0 and r.length <= 4096 and 1 << r.bucket == r.length
            own = np.frombuffer(r.ids, "<u4").tolist()
            assert any(w[r.start : r.start + r.length] == own and len(w) == r.doc_tokens for w in wanted)


def test_lengths_are_the_binary_digits():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        cut = P.binary_lengths(n)
        assert sum(cut) == n and cut == sorted(cut, reverse=True)
        assert max(Counter(c for c in cut if c < 4096).values(), default=1) == 1


def test_buckets_are_written(spark, tmp_path):
    pieces = P.decompose(spark.createDataFrame(R.documents(n=9), R.SCHEMA))
    P.write_buckets(pieces, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == pieces.count()
    assert back.where("length <> shiftleft(1, bucket)").count() == 0


def test_without_rows(spark):
    assert P.decompose(spark.createDataFrame([], R.SCHEMA)).count() == 0
