"""Packing by power-of-two decomposition.

A document's ids are cut at the binary digits of their number: as many pieces
of the longest length as fit, then one piece for each binary digit of the rest,
longest first. Every piece is a sequence of its own. Sequences of equal length
share a bucket, so a reader fills batches without padding and no sequence holds
two documents.

Defined results: null and empty texts have the end id alone; rows that repeat
are packed each time; an empty table gives an empty result. Ids and cuts depend
on the text only; ``sequence_id`` numbers the pieces in the order in which the
tasks make them.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm.common import coded, slices, words_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
LONGEST = 4096
# Distinct words whose ids a worker remembers; others are encoded again.
KNOWN_WORDS = 400_000
# Bytes of text that are encoded at once.
AT_ONCE = 2 << 20
# The tokenizer's own results are large; they are read off in small lots.
ENCODED_AT_ONCE = 2048

_PLAIN = re.compile(r"([a-z]+)([.,]*)")
_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


class WordEncoder:
    """Ids of texts, word by word.

    The tokenizer cuts at white space before it merges and takes A-Z for a-z, so
    a word's ids depend neither on its neighbours nor on that case, and each
    distinct word of a batch is encoded once. Special tokens keep their case.
    """

    def __init__(self, vocabulary: str):
        # A task has one core; the tokenizer's own threads would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._model = self._tokenizer.model
        self._place: dict[str, int] = {}
        # Ids of the known words one after another, and where each word's begin.
        self._ids = np.zeros(0, dtype="<u4")
        self._ends = np.zeros(1, dtype=np.int64)

    def _merged(self, word: str, mark: str) -> list[int]:
        """Ids of a-z and of what follows: no normalising or cutting is left to do."""
        ids = [t.id for t in self._model.tokenize(word)]
        return ids + [t.id for t in self._model.tokenize(mark)] if mark else ids

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Their ids one after another, and where each word's begin."""
        flat, sizes = array("I"), array("q")
        for a in range(0, len(words), ENCODED_AT_ONCE):
            some = words[a : a + ENCODED_AT_ONCE]
            plain = [_PLAIN.fullmatch(w) for w in some]
            rest = [w for w, p in zip(some, plain, strict=True) if not p]
            found = iter(self._tokenizer.encode_batch_fast(rest, add_special_tokens=False))
            for p in plain:
                ids = self._merged(*p.groups()) if p else next(found).ids
                flat.extend(ids)
                sizes.append(len(ids))
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        return np.array(flat, dtype="<u4"), ends

    def _look_up(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids at hand, and where each word's begin and end."""
        place = np.fromiter(
            (self._place.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct)
        )
        missing = np.flatnonzero(place < 0)
        new = [distinct[i] for i in missing]
        ids, ends = self._encode_words(new)
        kept = min(len(new), KNOWN_WORDS - len(self._place))
        known = len(self._place)
        all_ids = np.concatenate([self._ids, ids])
        all_ends = np.concatenate([self._ends, self._ends[-1] + ends[1:]])
        place[missing] = known + np.arange(len(new))
        for i, w in enumerate(new[:kept]):
            self._place[w] = known + i
        self._ends = all_ends[: known + kept + 1].copy()
        self._ids = all_ids[: self._ends[-1]].copy()
        return all_ids, all_ends[place], all_ends[place + 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Id boundaries per text (one more than texts) and all ids in order."""
        at, words = words_of(texts, lower=False)
        special = pc.match_substring(words, "<|")
        code, distinct = coded(pc.if_else(special, words, pc.ascii_lower(words)))
        flat, first, last = self._look_up(distinct)
        n = (last - first)[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])
        return ends[at], flat[take]


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of n ids: whole ``longest`` ones, then the binary digits."""
    whole, rest = divmod(n, longest)
    digits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return [longest] * whole + digits


def decompose(
    docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, longest: int = LONGEST
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit ids. ``longest`` is a power of
    two. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                ends, ids = encoder.encode(part.column("text"))
                rows, starts, lengths, totals, blobs = [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.concatenate([ids[ends[i] : ends[i + 1]], end])
                    start = 0
                    for length in binary_lengths(len(own), longest):
                        rows.append(i)
                        starts.append(start)
                        lengths.append(length)
                        totals.append(len(own))
                        blobs.append(own[start : start + length].tobytes())
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, _PIECES
    )
    return pieces.select(
        "*",
        F.log2(F.col("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per bucket, so batches are drawn from sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)
