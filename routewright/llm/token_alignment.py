"""Alignment of two tokenizers' tokens by interval coalescing.

A text's tokens of both vocabularies are byte ranges that tile the same bytes.
All ranges, A's and B's together, are sorted by start; where a start reaches
the running maximum of the ends before it, nothing spans that byte and a group
begins. Inside a group every A token is linked to the B tokens it overlaps.

Neither tokenizer joins bytes over a blank or line break that follows a word
(checked on the vocabularies; else texts are taken whole), so a text is cut
there and each distinct piece of a batch is encoded and aligned once.

A reads a space and the text, B the text, before which it puts a space itself.
Defined results: null and empty texts, and texts whose tokens do not spell them
(U+2581 in a text), have no tokens, no groups and no links; rows that repeat are
aligned each and count as documents each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm.common import slices
from routewright.session import cut_lineage

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
# Bytes of text that are aligned at once.
AT_ONCE = 1 << 20
# Pieces that a worker remembers, and their longest; others are aligned again.
KNOWN_PIECES, KNOWN_BYTES = 200_000, 48
# Pairs encoded in one call of a tokenizer.
ENCODED_AT_ONCE = 2048
# At most so many pairs, the most frequent ones, are broadcast with their counts.
FREQUENT_PAIRS = 1 << 18

_SPACE = "\u2581"
# White space beyond ASCII, and what some call so: texts with it are not cut.
_ODD_SPACE = (
    r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
_ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups string, pairs array<bigint>, uses array<bigint>"
)


def byte_level_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: itself where it prints, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group number of each range, by running maxima over the ranges in order of start."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(begins) - 1
    return group


def overlaps(a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A number, B number) of overlapping ranges; both tile the same bytes, ``*_at`` are their cuts."""
    first = np.searchsorted(b_at[1:], a_at[:-1], side="right")
    last = np.searchsorted(b_at[:-1], a_at[1:], side="left")
    n = last - first
    a = np.repeat(np.arange(len(n)), n)
    return a, np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(a))


class Aligner:
    """Tokens, groups and links of pieces of text under both vocabularies."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        # A task has one core; the tokenizer's own threads would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(vocabulary_a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_b)
        alphabet = byte_level_alphabet()
        self._a_bytes = [b""] * self._a.get_vocab_size()
        for entry, i in self._a.get_vocab().items():
            if all(c in alphabet for c in entry):
                self._a_bytes[i] = bytes(alphabet[c] for c in entry)
        n = self.b_size = self._b.vocab_size()
        names = [self._b.id_to_piece(i) for i in range(n)]
        self._b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(names)
        ]
        self._b_space = self._b.piece_to_id(_SPACE)
        self.cuts = names[self._b_space] == _SPACE and not any(
            re.search(f"[^{_SPACE}]{_SPACE}|\n", p) for p in names
        )
        self._a_sizes, self._b_sizes = (
            np.array([len(x) for x in t], dtype=np.int64) for t in (self._a_bytes, self._b_bytes)
        )
        self._known: dict[bytes, tuple] = {}

    def _encode_b(self, pieces: list[str]) -> list[list[int]]:
        """The tokenizer sets a space before each piece; here it is the piece's own or taken off."""
        own = [p.startswith(" ") for p in pieces]
        found = self._b.encode([p[o:] for p, o in zip(pieces, own, strict=True)], num_threads=1)
        return [
            ids if o and ids else [self._b_space] if o else ids[1:]
            for ids, o in zip(found, own, strict=True)
        ]

    def _align(self, raw: list[bytes]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, pairs as bytes) of each piece, None where it is not spelled."""
        pieces = [p.decode() for p in raw]
        a = [e.ids for e in self._a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self._encode_b(pieces)
        out: list = [None] * len(raw)
        spelled = [
            i
            for i, p in enumerate(raw)
            if b"".join([self._a_bytes[t] for t in a[i]]) == p
            and b"".join([self._b_bytes[t] for t in b[i]]) == p
        ]
        a, b = [a[i] for i in spelled], [b[i] for i in spelled]
        a_flat, b_flat = (
            np.array([t for x in side for t in x], dtype=np.int64) for side in (a, b)
        )
        a_at, b_at = (
            np.concatenate([[0], np.cumsum(sizes[flat])])
            for sizes, flat in ((self._a_sizes, a_flat), (self._b_sizes, b_flat))
        )
        group = coalesce(
            np.concatenate([a_at[:-1], b_at[:-1]]), np.concatenate([a_at[1:], b_at[1:]])
        )
        a_group, b_group = group[: len(a_flat)], group[len(a_flat) :]
        left, right = overlaps(a_at, b_at)
        pairs = a_flat[left] * self.b_size + b_flat[right]
        texts = _group_texts(a_flat, a_group, b_flat, b_group)
        a_ends, b_ends = (np.cumsum([0, *map(len, side)]) for side in (a, b))
        # A piece's groups and links are those of its A tokens.
        last = np.append(a_group, len(texts))
        g_ends, l_ends = last[a_ends], np.searchsorted(left, a_ends)
        for j, i in enumerate(spelled):
            out[i] = (
                int(a_ends[j + 1] - a_ends[j]),
                int(b_ends[j + 1] - b_ends[j]),
                int(g_ends[j + 1] - g_ends[j]),
                ";".join(texts[g_ends[j] : g_ends[j + 1]]),
                pairs[l_ends[j] : l_ends[j + 1]].tobytes(),
            )
        return out

    def pieces(self, raw: list[bytes]) -> list[tuple]:
        found = [self._known.get(p, ()) for p in raw]
        new = [i for i, f in enumerate(found) if f == ()]
        for at in range(0, len(new), ENCODED_AT_ONCE):
            some = new[at : at + ENCODED_AT_ONCE]
            for i, f in zip(some, self._align([raw[i] for i in some]), strict=True):
                found[i] = f
                if len(raw[i]) <= KNOWN_BYTES and len(self._known) < KNOWN_PIECES:
                    self._known[raw[i]] = f
        return found


def _group_texts(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray) -> list:
    """``a1,a2|b1`` of each group."""
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    sides = []
    for ids, group in ((a, a_group), (b, b_group)):
        said = [str(i) for i in ids.tolist()]
        at = np.searchsorted(group, np.arange(n + 1)).tolist()
        sides.append([",".join(said[i:j]) for i, j in zip(at, at[1:], strict=False)])
    return [f"{x}|{y}" for x, y in zip(*sides, strict=True)]


def cut(texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Piece boundaries per text and the pieces of a space and each text; '' has none."""
    full = pc.greater(pc.binary_length(texts), 0)
    spaced = pc.if_else(full, pc.binary_join_element_wise(" ", texts, ""), "").cast(pa.large_binary())
    at = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset :][: len(spaced) + 1]
    data = spaced.buffers()[2]
    s = np.frombuffer(data, dtype=np.uint8)[: at[-1]] if data else np.zeros(0, dtype=np.uint8)
    blank = (s == 32) | ((s >= 9) & (s <= 13))
    begins = (s == 32) | (s == 10)
    begins[1:] &= ~blank[:-1]
    begins &= np.repeat(~whole, np.diff(at))
    begins[at[:-1][np.diff(at) > 0]] = True
    cuts = np.append(np.flatnonzero(begins), len(s)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(s)]
    )
    return np.searchsorted(cuts, at), pieces


@lru_cache(maxsize=1)
def _aligner(vocabulary_a: str, vocabulary_b: str) -> Aligner:
    return Aligner(vocabulary_a, vocabulary_b)


def align_texts(aligner: Aligner, texts: pa.Array) -> dict[str, pa.Array]:
    """Columns of the aligned texts, without their ids."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
    at, pieces = cut(texts, odd | (not aligner.cuts))
    d = pieces.dictionary_encode()
    code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = aligner.pieces(d.dictionary.to_pylist())
    owner = np.repeat(np.arange(n), np.diff(at))
    bad = np.zeros(n, dtype=bool)
    unspelled = np.array([f is None for f in found], dtype=bool)
    bad[owner[unspelled[code]]] = True
    found = [f or (0, 0, 0, "", b"") for f in found]
    counts = np.array([f[:3] for f in found], dtype=np.int64).reshape(-1, 3)
    links = np.array([len(f[4]) >> 3 for f in found], dtype=np.int64)
    total = np.stack(
        [
            np.where(bad, 0, np.diff(np.concatenate([[0], np.cumsum(x[code])])[at]))
            for x in (*counts.T, links)
        ]
    )
    said = [f[3] for f in found]
    listed = code.tolist()
    groups = [
        "" if bad[i] else ";".join([said[c] for c in listed[at[i] : at[i + 1]]]) for i in range(n)
    ]

    # Distinct pairs of each text with their uses: pieces of a text first, then their pairs.
    pair, local = np.unique(
        np.frombuffer(b"".join([f[4] for f in found]), dtype=np.int64), return_inverse=True
    )
    ends = np.concatenate([[0], np.cumsum(links)])
    good = ~bad[owner]
    held, times = np.unique(owner[good] * len(found) + code[good], return_counts=True)
    who, which = np.divmod(held, max(1, len(found)))
    size = links[which]
    take = np.repeat(ends[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
    key, place = np.unique(np.repeat(who, size) * len(pair) + local[take], return_inverse=True)
    uses = np.bincount(place, weights=np.repeat(times, size), minlength=len(key)).astype(np.int64)
    who, which = np.divmod(key, max(1, len(pair)))
    lists = pa.array(np.searchsorted(who, np.arange(n + 1)), pa.int32())
    names = ("n_a", "n_b", "n_groups", "n_links")
    return {k: pa.array(v) for k, v in zip(names, total, strict=True)} | {
        "groups": pa.array(groups, pa.string()),
        "pairs": pa.ListArray.from_arrays(lists, pa.array(pair[which])),
        "uses": pa.ListArray.from_arrays(lists, pa.array(uses)),
    }


def align(
    docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, uses.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B, group by group.
    ``pairs`` are the distinct linked id pairs, A's id times the size of B's
    vocabulary plus B's id, with their occurrences in ``uses``. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary_a, vocabulary_b)
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                columns = align_texts(aligner, part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | columns)

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, _ALIGNED)


def frequent_from(counts: DataFrame, most: int = FREQUENT_PAIRS) -> float:
    """Least count of a pair that is broadcast: at most ``most`` pairs reach it.

    A histogram over eighths of powers of two, a few hundred rows, decides.
    """
    step = F.floor(F.log2(F.col("n_docs").cast("double")) * 8).cast("int")
    n, least = 0, math.inf
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        n += r["count"]
        if n > most:
            break
        least = r.step
    return least


def count_links(
    aligned: DataFrame, b_size: int | None = None, most: int = FREQUENT_PAIRS
) -> DataFrame:
    """``aligned`` without pairs and uses, with n_best and count_sum.

    A pair's count is the number of documents that hold it. ``count_sum`` sums
    it over a document's links; ``n_best`` counts the links whose count is the
    highest of their A id, ties included. The most frequent pairs, a bounded
    number, meet the links in place; the rest, each rare, are joined.
    """
    b_size = b_size or _aligner(VOCABULARY_A, VOCABULARY_B).b_size
    spark = aligned.sparkSession
    others = [c for c in aligned.columns if c not in ("pairs", "uses")]
    kept = cut_lineage(aligned.withColumn("_row", F.monotonically_increasing_id()))
    links = kept.select("_row", F.explode(F.arrays_zip("pairs", "uses")).alias("x")).select(
        "_row", F.col("x.pairs").alias("pair"), F.col("x.uses").alias("uses")
    )
    counts = cut_lineage(links.groupBy("pair").agg(F.count("*").alias("n_docs")))
    a_id = F.floor(F.col("pair") / b_size)
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("n_docs").alias("most"))
    known = cut_lineage(
        counts.withColumn("a_id", a_id)
        .join(top, "a_id")
        .select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("int").alias("best"))
    )
    least = frequent_from(counts, most)
    step = F.floor(F.log2(F.col("n_docs").cast("double")) * 8)
    sums = (
        F.sum(F.col("uses") * F.col("best")).alias("n_best"),
        F.sum(F.col("uses") * F.col("n_docs")).alias("count_sum"),
    )
    if least == math.inf:
        frequent, rare = known.limit(0), known
    else:
        frequent, rare = known.where(step >= least), known.where(step < least)
    here = links.join(F.broadcast(frequent), "pair", "left")
    parts = here.where("n_docs IS NOT NULL").groupBy("_row").agg(*sums)
    if rare.limit(1).count():
        rest = here.where("n_docs IS NULL").select("_row", "pair", "uses").join(rare, "pair")
        parts = (
            parts.unionByName(rest.groupBy("_row").agg(*sums))
            .groupBy("_row")
            .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        )
    zero = F.lit(0).cast("bigint")
    return kept.join(parts, "_row", "left").select(
        *others,
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
    )
