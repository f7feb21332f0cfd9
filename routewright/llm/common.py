"""Helpers shared by the operators: tables, folds, and words of a batch.

A word is a run of bytes other than 0x20 and 0x09-0x0D, as everywhere here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A batch that Python works on at a time: bounds what a worker holds.
BATCH_BYTES = 4 << 20
MASK = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as empty text."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(key.cast("binary")) % 5).cast("int")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(col, A_TO_Z, A_TO_Z.lower())


def slices(
    batch: pa.RecordBatch, text: str = "text", size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    own = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    part = np.cumsum(own.to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Word boundaries per text (one more than texts) and all words in order."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    at = lists.offsets.to_numpy()
    return before[at - at[0]].astype(np.int64), flat.filter(full)


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's number among the distinct words, and those."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def hash_words(distinct: list[str]) -> np.ndarray:
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct)
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)
