"""Helpers the operators share: Arrow batches, word hashes, shingles, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_root

SHINGLE_WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared scratch folder, read again.

    The table outlives the executors that wrote it.  The owner of
    ``spark.checkpoint.dir`` clears the folder.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string): other columns can never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo: the split into learnt and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def sample_ids(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids in hash order: a bounded, reproducible sample."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def byte_texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def pieces_of(batches: Iterator[pa.RecordBatch], limit: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(size)
        if begin < batch.num_rows:
            yield batch.slice(begin)
        pa.default_memory_pool().release_unused()  # workers are reused: give the batch's memory back


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything at ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, words between ``[\\x20\\x09-\\x0D]``: exactly what bytes methods do."""
    return text.lower().split() if text else []


def shingle_hashes(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per place; fewer than ``k`` words are one shingle, none have none."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n - size + 1, dtype=np.uint64)
        for j in range(size):
            total = total * _MULTIPLIER + words[j : n - size + 1 + j]
        return mix(total + np.uint64(size))
