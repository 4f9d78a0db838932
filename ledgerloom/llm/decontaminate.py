"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets (powers of two).
For a partition of size up to ``u`` a document is read in windows of ``2u``
shingles every ``u`` shingles, so a passage lies whole in a window of similar
size however long the document is.  An item of ``u / 2`` to ``u`` shingles of which
75 % are in the window has a Jaccard similarity of 0.18 to 0.33 with it.
Items of at most ``SMALLEST`` shingles would be too small for any window:
their shingles are looked up one by one, which misses none.  Window minima come from block minima that
are merged pairwise from one partition to the next.  An item is a candidate
when one of its ``HASHES`` minima equals that of a window; a candidate counts
only if the document's full shingle set contains the stated share of the
item's set.

Items are used in blocks of bounded size, each compared with all documents in
one pass without a shuffle.

Defined cases: null or empty texts and items match nothing; rows with a null
id are ignored as items and never returned as documents.  Fewer than five
words are one shingle.  Repeated documents give one row for each.  An empty
table on either side gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, pieces_of, shingle_hashes, split_words, texts

CONTAINMENT = 75  # per cent of the item's shingles
HASHES = 32  # every hash misses an unbroken passage of 75 %: (1 - 0.18) ** 32 = 0.2 % at worst, (2/3) ** 32 = 2e-6 at best
SMALLEST = 8  # shingles of an item that is looked up exactly, and of a block
BLOCK_ITEMS = 20_000
_FILTER_BITS = 22


def hash_factors(count: int = HASHES) -> np.ndarray:
    """Odd factors: x -> factor * x permutes 32-bit numbers, so equal minima are equal shingles."""
    rng = np.random.default_rng(7)
    return (rng.integers(1, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)).astype(np.uint32)


def partition_of(size: int) -> int:
    """0 for up to SMALLEST shingles, then one partition per doubling."""
    return max(0, int(np.ceil(np.log2(max(size, 1) / SMALLEST))))


class Items:
    """One block of items: their sets, the shingles of short ones and per partition the minima that point to them."""

    def __init__(self, rows: list[tuple[int, bytes]], hashes: int = HASHES, threshold: int = CONTAINMENT):
        self.factors = hash_factors(hashes)
        words = WordHashes()
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.single: dict[int, list[int]] = defaultdict(list)
        self.minima: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in rows:
            elements = np.unique(shingle_hashes(words.of(split_words(text))))
            if not len(elements):
                continue
            number = len(self.ids)
            self.ids.append(item)
            self.sets.append(elements)
            if len(elements) <= SMALLEST:
                # any share that counts holds one of these: the others are too few for it
                needed = max(1, -(-threshold * len(elements) // 100))
                for value in elements[: max(1, len(elements) - needed + 1)].tolist():
                    self.single[value].append(number)
                continue
            short = (elements >> np.uint64(32)).astype(np.uint32)
            with np.errstate(over="ignore"):
                least = (short[:, None] * self.factors[None, :]).min(axis=0)
            for i, value in enumerate(least.tolist()):
                self.minima[partition_of(len(elements))][(i, value)].append(number)
        self.levels = sorted(self.minima)
        self.single_filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        for value in self.single:
            self.single_filter[value >> (64 - _FILTER_BITS)] = True
        self.filters = {}
        for level in self.levels:
            table = np.zeros(1 << _FILTER_BITS, dtype=bool)
            for _, value in self.minima[level]:
                table[value >> (32 - _FILTER_BITS)] = True
            self.filters[level] = table

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Numbers of the items whose signature meets a window of these shingles."""
        found: set[int] = set()
        if self.single:
            for value in set(shingles[self.single_filter[shingles >> np.uint64(64 - _FILTER_BITS)]].tolist()):
                found.update(self.single.get(value, ()))
        if not len(shingles) or not self.levels:
            return found
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        blocks = -(-len(short) // SMALLEST)
        padded = np.concatenate([short, np.full(blocks * SMALLEST - len(short), short[-1], np.uint32)])
        step = 4096 * SMALLEST
        with np.errstate(over="ignore"):
            least = np.concatenate([
                (padded[i : i + step].reshape(-1, SMALLEST)[:, :, None] * self.factors).min(axis=1)
                for i in range(0, len(padded), step)
            ])
        level = 0
        while True:
            if level in self.filters:
                window = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
                hits = np.nonzero(self.filters[level][window >> np.uint32(32 - _FILTER_BITS)])
                if len(hits[0]):
                    table = self.minima[level]
                    for key in set(zip(hits[1].tolist(), window[hits].tolist())):
                        found.update(table.get(key, ()))
            if level >= self.levels[-1]:
                return found
            if len(least) % 2:
                least = np.concatenate([least, least[-1:]])
            least = np.minimum(least[0::2], least[1::2])
            level += 1


MATCH = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = CONTAINMENT, block_items: int = BLOCK_ITEMS,
                 hashes: int = HASHES) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every match; ``benchmark`` has ``item_id, text``."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    spark = docs.sparkSession
    rows = items.count()
    blocks = max(1, -(-rows // block_items))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):  # a block holds about block_items items, whatever the size of the benchmark
        taken = [(r["item_id"], bytes(r["text"])) for r in numbered.where(F.col("block") == block).collect()]
        found = _search(docs, spark.sparkContext.broadcast(taken), threshold, hashes)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, taken, threshold: int, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(taken.value, hashes, threshold)
        words = WordHashes()
        for batch in pieces_of(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                shingles = shingle_hashes(words.of(split_words(text)))
                numbers = items.candidates(shingles)
                if doc is None or not numbers:
                    continue
                whole = np.unique(shingles)
                for number in sorted(numbers):
                    own = items.sets[number]
                    at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
                    shared = int((whole[at] == own).sum())
                    if 100 * shared >= threshold * len(own):
                        for column, value in zip(out, (doc, items.ids[number], shared, len(own), shared / len(own))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.float64(),))],
                ["doc_id", "item_id", "n_shared", "n_item", "containment"],
            )

    return texts(docs).mapInArrow(run, MATCH)
