"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys ``(hi, lo)`` with the number of documents that
hold the line and the largest of their ids, written sorted by key.  Every new
batch of documents is merge-joined with the keys of the runs: keys that no run
holds (the anti-join) enter as fresh, keys already held enter as additions.  A
key is thus fresh in exactly one run, and what the anti-join decides is the
result: a fresh key without additions has its final count already, only keys
with additions are summed again.  When a level has ``fanout`` runs, they are
merged into one run of the next level before the next batch comes, so a key is
rewritten a logarithmic number of times.

Defined cases: a null or empty text is one empty line.  A null ``doc_id``
holds no key and loses no line.  Repeated rows of one id count once and are
all treated alike.  Bytes that are no UTF-8 count as one code point each
undecodable stretch and stay as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, pieces_of, texts, written

MIN_CODE_POINTS = 20
MIN_DOCUMENTS = 3
BATCHES = 4
FANOUT = 2


def line_key(line: bytes, shortest: int = MIN_CODE_POINTS) -> bytes | None:
    """The line stripped of ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; None when too short to count."""
    key = line.strip().lower()
    if len(key) < shortest or (not key.isascii() and len(key.decode(errors="replace")) < shortest):
        return None
    return key


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def hashed(key: bytes) -> tuple[int, int]:
    """128 bits: at 10^13 different lines a false match is still out of reach."""
    value = xxhash.xxh3_128_intdigest(key)
    return signed(value >> 64), signed(value & ((1 << 64) - 1))


def line_hashes(docs: DataFrame, shortest: int = MIN_CODE_POINTS) -> DataFrame:
    """``doc_id, hi, lo``: the different keys of each document."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            ids: list[int] = []
            his: list[int] = []
            los: list[int] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                if doc is None or not text:
                    continue
                for key in {line_key(line, shortest) for line in text.split(b"\n")} - {None}:
                    hi, lo = hashed(key)
                    ids.append(doc)
                    his.append(hi)
                    los.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, his, los)], ["doc_id", "hi", "lo"])

    return texts(docs).mapInArrow(split, "doc_id long, hi long, lo long")


class LineRuns:
    """Levelled runs ``hi, lo, documents, keeper, fresh`` in the scratch folder.

    ``fresh`` marks the one run of a key where the anti-join let it in.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def runs(self) -> DataFrame | None:
        tables = [run for level in self.levels for run in level]
        return self.union(tables) if tables else None

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch ``doc_id, hi, lo`` of new documents; returns its keys that no run held before."""
        self.compact()
        per_document = lines.distinct()  # spreads a line that a third of all documents hold
        keys = per_document.groupBy("hi", "lo").agg(
            F.count("*").alias("documents"), F.max("doc_id").alias("keeper")
        )
        old = self.runs()
        if old is None:
            met = keys.withColumn("fresh", F.lit(True))
        else:
            held = old.where("fresh").select("hi", "lo", F.lit(True).alias("held"))  # each key once
            met = keys.join(held, ["hi", "lo"], "left").withColumn("fresh", F.col("held").isNull()).drop("held")
        run = written(met.sortWithinPartitions("hi", "lo"), "run")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        return run.where("fresh").drop("fresh")

    def compact(self) -> None:
        """Merges every full level into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                merged = self.union(full).groupBy("hi", "lo").agg(
                    F.sum("documents").alias("documents"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh")
                )
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(written(merged.sortWithinPartitions("hi", "lo"), "run"))
            level += 1

    def totals(self) -> DataFrame | None:
        """``hi, lo, documents, keeper``: every key once, fresh rows completed by their additions."""
        rows = self.runs()
        if rows is None:
            return None
        more = rows.where("NOT fresh").groupBy("hi", "lo").agg(F.sum("documents").alias("more"), F.max("keeper").alias("later"))
        return rows.where("fresh").join(more, ["hi", "lo"], "left").select(
            "hi", "lo", (F.col("documents") + F.coalesce("more", F.lit(0))).alias("documents"),
            F.greatest("keeper", "later").alias("keeper"),
        )


def repeated_lines(docs: DataFrame, documents: int = MIN_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT,
                   shortest: int = MIN_CODE_POINTS) -> DataFrame:
    """``doc_id, gone``: per document the keys it loses, as an array of ``(hi, lo)``."""
    spark = docs.sparkSession
    lines = written(
        line_hashes(docs, shortest).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")),
        "lines", ["batch"],
    )
    store = LineRuns(fanout)
    for batch in range(batches):
        store.add(lines.where(F.col("batch") == batch).select("doc_id", "hi", "lo"))
    # written: a plain table on this side lets adaptive execution split the lines of a very frequent key
    frequent = written(store.totals().where(F.col("documents") >= documents), "frequent")
    gone = lines.join(frequent, ["hi", "lo"]).where("doc_id <> keeper")
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))


def dedup_lines(docs: DataFrame, documents: int = MIN_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT,
                shortest: int = MIN_CODE_POINTS) -> DataFrame:
    """The documents with repeated lines removed, all columns kept, and ``n_lines, n_dropped`` added.

    Columns of those two names are replaced.
    """
    gone = repeated_lines(docs, documents, batches, fanout, shortest)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = packed.join(gone.hint("shuffle_hash"), "doc_id", "left")

    def rewrite(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches_):
            out, total, dropped = [], [], []
            for text, keys in zip(byte_texts(batch), batch.column("gone").to_pylist()):
                lines = (text or b"").split(b"\n")
                kept = lines
                if keys:
                    losing = {(k["hi"], k["lo"]) for k in keys}
                    kept = []
                    for line in lines:
                        key = line_key(line, shortest)
                        if key is None or hashed(key) not in losing:
                            kept.append(line)
                out.append(b"\n".join(kept))
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(out, pa.binary()).view(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                ["row", "text", "n_lines", "n_dropped"],
            )

    slim = packed.select(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]).alias("row")).schema["row"].dataType
    ready = joined.select(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text", "gone")
    schema = f"row {slim.simpleString()}, text string, n_lines long, n_dropped long"
    done = ready.mapInArrow(rewrite, schema)
    added = ("n_lines", "n_dropped")
    return done.select(
        *[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in added], *added
    )
