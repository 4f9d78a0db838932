"""Shortest-pack-first packing over the length histogram.

Documents become pieces of token ids (full pieces of ``length`` ids and one
rest).  Only the histogram of piece lengths, at most ``length`` numbers,
reaches the driver.  There, lengths are placed longest first, always into the
shortest open pack, by counts of packing patterns instead of single pieces.
Patterns then become rank intervals, and every piece finds its place by its
rank among the pieces of its length.

Defined cases: a null or empty text is one piece holding only the end id.
Repeated rows are packed as often as they occur; a null ``doc_id`` is packed
like any other.  Bytes that are no UTF-8 are encoded as U+FFFD.  An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, pieces_of, texts, written

LENGTH = 1024
PIECE_ROWS = 200_000  # pieces a ranking task sorts, at most about this many


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokens(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    A space before a visible character always starts a new pre-token, so a
    text is cut there and equal chunks are encoded once.  The chunks of a text
    that are not known yet are encoded in one call and told apart by the ids
    whose tokens begin with a space.  Texts where the cut is not safe, or that
    hold a special token's string, are encoded whole.
    """

    SPECIAL = "<|"
    UNSAFE = re.compile(r" (?:\s|$)")

    def __init__(self, json_path: str, ranks_path: str, limit: int = 100_000):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)  # tokens that begin with a space
        self.opens[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        self.json_path, self._whole = json_path, None
        self.limit = limit

    @property
    def whole(self):
        """The tokenizer itself, loaded for the first text with a special token's string."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json_path)
        return self._whole

    def _ids(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text).astype("<u4", copy=False)

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Encodes chunks, each with a space before it."""
        ids = self._ids(" " + " ".join(chunks))
        raw = ids.tobytes()
        begins = (4 * np.flatnonzero(self.opens[ids])).tolist()
        found = dict(zip(chunks, (raw[b:e] for b, e in zip(begins, [*begins[1:], len(raw)])), strict=True))
        if len(self) + len(found) > self.limit:
            self.clear()
        self.update(islice(found.items(), self.limit))
        return found

    def encode(self, text: str) -> bytes:
        if self.SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.UNSAFE.search(text):
            return self._ids(text).tobytes()
        first, *chunks = text.split(" ")
        parts = list(map(self.get, chunks))
        if None in parts:
            found = self._learn(list(dict.fromkeys(c for c, part in zip(chunks, parts) if part is None)))
            parts = [found[c] if part is None else part for c, part in zip(chunks, parts)]
        return b"".join((self._ids(first).tobytes(), *parts))


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def token_pieces(
    docs: DataFrame, length: int = LENGTH, json_path: str | None = None, ranks_path: str | None = None
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: every id of every text, in pieces of at most ``length``.

    ``ids`` are little-endian unsigned 32-bit numbers; the last id of a document is 0.
    The paths default to the public 50k byte-level vocabulary of each worker.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteTokens(
            json_path or public_file("byte_bpe_50k.json"), ranks_path or public_file("byte_bpe_50k.tiktoken")
        )
        for batch in pieces_of(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                ids = (coder.encode(text.decode(errors="replace")) if text else b"") + b"\0\0\0\0"
                for begin in range(0, len(ids), 4 * length):
                    piece = ids[begin : begin + 4 * length]
                    for column, value in zip(out, (doc, begin // 4, len(piece) // 4, len(ids) // 4, piece)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.binary(),))],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return texts(docs).mapInArrow(cut, PIECES)


def place(histogram: dict[int, int], length: int) -> list[tuple[int, list[int]]]:
    """Patterns ``(count, lengths)``: longest lengths first, each into the shortest open packs.

    Open packs are kept by the room they have left.  The work depends on the
    number of lengths, never on the number of pieces.
    """
    room: dict[int, list[list]] = defaultdict(list)  # room left -> [count, lengths]
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        for free in sorted((r for r in room if r >= size), reverse=True):  # most room: shortest pack
            while left and room[free]:
                pattern = room[free][-1]
                taken = min(left, pattern[0])
                pattern[0] -= taken
                if not pattern[0]:
                    room[free].pop()
                room[free - size].append([taken, [*pattern[1], size]])
                left -= taken
            if not left:
                break
        if left:
            room[length - size].append([left, [size]])
    return [(count, sizes) for packs in room.values() for count, sizes in packs]


def intervals(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first_rank, end_rank, first_sequence, offset)`` of every slot of every pattern."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, sizes in patterns:
        offset = 0
        for size in sizes:
            out.append((size, used[size], used[size] + count, sequence, offset))
            used[size] += count
            offset += size
        sequence += count
    return out


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length``; other columns stay.

    The pieces are written first, so that ranks stay the same if a task runs again.
    Lengths are ranked in hash slices of bounded size: a length that most
    pieces share fills many tasks.
    """
    spark = pieces.sparkSession
    kept = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slices = max(-(-sum(counts.values()) // PIECE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)).cast("int")
    salted = kept.withColumn("_slice", salt)
    order = [c for c in kept.columns if c != "length"]
    local = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order)) - 1
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n")
    starts = salted.groupBy("length", "_slice").agg(F.count("*").alias("_n")).select("length", "_slice", before.alias("_before"))
    ranked = (
        salted.withColumn("_local", local)
        .join(starts, ["length", "_slice"])
        .withColumn("_rank", F.col("_local") + F.col("_before"))
    )
    # the patterns depend on the histogram of at most `length` lengths, so this side is bounded
    slots = spark.createDataFrame(
        intervals(place(counts, length)),
        "_size long, _first long, _end long, _sequence long, offset long",
    )
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")),
    )
    return placed.select(
        *kept.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset"
    )


def packed_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packed pieces with the crc32 of their ids instead of the ids."""
    pieces = token_pieces(docs, length).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, length).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
