"""Phrase collocations: frequent word sequences of 2 to 5 words, by language, ranked by how firmly their parts hold together.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
those into words between spaces and tabs.

1. *Fingerprints*: a batch of documents of one language becomes one array of
   128-bit word hashes.  Prefix polynomials of their upper halves give the
   fingerprint of every n-gram by one subtraction and one multiplication; a
   second polynomial over the lower halves gives an independent check value.
2. *Counts* in four scans.  Words, then pairs of frequent words, then triples
   of frequent pairs: only ``(fingerprint, count)`` of a batch's different
   n-grams is shuffled.  The last scan counts these and all longer n-grams
   whose triples are all frequent, with check values and a pointer to an
   occurrence; a task adds up the rows of one n-gram before they leave it,
   and there are no more tasks than cores.
   What is frequent reaches the tasks as a ``Sieve``, a bit map of
   at most 32 MB; a false positive costs a row, never a result.
3. *Text*: only fingerprints that are frequent are looked up, through their
   pointers; both hashes of the text found there must agree.  Fingerprints
   whose check values differ among their occurrences (a collision), or whose
   pointer leads nowhere, are counted again by their text.
4. *Scores* by joins over the frequent phrases; exact decimals.

Defined cases: a null or empty text has no words, a null ``lang`` is ``und``.
Repeated rows count each time; a null ``doc_id`` counts as well (its phrases
are then found by text).  Bytes that are no UTF-8 are kept as they are.  Empty
tables, and languages without a frequent phrase, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_texts, mix, pieces_of, written

LONGEST = 5
#: So many words have a scan of their own that only counts.
SIEVED = 3
LEAST = 100
TOP = 2000
UNKNOWN = "und"

#: Bits of a sieve: sixteen for each entry, at most 2**28 (32 MB) however many entries there are.
SIEVE_BITS = range(16, 29)
SHIFTS = (0, 18, 36)

_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BATCH = 6_000_000
#: So many rows of the last scan a task holds to add up those of one n-gram.
HELD = 1 << 20


class Sieve:
    """A bit map of 64-bit keys for the tasks; keys that are in it always pass."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Sieve:
        """Made by a shuffle of at most ``2**bits / 64`` rows."""
        n = keys.count()
        bits = min(max((16 * n).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[-1])
        mask = (1 << bits) - 1
        places = F.explode(F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(mask)) for s in SHIFTS])).alias("place")
        word = F.shiftright("place", 6).cast("int").alias("word")
        bit = F.expr("shiftleft(1L, cast(place & 63L as int))").alias("bit")
        rows = keys.select(places).select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        words[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
        return cls(bits, words)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for s in SHIFTS:
            place = (keys >> np.uint64(s)) & np.uint64((1 << self.bits) - 1)
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


class Words(dict):
    """word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each word's 128-bit hash, by number."""
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self)), dtype=">u8").astype(np.uint64)
        return raw[::2], raw[1::2]


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo 2**64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def piece_words(text: bytes) -> tuple[list[bytes], list[int]]:
    """All words of a text, and how many each piece has."""
    words: list[bytes] = []
    sizes: list[int] = []
    for piece in text.lower().translate(_CUTS).split(b"\n"):
        found = piece.split()
        if found:
            words += found
            sizes.append(len(found))
    return words, sizes


class Grams:
    """The n-grams of documents of one language; a place is a word, an n-gram never leaves its piece.

    ``width`` below 64 shortens the fingerprints (tests force collisions with it).
    """

    def __init__(self, lang: bytes, rows: list[tuple[int | None, bytes]], width: int = 64):
        self.salt, self.width = xxhash.xxh3_64_intdigest(lang), width
        known, sizes = Words(), []
        self.words: list[bytes] = []
        docs, firsts = [], []
        for doc, text in rows:
            words, pieces = piece_words(text)
            if words:
                docs.append(doc)
                firsts.append(len(self.words))
                self.words += words
                sizes += pieces
        n = len(self.words)
        self.docs, self.firsts = docs, np.array(firsts, dtype=np.int64)
        numbers = np.fromiter(map(known.__getitem__, self.words), dtype=np.int64, count=n)
        ends = np.cumsum(np.array(sizes, dtype=np.int64))
        #: words left in the piece from each place on
        self.left = np.repeat(ends, sizes) - np.arange(n)
        self.prefix, self.scale = [], []
        for half, base in zip(known.hashes(), _BASES):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(half[numbers] * powers(base, n)[:n], out=sums[1:])
            self.prefix.append(sums)
            self.scale.append(powers(pow(base, -1, 1 << 64), n))

    def __len__(self) -> int:
        return len(self.words)

    def values(self, places: np.ndarray, n: int, check: bool = False) -> np.ndarray:
        """Fingerprints, or check values, of the n-grams from these places on."""
        sums, scale = self.prefix[check], self.scale[check]
        salt = np.uint64(self.salt * (2 * n + 1) & (1 << 64) - 1)
        out = mix((sums[places + n] - sums[places]) * scale[places] + salt)
        return out if check else out >> np.uint64(64 - self.width)

    def pointers(self, places: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Document, and word number within it, of each place."""
        of = np.searchsorted(self.firsts, places, side="right") - 1
        return [self.docs[i] for i in of.tolist()], places - self.firsts[of]

    def phrase(self, place: int, n: int) -> bytes:
        return b" ".join(self.words[place : place + n])


def slim(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang``: other columns can never clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
    )


def grams_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bytes, Grams]]:
    """Batches of documents by language."""
    for batch in pieces_of(batches, _BATCH):
        by_lang: dict[bytes, list[tuple[int | None, bytes]]] = {}
        langs = batch.column("lang").cast(pa.large_binary()).to_pylist()
        for doc, text, lang in zip(batch.column("doc_id").to_pylist(), byte_texts(batch), langs):
            if text:
                by_lang.setdefault(lang, []).append((doc, text))
        for lang, rows in by_lang.items():
            grams = Grams(lang, rows, width)
            if len(grams):
                yield lang, grams


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    different, counts = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(different.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "count"])


def _frequent_keys(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("key").agg(F.sum("count").alias("count")).where(F.col("count") >= least).select("key")


def extended(grams: Grams, places: np.ndarray, n: int) -> np.ndarray:
    """Places of the n-grams whose two parts of ``n - 1`` words begin at ``places``."""
    if n == 1:
        return np.arange(len(grams))
    there = np.zeros(len(grams) + 1, dtype=bool)
    there[places] = True
    return places[there[places + 1] & (grams.left[places] >= n)]


def level_counts(docs: DataFrame, sieves: list, width: int) -> DataFrame:
    """Counts of the n-grams one word longer than the last sieve's whose parts pass it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in grams_of(batches, width):
            places = np.empty(0, dtype=np.int64)
            for n, sieve in enumerate(sieves, 1):
                places = extended(grams, places, n)
                places = places[sieve.value.holds(grams.values(places, n))]
            n = len(sieves) + 1
            yield _counted(grams.values(extended(grams, places, n), n))

    return docs.mapInArrow(scan, "key long, count long")


COUNTED = "key long, n int, count long, low long, high long, doc_id long, start long"


def phrase_counts(docs: DataFrame, sieves: list, longest: int, width: int) -> DataFrame:
    """Counts with check values and pointers: n-grams that pass the sieves, and longer ones all of whose parts do.

    The n-gram of no words stands for the language: its count is that of all words.
    Nearly every task meets nearly every frequent n-gram, so there is one task for each
    core, however many splits the documents have.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in grams_of(batches, width):
            yield _checked(grams, np.zeros(1, dtype=np.int64), 0, np.array([len(grams)]))
            places = np.empty(0, dtype=np.int64)
            for n in range(1, longest + 1):
                places = extended(grams, places, n)
                if n <= len(sieves):
                    places = places[sieves[n - 1].value.holds(grams.values(places, n))]
                yield _checked(grams, places, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(checked(batches))

    return docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(scan, COUNTED)


def added_up(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """One row for each key among as many rows as may be held, as the aggregate after it would make.

    Rows are merged as soon as there are twice as many as the last merge left.
    """
    kept: list[pa.RecordBatch] = []
    rows, most = 0, held >> 2
    for batch in batches:
        if rows + batch.num_rows > most and rows:
            kept = [_merged(kept)]
            rows = kept[0].num_rows
            if 2 * rows > held or rows + batch.num_rows > held:
                yield from _slices(kept.pop())
                rows = 0
            most = max(held >> 2, 2 * rows)
        kept.append(batch)
        rows += batch.num_rows
    if kept:
        yield from _slices(_merged(kept))


def _slices(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def _merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Sums of counts, least and greatest check value, a pointer to a document with an id if there is one."""
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    if not table.num_rows:
        return batches[0]
    keys, known = table["key"].to_numpy(), table["doc_id"].is_valid().to_numpy()
    order = np.lexsort((~known, keys))
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    pick = pa.array(order[first])

    def reduced(column: str, how: np.ufunc) -> pa.Array:
        return pa.array(how.reduceat(table[column].to_numpy()[order], first))

    columns = [
        pa.array(keys[first]), reduced("n", np.minimum), reduced("count", np.add), reduced("low", np.minimum), reduced("high", np.maximum),
        *(table[c].combine_chunks().take(pick) for c in ("doc_id", "start")),
    ]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], table.column_names)


def _checked(grams: Grams, places: np.ndarray, n: int, counts: np.ndarray | None = None) -> pa.RecordBatch:
    keys, check = grams.values(places, n), grams.values(places, n, True).view(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, check, places = keys[order], check[order], places[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    if counts is None:
        counts = np.diff(np.r_[first, len(keys)])
    low = np.minimum.reduceat(check, first) if len(first) else check
    high = np.maximum.reduceat(check, first) if len(first) else check
    docs, starts = grams.pointers(places[first])
    columns = [keys[first].view(np.int64), np.full(len(first), n, dtype=np.int32), counts.astype(np.int64), low, high]
    arrays = [*map(pa.array, columns), pa.array(docs, pa.int64()), pa.array(starts)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "n", "count", "low", "high", "doc_id", "start"])


def _read_pointers(docs: DataFrame, frequent: DataFrame, width: int) -> DataFrame:
    """``key, lang, n, phrase, ends`` of the fingerprints whose pointer's text has both hashes."""
    spark = docs.sparkSession
    wanted = frequent.where("low = high AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "low", "n", "start")).alias("wanted")  # as many as a document has n-grams, at most
    )
    slots = written(wanted.withColumn("slot", F.xxhash64("doc_id")), "pointers")
    sieve = spark.sparkContext.broadcast(Sieve.of(slots, "slot"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sieve.value.holds(batch.column("slot").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(found)).select(["doc_id", "text", "lang"])

    picked = docs.where("doc_id IS NOT NULL").withColumn("slot", F.xxhash64("doc_id")).mapInArrow(pick, "doc_id long, text string, lang string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            rows = []
            langs = batch.column("lang").cast(pa.large_binary()).to_pylist()
            for text, lang, wants in zip(byte_texts(batch), langs, batch.column("wanted").to_pylist()):
                grams = Grams(lang, [(0, text or b"")], width)
                for n in {w["n"] for w in wants} if len(grams) else ():
                    some = [w for w in wants if w["n"] == n and w["start"] < len(grams) and grams.left[w["start"]] >= n]
                    places = np.array([w["start"] for w in some], dtype=np.int64)
                    keys, checks = (grams.values(places, n, c).view(np.int64).tolist() for c in (False, True))
                    rows += [
                        (w["key"], lang, n, grams.phrase(w["start"], n))
                        for w, key, check in zip(some, keys, checks) if key == w["key"] and check == w["low"]
                    ]
            yield _phrases(rows)

    return picked.join(slots.drop("slot"), "doc_id").mapInArrow(read, PHRASES).dropDuplicates(["key"])


PHRASES = "key long, lang binary, n int, phrase binary, ends array<int>"


def _phrases(rows: list[tuple[int, bytes, int, bytes]], counts: list[int] | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    ends = [[i for i, c in enumerate(p) if c == 32] for p in columns[3]]  # bytes before each cut
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array(ends, pa.list_(pa.int32()))]
    names = ["key", "lang", "n", "phrase", "ends"]
    if counts is not None:
        arrays.append(pa.array(counts, pa.int64()))
        names.append("count")
    return pa.RecordBatch.from_arrays(arrays, names)


def _count_texts(docs: DataFrame, lost: DataFrame, longest: int, width: int) -> DataFrame:
    """Exact counts by text of everything whose fingerprint is one of ``lost``."""
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(lost, "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, grams in grams_of(batches, width):
            counts: dict[tuple[int, bytes, int, bytes], int] = {}
            for n in range(longest + 1):
                places = np.flatnonzero(grams.left >= n)
                keys = grams.values(places, n)
                ok = sieve.value.holds(keys)
                for key, place in zip(keys[ok].view(np.int64).tolist(), places[ok].tolist()):
                    entry = (key, lang, n, grams.phrase(place, n))
                    counts[entry] = counts.get(entry, 0) + 1
            yield _phrases(list(counts), list(counts.values()))

    found = docs.mapInArrow(scan, PHRASES + ", count long").join(lost.select("key"), "key", "left_semi")
    return found.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count"), F.any_value("ends").alias("ends"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, width: int = 64) -> DataFrame:
    """``lang, n, phrase, ends, count``: all phrases of 1 to ``longest`` words with at least ``least`` occurrences.

    ``phrase`` is binary, ``ends`` has the bytes before each of its spaces.
    The row of no words (``n = 0``) has the language's count of all words.
    """
    spark, docs = docs.sparkSession, slim(docs)

    sieves: list = []
    for n in range(1, min(SIEVED, longest) + 1):
        keys = written(_frequent_keys(level_counts(docs, sieves, width), least), f"frequent-{n}")
        sieves.append(spark.sparkContext.broadcast(Sieve.of(keys, "key")))
    counted = phrase_counts(docs, sieves, longest, width).groupBy("key").agg(
        F.min("n").alias("n"), F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("doc_id").alias("doc_id"), F.min_by("start", "doc_id").alias("start"),
    )
    frequent = written(counted.where((F.col("count") >= least) | (F.col("n") == 0)), "frequent")
    read = written(_read_pointers(docs, frequent, width), "phrases")
    found = read.join(frequent.select("key", "count"), "key").select("lang", "n", "phrase", "ends", "count")
    lost = frequent.join(read.select("key"), "key", "left_anti").select("key").distinct()
    if not lost.isEmpty():  # collisions, or documents without an id
        again = _count_texts(docs, lost, longest, width).where((F.col("count") >= least) | (F.col("n") == 0))
        found = found.unionByName(again.select(*found.columns))
    return written(found, "phrase-counts")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, width: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of 2 words and more, each language's best ``top`` (all if None).

    ``score = floor(1000 * a * n / (l * r))`` of the cut that scores lowest
    (then shortest first part).  A phrase inside a longer one that occurs as
    often is dropped.
    """
    counts = frequent_phrases(docs, least, longest, width)
    phrases = counts.where("n >= 2").withColumnRenamed("count", "a")
    totals = counts.where("n = 0").groupBy("lang").agg(F.sum("count").alias("total"))

    # one word less at either end: the longest count of a phrase around each
    shorter = F.explode(F.array(
        F.expr("substring(phrase, 1, ends[n - 2])"), F.expr("substring(phrase, ends[0] + 2)"),
    )).alias("phrase")
    around = phrases.where("n >= 3").select("lang", shorter, "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where("around IS NULL OR around < a")

    cut = F.posexplode("ends").alias("k", "at")
    parts = kept.select("lang", "phrase", "a", cut).selectExpr(
        "lang", "phrase", "a", "k", "substring(phrase, 1, at) AS first", "substring(phrase, at + 2) AS rest"
    )
    first = counts.where("n >= 1").selectExpr("lang", "phrase AS first", "count AS l")
    rest = counts.where("n >= 1").selectExpr("lang", "phrase AS rest", "count AS r")
    scored = parts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
    product = "CAST(1000 AS decimal(4,0)) * CAST(a AS decimal(14,0)) * CAST(total AS decimal(16,0))"
    scored = scored.withColumn("score", F.expr(f"({product}) div (CAST(l AS decimal(16,0)) * CAST(r AS decimal(16,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "total", "cut.*").withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select(
        F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"),
        F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score",
    )
