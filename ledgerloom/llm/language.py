"""Language identification by prediction by partial matching (PPM).

Every language has a context tree of byte symbols: how often each symbol
followed each context of up to ``ORDER`` symbols.  A symbol that its context
has not seen escapes to the next shorter context (escape method C), down to a
uniform guess.  The statistics are frozen before scoring, so the code length
of a symbol depends on its context alone.  The language with the shortest
code wins.

Order and alphabet are the same at every input.  Symbols fold ASCII: A-Z to
a-z, white space to a space, digits to one symbol, the rest to one symbol;
every byte from 0x80 is a symbol of its own.  Only contexts that occur are
kept, as sorted arrays.  The code lengths of the most frequent ones are
tabulated for all languages, as far as ``TABLE_BYTES`` reach; those of the
others are worked out when a text has them, with the same result.

Counting covers all learnt documents: tasks count, Spark adds, and the driver
gets only the sums, one for each context and symbol of a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as is every text when nothing could be learnt.  Rows with null ``lang`` or
null ``doc_id`` are never learnt from but are predicted.  Ties go to the
first language in byte order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, pieces_of, texts

UNKNOWN = "und"
ORDER = 3
SYMBOLS = 64
BASE = 157  # symbols of the fixed alphabet
TABLE_BYTES = 64_000_000  # of tabulated code lengths; affects speed only
UNIT = 1 / 2048  # code lengths are kept in fixed point, in bits
_START = 0  # the symbol of a space; texts begin in the context of spaces


def byte_counts(docs: DataFrame) -> DataFrame:
    """``byte, n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in pieces_of(batches):
            for text in byte_texts(batch):
                if text:
                    total += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["byte", "n"])

    return docs.select("text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def symbol_map(counts: dict[int, int], symbols: int = SYMBOLS) -> np.ndarray:
    """Symbol of each byte: 0 space, 1 digit, 2 other ASCII, 3 other bytes, 4 to 29 letters, then frequent bytes from 0x80."""
    table = np.full(256, 2, dtype=np.int64)
    table[0x80:] = 3
    table[[0x20, *range(0x09, 0x0E)]] = _START
    table[0x30:0x3A] = 1
    for i in range(26):
        table[0x41 + i] = table[0x61 + i] = 4 + i
    frequent = sorted((b for b, n in counts.items() if b >= 0x80 and n), key=lambda b: (-counts[b], b))
    for i, byte in enumerate(frequent[: symbols - 30]):
        table[byte] = 30 + i
    return table


def byte_symbols() -> np.ndarray:
    """Symbol of each byte: 0 space, 1 digit, 2 other ASCII, 3 to 28 letters, then every byte from 0x80."""
    table = np.full(256, 2, dtype=np.int64)
    table[[0x20, *range(0x09, 0x0E)]] = _START
    table[0x30:0x3A] = 1
    table[0x41:0x5B] = table[0x61:0x7B] = np.arange(3, 29)
    table[0x80:] = np.arange(29, BASE)
    return table


def contexts(text: bytes, table: np.ndarray, base: int, order: int) -> np.ndarray:
    """The number of each symbol with the ``order`` symbols before it, as digits of ``base``."""
    symbols = np.concatenate([np.full(order, _START, np.int64), table[np.frombuffer(text, np.uint8)]])
    n = len(text)
    out = symbols[:n]
    for j in range(1, order + 1):
        out = out * base + symbols[j : j + n]
    return out


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their summed counts."""
    codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def context_counts(learnt: DataFrame, languages: list[str], table: np.ndarray, base: int, order: int) -> DataFrame:
    """``code, n``: occurrences of each (language, context, symbol)."""
    number = {lang: i for i, lang in enumerate(languages)}
    size = base ** (order + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in pieces_of(batches, 1_000_000):
            codes = [
                contexts(text, table, base, order) + number[lang] * size
                for lang, text in zip(batch.column("lang").to_pylist(), byte_texts(batch))
                if text
            ]
            if codes:
                total = merged_counts([total, np.unique(np.concatenate(codes), return_counts=True)])
        yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], ["code", "n"])

    return learnt.select("lang", "text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def code_lengths(codes: np.ndarray, n: np.ndarray, base: int, order: int) -> np.ndarray:
    """Bits, in ``UNIT``, of every (context, symbol): PPM, escape method C, no exclusions, frozen counts."""
    bits = np.full((1, base), np.log2(256.0), dtype=np.float32)  # order -1: uniform over bytes
    for k in range(order + 1):
        low, place = np.unique(codes % base ** (k + 1), return_inverse=True)
        times = np.bincount(place, weights=n, minlength=len(low))
        rows = base**k
        kinds = np.bincount(low // base, minlength=rows)
        total = np.bincount(low // base, weights=times, minlength=rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0).astype(np.float32)
        bits = np.tile(bits, (rows // len(bits), 1))  # the shorter context is the end of the longer one
        bits += escape[:, None]
        bits.reshape(-1)[low] = -np.log2(times / (total + kinds)[low // base])
    bits *= 1 / UNIT
    return np.minimum(np.rint(bits, out=bits), 65_535, out=bits).reshape(-1).astype(np.uint16)


class Sparse:
    """Values by (key, language), only where there are some."""

    def __init__(self, keys: np.ndarray, languages: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, start = np.unique(keys[order], return_index=True)
        self.start = np.append(start, len(keys))
        self.languages, self.values = languages[order], values[order]

    def add_to(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """Adds the values of each key to its row of all languages."""
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        row = np.nonzero(self.keys[place] == keys)[0]
        begin = self.start[place[row]]
        many = self.start[place[row] + 1] - begin
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        rows[np.repeat(row, many), self.languages[at]] += self.values[at]


class Places:
    """Place of a number among different numbers: a hash table that whole arrays are looked up in."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            out = self.slots[slot] != left
            left, slot = left[out], (slot[out] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that are not there."""
        slot = self._slot(keys)
        place = self.slots[slot]
        if len(self.keys):
            wrong = np.nonzero((place >= 0) & (self.keys[place] != keys))[0]
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
                place[wrong] = self.slots[slot[wrong]]
                wrong = wrong[(place[wrong] >= 0) & (self.keys[place[wrong]] != keys[wrong])]
        return place


class Model:
    """Frozen statistics: sorted codes of (language, context, symbol) and their counts; the rest is built where it is used."""

    def __init__(self, languages: list[str], symbols: np.ndarray, base: int, order: int, codes: np.ndarray, n: np.ndarray,
                 table_bytes: int = TABLE_BYTES):
        self.languages, self.symbols, self.base, self.order = languages, symbols, base, order
        self.codes, self.n, self.table_bytes = codes, n, table_bytes
        self._levels: list[tuple[Sparse, Sparse]] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_levels": None, "_places": None, "_table": None}

    def _build(self) -> None:
        """Escapes of contexts, and what a seen symbol takes off the escape and the shorter context's code length."""
        size = self.base ** (self.order + 1)
        language, code = self.codes // size, self.codes % size
        self._levels, shorter, shorter_bits = [], None, None
        for k in range(self.order + 1):
            width = self.base ** (k + 1)
            low, place = np.unique(language * width + code % width, return_inverse=True)
            times = np.bincount(place, weights=self.n, minlength=len(low))
            heads, head = np.unique(low // self.base, return_inverse=True)
            kinds = np.bincount(head)
            total = np.bincount(head, weights=times)
            escape = -np.log2(kinds / (total + kinds))
            bits = -np.log2(times / (total + kinds)[head])
            own, gram = low // width, low % width
            if k:
                narrow = width // self.base
                below = shorter_bits[np.searchsorted(shorter, own * narrow + gram % narrow)]
            else:
                below = np.full(len(low), 8.0)  # order -1: uniform over bytes
            rows = width // self.base
            self._levels.append((Sparse(heads % rows, heads // rows, escape), Sparse(gram, own, bits - escape[head] - below)))
            shorter, shorter_bits = low, bits
        keys, place = np.unique(code, return_inverse=True)
        most = max(0, self.table_bytes // (4 * max(1, len(self.languages))))
        if len(keys) > most:
            seen = np.bincount(place, weights=self.n)
            keys = np.sort(keys[np.argsort(-seen, kind="stable")[:most]])
        self._places, self._table = Places(keys), self.rows(keys)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Code length, in ``UNIT``, of each (context, symbol) in every language: PPM, escape method C, no exclusions."""
        out = np.empty((len(codes), len(self.languages)), dtype=np.int32)
        step = max(1, 1_000_000 // max(1, len(self.languages)))
        for begin in range(0, len(codes), step):
            part = codes[begin : begin + step]
            bits = np.full((len(part), len(self.languages)), 8.0)
            for k, (escapes, symbols) in enumerate(self._levels):
                gram = part % self.base ** (k + 1)
                escapes.add_to(bits, gram // self.base)
                symbols.add_to(bits, gram)
            out[begin : begin + step] = np.rint(bits / UNIT)
        return out

    def lengths(self, text: bytes) -> np.ndarray:
        """Code length of the whole text in bits, per language."""
        if self._levels is None:
            self._build()
        total = np.zeros(len(self.languages), dtype=np.int64)
        step = 1 << 16
        for begin in range(0, len(text), step):
            overlap = min(begin, self.order)
            codes = contexts(text[begin - overlap : begin + step], self.symbols, self.base, self.order)[overlap:]
            place = self._places.find(codes)
            if (place < 0).any():
                rare, times = np.unique(codes[place < 0], return_counts=True)
                some = max(1, 4_000_000 // len(self.languages))
                for i in range(0, len(rare), some):
                    total += times[i : i + some] @ self.rows(rare[i : i + some]).astype(np.int64)
                place = place[place >= 0]
            some = max(1, 4_000_000 // len(self.languages))
            for i in range(0, len(place), some):
                total += self._table[place[i : i + some]].sum(axis=0, dtype=np.int64)
        return total * UNIT

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text.decode())):
            return UNKNOWN, 0.0
        bits = self.lengths(text)
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def train(learnt: DataFrame, order: int = ORDER) -> Model:
    """Frozen statistics of ``text`` by non-null ``lang``, over all rows given."""
    learnt = learnt.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang IS NOT NULL AND text <> ''"
    )
    languages = sorted(r["lang"] for r in learnt.select("lang").distinct().collect())
    table = byte_symbols()
    counted = context_counts(learnt, languages, table, BASE, order).toArrow()
    codes, n = (counted.column(c).to_numpy() for c in ("code", "n"))
    sort = np.argsort(codes)
    return Model(languages, table, BASE, order, codes[sort], n[sort])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for batch in pieces_of(batches):
            found = [own.predict(t) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def filter_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is known, all columns kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for batch in pieces_of(batches):
            known = [own.predict(t)[0] != UNKNOWN for t in byte_texts(batch)]
            yield batch.select(["row"]).filter(pa.array(known, pa.bool_()))

    kept = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
