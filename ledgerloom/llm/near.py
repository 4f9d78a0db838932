"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its different word shingles.  Its sketch
has ``REGISTERS`` registers; a register is an exponentially spaced, truncated
minimum ``K = 1 - floor(log_b h)`` over the set, so two sketches of parts
merge by the register-wise maximum, and two sets agree in a register about as
often as they share elements.  Bands of six registers propose pairs, the
joint likelihood of the registers that are larger, smaller and equal
estimates the similarity and discards hopeless pairs, and the full sets
confirm the rest.

Groups are never expanded into rows of all pairs.  Documents with equal sets
are one class.  In a crowded bucket, cut into chunks of bounded size, every
member proposes only the earlier member of its chunk whose registers agree
best.  The confirmed links are joined into components; most buckets then lie
within one.  In the others all members of different components are compared
by their registers, chunk by chunk inside tasks, and only pairs that may
still be similar leave the task, once each, to be confirmed.

Most documents share no band.  What a step needs of the others, their
registers or texts, is picked in the scan by a bit map of ids of bounded
size, so neither the texts nor the registers of all documents are shuffled
for it; ids that pass by chance fall out of the join that follows.

Defined cases: null or empty texts have empty sets and are linked with
nothing.  A null ``doc_id`` is linked with nothing and returned with null
``component_id`` and ``kept`` true.  Repeated rows of one id are returned as
often as they occur; with different texts, the id is linked through any of
them.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, mix, pieces_of, shingle_hashes, split_words, texts, written
from .phrases import Sieve

THRESHOLD = 75  # per cent of the union
REGISTERS = 512
BAND_ROWS = 6
BANDS = 48  # a pair at the threshold misses all of them once in twelve thousand, at 0.8 once in two million
CHUNK = 512  # members of a bucket that are compared with each other at once
OPEN_CHUNK = 4096  # members of a bucket that meet another such chunk in one group: at most 8 MB of registers
BASE = 1.001
RATE = 20.0
LIMIT = 65_535
#: At the threshold an estimate's standard deviation is 0.019 with 512 registers;
#: a pair is discarded only if its estimate is about four of them lower.
MARGIN = 0.077


def sketches(elements: np.ndarray, owner: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers ``uint16[docs, registers]`` of sets given as (element, owner) rows.

    Each element is a Poisson process of points that fall on random registers;
    an element stops once its next point is later than the owner's latest
    register, so large sets need about one point per element.
    """
    least = np.full((docs, registers), np.inf)
    flat = least.reshape(-1)
    bound = np.full(docs, np.inf)
    time = np.zeros(len(elements))
    step = 0
    with np.errstate(over="ignore"):
        while len(elements):
            bits = mix(elements + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((bits >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / registers
            place = owner * registers + (mix(bits) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(flat, place, time)
            step += 1
            if step < 4 or step % 16 == 0:
                live = np.unique(owner)
                bound[live] = least[live].max(axis=1)
            going = time < bound[owner]
            if not going.all():
                elements, owner, time = elements[going], owner[going], time[going]
    with np.errstate(divide="ignore"):
        level = 1 - np.floor(np.log(least / RATE) / np.log(BASE))
    return np.clip(np.nan_to_num(level, neginf=0, posinf=LIMIT), 0, LIMIT).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Jaccard similarity of sketch rows by the likelihood of (larger, smaller, equal) registers, sizes known."""
    larger = (a > b).sum(axis=1)[:, None]
    smaller = (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - larger - smaller
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    tried = np.minimum(u / v, v / u) * np.linspace(0, 1, steps)[None, :]

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    only_a, only_b = chance(u - v * tried), chance(v - u * tried)
    with np.errstate(divide="ignore"):
        likelihood = sum(
            np.where(count > 0, count * np.log(np.maximum(p, 1e-300)), 0.0)
            for count, p in ((larger, only_a), (smaller, only_b), (equal, 1 - only_a - only_b))
        )
    return np.take_along_axis(tried, likelihood.argmax(axis=1)[:, None], 1)[:, 0]


def _sets(batch: pa.RecordBatch, words: WordHashes) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(words.of(split_words(t)))) for t in byte_texts(batch)]


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_hi, set_lo, registers`` of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces_of(batches, 3_000_000):
            sets = _sets(batch, words)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            regs = sketches(np.concatenate(sets) if sets else np.zeros(0, np.uint64), owner, len(sets))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "n_shingles", "set_hi", "set_lo", "registers"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, registers binary")


def banded(registers: np.ndarray) -> np.ndarray:
    """The registers that form the bands, one more axis; all registers count for estimates."""
    return registers[..., : BANDS * BAND_ROWS].reshape(*registers.shape[:-1], BANDS, BAND_ROWS)


def sieve_of(keys: DataFrame, column: str):
    """A bit map of 64-bit keys for the tasks, at most 32 MB; full ones only let more rows pass."""
    return keys.sparkSession.sparkContext.broadcast(Sieve.of(keys, column))


def ids_sieve(ids: DataFrame, column: str):
    return sieve_of(ids.select(F.xxhash64(column).alias("key")), "key")


def passing(batch: pa.RecordBatch, sieve) -> pa.RecordBatch:
    """The rows whose ``sieve_key`` is in the sieve."""
    return batch.filter(pa.array(sieve.value.holds(batch.column("sieve_key").to_numpy(zero_copy_only=False).view(np.uint64))))


def picked(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows of the given ids, and few others, without a shuffle of the rows."""
    sieve, names = ids_sieve(ids, id_column), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield passing(batch, sieve).select(names)

    return rows.withColumn("sieve_key", F.xxhash64(column)).mapInArrow(run, rows.schema)


def bands(classes: DataFrame, only=None) -> DataFrame:
    """``doc, bucket``: one row per class and band, of the buckets in the sieve if one is given; a bucket's number tells its band too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype="<u2")
                regs = banded(regs.reshape(batch.num_rows, -1)).astype(np.uint64)
                bucket = np.broadcast_to(np.arange(regs.shape[1], dtype=np.uint64), regs.shape[:2])
                with np.errstate(over="ignore"):
                    for j in range(BAND_ROWS):
                        bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, j] + np.uint64(1))
                doc, bucket = np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), regs.shape[1]), bucket.reshape(-1)
                if only is not None:
                    held = only.value.holds(bucket)
                    doc, bucket = doc[held], bucket[held]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(bucket.view(np.int64))], ["doc", "bucket"])

    return classes.select("doc", "registers").mapInArrow(run, "doc long, bucket long")


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches of whole groups with the row ranges of the groups; the input is sorted by the keys."""
    kept: pa.RecordBatch | None = None

    def ranges(batch: pa.RecordBatch) -> list[int]:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        return [0, *np.nonzero(new)[0].tolist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        cuts = ranges(batch)
        if len(cuts) > 1:
            yield batch.slice(0, cuts[-1]), list(zip(cuts, cuts[1:]))
        kept = batch.slice(cuts[-1])
    if kept is not None:
        yield kept, [(0, kept.num_rows)]


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal registers of every row of ``a`` with every row of ``b``."""
    return np.concatenate([(a[i : i + 64, None, :] == b[None, :, :]).mean(axis=2) for i in range(0, len(a), 64)])


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)
    return regs, batch.column("doc").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)


def _similar_sizes(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * np.minimum(a[:, None], b[None, :]) >= threshold * np.maximum(a[:, None], b[None, :])


def best_partners(crowded: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: for every member of a bucket's chunk the earlier member that agrees best, if it may be similar."""
    floor = threshold / 100 - MARGIN
    chunk = F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / F.lit(CHUNK))).alias("chunk")
    rows = crowded.select("bucket", chunk, "doc").join(classes.select("doc", "registers", "n"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in runs_of(batches, ["bucket", "chunk"]):
            regs, docs, sizes = _decoded(batch)
            first: list[np.ndarray] = []
            second: list[np.ndarray] = []
            for begin, end in groups:
                own = regs[begin:end]
                share = np.tril(agreement(own, own) * _similar_sizes(sizes[begin:end], sizes[begin:end], threshold), -1)
                best = share.argmax(axis=1)
                good = np.nonzero(share[np.arange(len(best)), best] >= floor)[0]
                first.append(docs[begin + best[good]])
                second.append(docs[begin + good])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], ["a", "b"])

    dealt = rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "doc")
    return dealt.select("bucket", "chunk", "doc", "n", "registers").mapInArrow(run, "a long, b long")


def tiles(lefts: np.ndarray, rights: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both sides cut into parts of at most ``CHUNK``; of a side with itself, only one half."""
    for i in range(0, len(lefts), CHUNK):
        for j in range(i if alone else 0, len(rights), CHUNK):
            yield lefts[i : i + CHUNK], rights[j : j + CHUNK]


def open_pairs(mixed: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: all pairs of different components in a bucket that may be similar, each from its first shared band only.

    ``mixed`` has ``bucket, size, doc, root``.  Chunk meets chunk in one group
    of at most two chunks, and is compared there in tiles.
    """
    floor = threshold / 100 - MARGIN
    chunks = F.ceil(F.col("size") / F.lit(OPEN_CHUNK))
    own = mixed.select("bucket", "doc", "root", F.pmod(F.xxhash64("doc"), chunks).alias("chunk"), chunks.alias("chunks"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "doc", "root"
    )
    rows = met.join(classes.select("doc", "registers", "n"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in runs_of(batches, ["bucket", "low", "high"]):
            regs, docs, sizes = _decoded(batch)
            roots, low, high, chunk, bucket = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "low", "high", "chunk", "bucket"))
            first: list[np.ndarray] = [np.zeros(0, np.int64)]
            second: list[np.ndarray] = [np.zeros(0, np.int64)]
            for begin, end in groups:
                here = np.arange(begin, end)
                lefts, rights = here[chunk[here] == low[begin]], here[chunk[here] == high[begin]]
                mine, alone = band_of(regs[begin], bucket[begin]), low[begin] == high[begin]
                for left, right in tiles(lefts, rights, alone):
                    apart = (roots[left][:, None] != roots[right][None, :]) & _similar_sizes(sizes[left], sizes[right], threshold)
                    if alone:
                        apart &= left[:, None] < right[None, :]
                    if not apart.any():
                        continue
                    i, j = np.nonzero(apart & (agreement(regs[left], regs[right]) >= floor))
                    for part in range(0, len(i), 4096):
                        x, y = left[i[part : part + 4096]], right[j[part : part + 4096]]
                        likely = similarity(regs[x], regs[y], sizes[x].astype(float), sizes[y].astype(float)) >= floor
                        x, y = x[likely], y[likely]
                        same = (banded(regs[x]) == banded(regs[y])).all(axis=2)
                        once = same.argmax(axis=1) == mine
                        first.append(np.minimum(docs[x[once]], docs[y[once]]))
                        second.append(np.maximum(docs[x[once]], docs[y[once]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], ["a", "b"])

    dealt = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "doc")
    return dealt.select("bucket", "low", "high", "chunk", "doc", "root", "n", "registers").mapInArrow(run, "a long, b long")


def band_of(registers: np.ndarray, bucket: int) -> int:
    """The band of a member that fell into this bucket."""
    regs = banded(registers).astype(np.uint64)
    value = np.arange(len(regs), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(BAND_ROWS):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + regs[:, j] + np.uint64(1))
    return int(np.nonzero(value.view(np.int64) == bucket)[0][0])


def plausible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``a, b`` whose joint likelihood estimate is not hopeless."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("doc").alias(name), F.col("registers").alias(f"r{name}"), F.col("n").alias(f"n{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                rows = batch.num_rows
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(rows, -1) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
                good = similarity(a, b, na, nb) >= threshold / 100 - MARGIN
                good &= 100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    """``doc`` of every pair's ends."""
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()


def confirmed(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets are similar: ``100 * intersection >= threshold * union``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in pieces_of(passing(b, sieve) for b in batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s.tobytes() for s in _sets(batch, words)], pa.binary())], ["doc", "elements"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for row in range(batch.num_rows):  # views into the batch, no copies
                one, other = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=np.uint64) for c in ("xa", "xb"))
                at = np.minimum(np.searchsorted(one, other), len(one) - 1)
                both = int((one[at] == other).sum())
                good[row] = 100 * both >= threshold * (len(one) + len(other) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))
            del batch
            pa.default_memory_pool().release_unused()

    sieve = ids_sieve(ends(pairs), "doc")
    rows = members.select("doc_id", "text", F.xxhash64("doc_id").alias("sieve_key"))
    packed = written(rows.mapInArrow(pack, "doc long, elements binary"), "sets")
    joined = pairs.join(packed.select(F.col("doc").alias("b"), F.col("elements").alias("xb")), "b").join(
        packed.select(F.col("doc").alias("a"), F.col("elements").alias("xa")), "a"
    )
    return joined.select("a", "b", "xa", "xb").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``doc, root``: the smallest document reachable, for documents with an edge.

    Every round takes the smallest label among the neighbours and then the
    label of that label, so a chain shrinks by half; rounds end when no label
    changes.  All state stays in tables.
    """
    both = written(
        edges.select(F.col("a").alias("doc"), F.col("b").alias("other"))
        .unionByName(edges.select(F.col("b").alias("doc"), F.col("a").alias("other")))
        .distinct(),
        "edges",
    )
    labels = written(both.groupBy("doc").agg(F.min("other").alias("m")).select("doc", F.least("doc", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("other"), F.col("root").alias("near")), "other").groupBy("doc").agg(
            F.min("near").alias("near")
        )
        lower = labels.join(near, "doc").select("doc", "root", F.least("root", "near").alias("next"))
        jumped = written(
            lower.join(labels.select(F.col("doc").alias("next"), F.col("root").alias("jump")), "next", "left").select(
                "doc", "root", F.least("next", "jump").alias("after")
            ),
            "labels",
        )
        if jumped.where("root <> after").isEmpty():
            return jumped.select("doc", "root")
        labels = jumped.select("doc", F.col("after").alias("root"))


def linked_classes(classes: DataFrame, members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc, root`` of the classes that are linked with another class."""
    shared = written(
        bands(classes).groupBy("bucket").agg(F.min("doc").alias("leader"), F.max("doc").alias("last"), F.count("*").alias("size")).where("size > 1"),
        "shared",
    )
    two = written(shared.where("size = 2").select(F.col("leader").alias("a"), F.col("last").alias("b")).distinct(), "two")
    many = shared.where("size > 2").select("bucket", "size")
    crowded = written(bands(classes, sieve_of(many, "bucket")).join(many, "bucket"), "crowded")
    met = ends(two).unionByName(crowded.select("doc")).distinct()
    live = written(picked(classes.select("doc", "registers", "n"), "doc", met, "doc"), "live")

    def links(pairs: DataFrame) -> DataFrame:
        return confirmed(written(plausible(pairs, live, threshold), "pairs"), members, threshold)

    edges = written(links(two.unionByName(best_partners(crowded, live, threshold)).distinct()), "links")
    labels = components(edges)

    # what is left: members of different components in one bucket
    named = crowded.join(labels, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    several = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    rest = written(open_pairs(named.join(several, "bucket").select("bucket", "size", "doc", "root"), live, threshold), "open")
    more = written(confirmed(rest, members, threshold), "links")
    return labels if more.isEmpty() else components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    members = texts(docs)
    sketch = written(sketched(docs), "sketches")
    known = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(
        known.groupBy("set_hi", "set_lo").agg(
            F.min("doc_id").alias("doc"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n")
        ),
        "classes",
    )
    linked = linked_classes(classes, members, threshold)
    roots = classes.join(linked, "doc", "left").select("set_hi", "set_lo", F.coalesce("root", "doc").alias("root"))
    out = sketch.select("doc_id", "n_shingles", "set_hi", "set_lo").join(roots, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
