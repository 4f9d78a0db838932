"""Approximate nearest neighbours: vantage-point trees per shard.

Different vectors are dealt over shards of bounded size, shards over groups
and queries over parts of bounded size.  Each group meets each part in one
cell: a task holds the part's queries, reads the group's shards one after the
other, builds one vantage-point tree of each over unit vectors (whose
Euclidean distance falls as the cosine rises) and answers a block of queries
at a time: all queries of the block walk the tree together, each along its own
branches.  A branch is skipped when the triangle inequality, with its slack
multiplied by ``factor``, says it can't hold a nearer vector than those of the
shards before; factor one is exact search, larger factors skip more.
Candidates are scored again on the original vectors in double precision.

Rows are copied to cells by a union and one shuffle.  A join would take the
copies for as small as the rows they are made of, and broadcast them.

Equal vectors are one point with its ``k + 1`` smallest ids, which is all a
list of ``k`` can need, so a very common vector costs no more than any other.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id.  Only vectors of equal
dimension are compared.  Repeated rows count once; of one id with several
vectors each may be found, the id once.  Ties go to the smaller id.  Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
GROUPS = 64  # of shards, each with a copy of all queries; more only where the index is copied as often
HELD_BYTES = 64 << 20  # of the query vectors in a part
LEAF = 64
FACTOR = 1.0
POOL = 1_000_000  # pairs held before the best are chosen
_TIE = 1e-9


class Tree:
    """Vantage-point tree over unit rows; nodes are ``(point, radius, inside, outside)`` or an array of points."""

    def __init__(self, units: np.ndarray, leaf: int = LEAF):
        self.units, self.leaf = units, leaf
        self.root = self._build(np.arange(len(units)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point, rest = rows[len(rows) // 2], np.delete(rows, len(rows) // 2)
        away = distances(self.units[point][None, :], self.units[rest])[0]
        radius = float(np.median(away))
        near = away <= radius
        if near.all() or not near.any():
            return rows  # all equally far: no radius divides them
        return point, radius, self._build(rest[near]), self._build(rest[~near])

    def search(self, queries: np.ndarray, k: int, factor: float = FACTOR, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and row numbers of the ``k`` nearest rows of each unit query (inf and -1 past the last).

        ``far`` has distances already found elsewhere, nearest first; they compete, with row number -1.
        """
        self.far = np.full((len(queries), k), np.inf) if far is None else far.copy()
        self.rows = np.full((len(queries), k), -1, dtype=np.int64)
        self.queries, self.factor = queries, factor
        if len(self.units):
            self._visit(self.root, np.arange(len(queries)))
        return self.far, self.rows

    def within(self, queries: np.ndarray, reach: np.ndarray, factor: float = FACTOR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Query and row numbers of all rows at most ``reach`` from their query, leaf by leaf."""
        left = [(self.root, np.arange(len(queries)))] if len(self.units) else []
        while left:
            node, active = left.pop()
            if not len(active):
                continue
            if isinstance(node, np.ndarray):
                for begin in range(0, len(node), self.leaf):  # equally far points are one leaf of any size
                    rows = node[begin : begin + self.leaf]
                    query, row = np.nonzero(distances(queries[active], self.units[rows]) <= reach[active, None])
                    yield active[query], rows[row]
                continue
            point, radius, inside, outside = node
            away = distances(queries[active], self.units[point][None, :])[:, 0]
            hit = active[away <= reach[active]]
            yield hit, np.full(len(hit), point)
            left.append((inside, active[(away - radius) * factor <= reach[active]]))
            left.append((outside, active[(radius - away) * factor <= reach[active]]))

    def _offer(self, active: np.ndarray, rows: np.ndarray, away: np.ndarray) -> None:
        nearer = (away < self.far[active, -1:]).any(axis=1)
        active, away = active[nearer], away[nearer]
        far = np.concatenate([self.far[active], away], axis=1)
        own = np.concatenate([self.rows[active], np.broadcast_to(rows, away.shape)], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, : self.far.shape[1]]
        self.far[active] = np.take_along_axis(far, order, 1)
        self.rows[active] = np.take_along_axis(own, order, 1)

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._offer(active, node, distances(self.queries[active], self.units[node]))
            return
        point, radius, inside, outside = node
        away = distances(self.queries[active], self.units[point][None, :])
        self._offer(active, np.array([point]), away)
        slack = np.abs(away[:, 0] - radius) * self.factor
        near = away[:, 0] <= radius
        self._visit(inside, active[near])
        self._visit(outside, active[~near])
        self._visit(outside, active[near & (slack <= self.far[active, -1] + _TIE)])
        self._visit(inside, active[~near & (slack <= self.far[active, -1] + _TIE)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & sane)


def stretches(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """Key, ids and matrix of every stretch of rows of one key; the rows are sorted by the keys."""
    last: tuple[int, ...] = ()
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = (np.nonzero((values[1:] != values[:-1]).any(axis=1))[0] + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, len(values)]):
            key = tuple(values[begin].tolist())
            if ids and key != last:
                yield last, np.concatenate(ids), np.concatenate(rows)
                ids, rows = [], []
            last, part = key, batch.slice(begin, end - begin)
            ids.append(part.column("id").to_numpy(zero_copy_only=False))
            rows.append(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(end - begin, -1))
    if ids:
        yield last, np.concatenate(ids), np.concatenate(rows)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest cosines of each query, its own id left out.

    Both tables hold ``vec_id`` and ``embedding``.  ``queries`` is a stated
    set that meets all shards block by block.  Queries are copied to all groups
    of shards and the index to all parts of queries.
    """
    points, asked = usable(vectors).distinct(), usable(queries).distinct()
    # one point per vector: row-number limits act before the shuffle, so a common vector sends a few ids per task
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    few = points.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    different = written(
        few.groupBy("vector").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids"),
                                  F.size(F.first("vector")).cast("long").alias("dimension")),
        "points",
    )
    heads = written(asked.groupBy("vector").agg(F.min("vec_id").alias("query"), F.size(F.first("vector")).cast("long").alias("dimension")), "heads")
    rows, (asked_rows, width) = different.count(), heads.agg(F.count("*"), F.max("dimension")).first()
    single = all(t.select("embedding").dtypes[0][1] == "array<float>" for t in (vectors, queries))
    kept_as, size = ("array<float>", 4) if single else ("array<double>", 8)
    shards = max(1, -(-rows // shard_rows))
    parts = max(1, -(-asked_rows * (width or 0) * size // HELD_BYTES))
    groups = min(shards, max(GROUPS, parts * rows // max(1, asked_rows)))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # a hash of the vector breaks the equality of point ids that one id with several vectors would have
    shard = F.pmod(F.xxhash64("point", F.lit(11)), F.lit(shards)).cast("long")
    part = F.pmod(F.xxhash64("query", F.lit(12)), F.lit(parts)).cast("long")
    index = different.select("dimension", (shard % groups).alias("group"), each(parts).alias("part"), shard.alias("shard"),
                             F.col("point").alias("id"), F.col("vector").cast(kept_as).alias("vector"))
    wanted = heads.select("dimension", each(groups).alias("group"), part.alias("part"), F.lit(-1).cast("long").alias("shard"),
                          F.col("query").alias("id"), F.col("vector").cast(kept_as).alias("vector"))
    cell = ["dimension", "group", "part"]
    dealt = index.unionByName(wanted).repartition(2 * groups * parts, *cell).sortWithinPartitions(*cell, "shard", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, met in groupby(stretches(batches, [*cell, "shard"]), key=lambda x: x[0][:3]):
            first, ids, matrix = next(met)
            if first[3] < 0:  # else no query has this dimension
                yield from best_of_cell(ids, matrix, ((i, m) for _, i, m in met), k, factor, query_block)

    hits = dealt.mapInArrow(run, "query long, point long, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    best = hits.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k + 1)
    named = best.join(different.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    kept = named.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ).where(F.col("place") <= k + 1)
    lists = kept.groupBy("query").agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("found"))
    # every query takes the list of its vector; a file of repetitive vectors is far smaller than the table that a broadcast would hold
    members = asked.join(heads.select("vector", "query").hint("merge"), "vector").select(F.col("vec_id").alias("query_id"), "query")
    out = members.join(lists, "query").select("query_id", F.explode("found").alias("f")).where("f.vec_id <> query_id")
    once = out.groupBy("query_id", "f.vec_id").agg(F.max("f.score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def best_of_cell(query_ids: np.ndarray, wanted: np.ndarray, shards: Iterable[tuple[np.ndarray, np.ndarray]], k: int, factor: float,
                 query_block: int = QUERY_BLOCK) -> Iterator[pa.RecordBatch]:
    """The nearest of all shards for each query, a batch for each block of queries."""
    blocks = [slice(begin, begin + query_block) for begin in range(0, len(query_ids), query_block)]
    far = np.full((len(query_ids), k + 1), np.inf)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in blocks]
    for ids, matrix in shards:
        own = matrix.astype(np.float64)
        tree = Tree(unit(own))
        for n, block in enumerate(blocks):
            far[block], best[n] = best_of(tree, ids, own, wanted[block].astype(np.float64), far[block], best[n], k, factor)
    for block, (query, point, score) in zip(blocks, best):
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[block][query]), pa.array(point), pa.array(score)], ["query", "point", "score"])


def best_of(tree: Tree, ids, own, wanted, far, kept, k: int, factor: float):
    """``far`` and ``kept`` of a block of queries after one more shard, scored on the original vectors.

    A first walk finds how far the last wanted vector of all shards so far is,
    a second one all vectors up to there, so equal scores are decided by id
    alone.  ``kept`` has query numbers, ids and scores as in ``best_pairs``.
    """
    asked = unit(wanted)
    far, _ = tree.search(asked, k + 1, factor, far)
    reach = np.sqrt(far[:, -1] ** 2 + 1e-12) + 1e-7  # above the rounding of a distance, which is largest near zero
    new, size = [], 0
    step = max(1, 4_000_000 // own.shape[1])
    for queries, points in tree.within(asked, reach, factor):
        for begin in range(0, len(queries), step):
            query, point = queries[begin : begin + step], points[begin : begin + step]
            a, b = wanted[query], own[point]
            score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            new.append((query, ids[point], score))
        size += len(queries)
        if size > POOL:
            kept, new, size = best_pairs([kept, *new], k + 1), [], 0
    return far, best_pairs([kept, *new], k + 1)


def best_pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score): each query's scores of rank up to ``k``, and of equal scores the ``k`` smallest ids."""
    query, point, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((point, -score, query))
    query, point, score = query[order], point[order], score[order]
    if not len(query):
        return query, point, score
    changed = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
    place = np.arange(len(query))
    of_query = changed(query)
    of_tie = of_query | changed(score)
    other = np.cumsum(of_tie | changed(point))
    tie = np.maximum.accumulate(np.where(of_tie, place, 0))
    rank = tie - np.maximum.accumulate(np.where(of_query, place, 0))
    keep = (rank < k) & (other - other[tie] < k)
    return query[keep], point[keep], score[keep]
