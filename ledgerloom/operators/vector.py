"""Exact cosine top-k, keyword rerank, point upserts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    DEFAULT_VECTOR_DIM,
    DEFAULT_VECTOR_VALUE,
    RERANK_TERMS,
    VECTOR_CANDIDATES,
    VECTOR_RETURNED,
)
from ..functions.ids import name_uuid

QUERY_BLOCK = 256
POINT_PART = 8192


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a constant query, inside the JVM."""
    size = float(np.sqrt(sum(float(x) * float(x) for x in query))) or 1.0
    q = F.array(*[F.lit(float(x) / size) for x in query])
    product = F.zip_with(vector.cast("array<double>"), q, lambda a, b: a * b)
    dot = F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))
    return dot / F.nullif(norm, F.lit(0.0))


def top_k(points: DataFrame, query: list[float], tenant: str | None = None, document: str | None = None, k: int = VECTOR_CANDIDATES, vector: str = "vector", tie: str = "id") -> DataFrame:
    """The k nearest points of a tenant (and document), best first.

    A document without points falls back to the tenant: both are ranked in
    one pass and the best present tier stays.
    """
    scoped = points if tenant is None else points.where(F.col("tenant_id") == tenant)
    scored = scoped.withColumn("score", cosine(F.col(vector), query))
    if document is None:
        return scored.orderBy(F.col("score").desc(), tie).limit(k)
    tier = F.when(F.col("document_id") == document, 0).otherwise(1)
    best = scored.withColumn("_tier", tier).orderBy("_tier", F.col("score").desc(), tie).limit(k)
    present = best.agg(F.min("_tier").alias("_best")).withColumn("_one", F.lit(1))
    return best.withColumn("_one", F.lit(1)).join(present, "_one").where("_tier = _best").drop("_tier", "_best", "_one")


def top_k_batch(points: DataFrame, queries: DataFrame, k: int = VECTOR_CANDIDATES, vector: str = "vector", tie: str = "id") -> DataFrame:
    """The ``k`` best points of every query (``query_id, query_vector``) by cosine, ties by ``tie``.

    Blocks of queries meet parts of the points as groups of bounded size; each
    group keeps ``k`` per query.  Neither side passes through the driver.
    """
    kind = dict(points.dtypes)[tie]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {tie} {kind}, score double"
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = max(1, -(-points.count() // POINT_PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select("query_id", "query_vector", deal("query_id", blocks).alias("_block"), every(parts).alias("_part"))
    right = points.select(tie, vector, deal(tie, parts).alias("_part"), every(blocks).alias("_block"))

    def unit(rows: pd.Series) -> np.ndarray:
        m = np.asarray(rows.tolist(), dtype=np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": asked["query_id"][:0], tie: held[tie][:0], "score": np.zeros(0)})
        scores, keys = unit(asked["query_vector"]) @ unit(held[vector]).T, held[tie].to_numpy()
        order = np.stack([np.lexsort((keys, -row))[:k] for row in scores])
        return pd.DataFrame({
            "query_id": np.repeat(asked["query_id"].to_numpy(), order.shape[1]), tie: keys[order].reshape(-1),
            "score": np.take_along_axis(scores, order, 1).reshape(-1),
        })

    found = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInPandas(best, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_score(text: Column, question: str) -> Column:
    """Question words longer than two letters count 1, finance terms 3."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for word in question.lower().split():
        if len(word) > 2:
            total = total + F.when(lowered.contains(word), 1.0).otherwise(0.0)
    for term in RERANK_TERMS:
        total = total + F.when(lowered.contains(term), 3.0).otherwise(0.0)
    return total


def rerank(candidates: DataFrame, question: str, text: str = "text", k: int = VECTOR_RETURNED, pool: int | None = None, tie: str = "id", snippet_chars: int | None = None) -> DataFrame:
    """The best ``k`` by keywords, of all candidates or of the first ``pool``; the vector score breaks ties."""
    first = candidates if pool is None else candidates.orderBy(F.col("score").desc(), tie).limit(pool)
    scored = first.withColumn("keyword_score", keyword_score(F.col(text), question))
    return scored.withColumn("snippet", F.col(text) if snippet_chars is None else F.substring(text, 1, snippet_chars)).orderBy(
        F.col("keyword_score").desc(), F.col("score").desc(), tie
    ).limit(k)


def with_vectors(nodes: DataFrame, vectors: DataFrame, dim: int = DEFAULT_VECTOR_DIM) -> DataFrame:
    """Vector of each non-blank node; a constant vector where none was computed."""
    usable = nodes.where(F.coalesce(F.trim("content") != "", F.lit(False)) & (F.col("type") != "IMAGE"))
    default = F.array_repeat(F.lit(DEFAULT_VECTOR_VALUE), dim).cast("array<float>")
    joined = usable.join(vectors.select("document_id", "node_id", "vector"), ["document_id", "node_id"], "left")
    return joined.withColumn("vector", F.coalesce("vector", default))


def points_of(chunks: DataFrame) -> DataFrame:
    """Vector points with a stable id from (document, node)."""
    return chunks.withColumn("id", name_uuid(F.col("document_id"), F.col("node_id")))
