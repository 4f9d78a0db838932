"""References and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import citation_link


def keep_first_refs(refs: DataFrame, keys: list[str], position: str, payload: list[str] | None = None) -> DataFrame:
    """One reference per (keys, document, page), the first; page defaults to 1."""
    payload = payload or []
    paged = refs.withColumn("source_page", F.coalesce(F.col("source_page").cast("int"), F.lit(1))).where(
        F.coalesce(F.col("document_id").cast("string"), F.lit("")) != ""
    )
    first = F.min(F.struct(F.col(position), *payload))
    return paged.groupBy(*keys, "document_id", "source_page").agg(first.alias("_f")).select(
        *keys, "document_id", "source_page", "_f.*"
    )


def union_refs(left: DataFrame, right: DataFrame, keys: list[str], position: str, payload: list[str] | None = None) -> DataFrame:
    """Left references before right ones, then the first per page."""
    tagged = left.withColumn("_src", F.lit(0)).unionByName(right.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    ordered = tagged.withColumn("_pos", F.struct("_src", position)).drop(position)
    kept = keep_first_refs(ordered, keys, "_pos", payload)
    return kept.withColumn(position, F.col(f"_pos.{position}")).withColumn("source_rank", F.col("_pos._src")).drop("_pos")


def numbered_citations(refs: DataFrame, keys: list[str], position: str, limit: int | None = None) -> DataFrame:
    """The references of an answer, numbered, with their links; the first ``limit`` if asked."""
    w = Window.partitionBy(*keys).orderBy(position, "document_id", "source_page")
    top = refs.withColumn("number", F.row_number().over(w))
    top = top if limit is None else top.where(F.col("number") <= limit)
    bbox = F.col("source_bbox") if "source_bbox" in refs.columns else F.array().cast("array<float>")
    link = citation_link(F.col("document_id").cast("string"), F.col("source_page"), bbox)
    return top.withColumn("link", link)
