"""Exact duplicates and first-seen keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_hash, uri_parts


def with_content_hash(df: DataFrame, content: str, out: str = "file_hash") -> DataFrame:
    return df.withColumn(out, content_hash(F.col(content)))


def firsts(df: DataFrame, key: str, order: list[str], row_id: str) -> DataFrame:
    """Row id of the first row per key.

    A minimum per key with partial aggregation: a key that a third of all
    rows share sends one value per task through the shuffle.
    """
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(row_id).alias("id"))
    return df.groupBy(key).agg(F.min(rank).alias("_m")).select(F.col("_m.id").alias(row_id))


def flag_duplicates(df: DataFrame, key: str, order: list[str], row_id: str, seen: DataFrame | None = None) -> DataFrame:
    """Adds ``is_duplicate``: a later copy in the batch, or a key seen before.

    The first rows come back by their own (unique) id, so the join never
    piles the copies of one key into one task.
    """
    first = firsts(df, key, order, row_id)
    if seen is not None:
        fresh = df.select(key, row_id).join(first, row_id).join(seen.select(key).distinct(), key, "left_anti")
        first = fresh.select(row_id)
    flagged = df.join(first.withColumn("_first", F.lit(True)), row_id, "left")
    return flagged.withColumn("is_duplicate", F.col("_first").isNull()).drop("_first")


def triage(events: DataFrame, seen: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Ingest events with result, route and status.

    Rows: event_id, tenant_id, s3_uri, file_hash_sha256, metadata map and the
    order columns.  An exact duplicate is dropped and its file listed for
    cleanup; a version update is processed like a new document.
    """
    flagged = flag_duplicates(events, "file_hash_sha256", order or ["event_id"], "event_id", seen)
    version = F.coalesce(F.col("metadata")["is_version_update"] == "true", F.lit(False))
    result = F.when(F.col("is_duplicate"), "EXACT_DUPLICATE").when(version, "VERSION_UPDATE").otherwise("NEW_DOCUMENT")
    return flagged.withColumn("result", result).withColumns(
        {
            "route": F.when(F.col("is_duplicate"), "cleanup").otherwise("process"),
            "status": F.when(F.col("is_duplicate"), "DUPLICATE").otherwise("IN_PROGRESS"),
        }
    )


def status_events(triaged: DataFrame) -> DataFrame:
    """Status rows a triage run publishes."""
    return triaged.select(
        F.col("event_id").alias("document_id"), "tenant_id",
        F.coalesce(F.col("metadata")["original_filename"], F.lit("unknown")).alias("filename"),
        F.lit("triage").alias("current_stage"), "status",
        F.when(F.col("status") == "DUPLICATE", "Exact duplicate dropped").otherwise("").alias("error_message"),
    )


def cleanup_list(triaged: DataFrame) -> DataFrame:
    """Objects of duplicates, to be deleted elsewhere."""
    return triaged.where("route = 'cleanup'").select("s3_uri", uri_parts(F.col("s3_uri")).alias("p")).select("s3_uri", "p.*")


def new_etags(events: DataFrame, recent: DataFrame, known: DataFrame) -> DataFrame:
    """Discovered objects neither claimed recently nor stored before."""
    return events.join(recent.select("etag"), "etag", "left_anti").join(known.select("etag"), "etag", "left_anti")


def claim_etags(new: DataFrame, order: Column | str) -> DataFrame:
    """One event per new etag, the first by ``order``."""
    rest = [c for c in new.columns if c != "etag"]
    return new.groupBy("etag").agg(F.min_by(F.struct(*rest), order).alias("_e")).select("etag", "_e.*")
