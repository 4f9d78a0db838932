"""Change feeds: rows to text chunks, schemas to waiting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CHUNK_CHARS, CHUNK_OVERLAP
from ..functions.hof import presence
from ..functions.ids import name_uuid
from ..functions.text import chunk_text
from ..operators.alignment import remap_drift, requeue
from ..operators.catalog import promotable_rows
from ..registry import Registry
from ..sources.keyed import KeyedTable
from ..sources.sinks import append, latest_per_key


def newest_changes(changes: DataFrame, order: list[str]) -> DataFrame:
    """The last change of each (document, node) with the state it leaves."""
    state = F.coalesce("after", "before")
    flat = changes.where(F.col("op").isin("c", "u", "d")).select("op", *order, state.alias("s"))
    named = flat.select("op", *order, "s.*").where(presence(F.col("node_id")).isNotNull())
    return latest_per_key(named, ["document_id", "node_id"], order)


def chunk_changes(changes: DataFrame, order: list[str], size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunk rows of the changed nodes: new chunks, and markers for the removed.

    A node with one chunk keeps its id, several get ``_0``, ``_1``, …
    ``deleted`` marks nodes that are gone.
    """
    newest = newest_changes(changes, order)
    alive = newest.where(F.col("op").isin("c", "u") & presence(F.col("document_id")).isNotNull())
    text = alive.withColumn("content", F.coalesce("content", F.lit("")))
    cut = chunk_text(text, "content", size, overlap)
    chunk_id = F.when(F.col("chunk_count") > 1, F.concat("node_id", F.lit("_"), F.col("chunk_index").cast("string"))).otherwise(F.col("node_id"))
    chunks = cut.select(
        "tenant_id", "document_id", F.col("node_id").alias("original_node_id"), chunk_id.alias("node_id"),
        F.col("chunk_text").alias("text"), "source_page", "source_bbox", *order, F.lit(False).alias("deleted"),
    )
    gone = newest.where("op = 'd'").select(
        "tenant_id", "document_id", F.col("node_id").alias("original_node_id"), "node_id",
        F.lit(None).cast("string").alias("text"), "source_page", "source_bbox", *order, F.lit(True).alias("deleted"),
    )
    return chunks.unionByName(gone).withColumn("id", name_uuid(F.col("document_id"), F.col("node_id")))


def write_chunks(changes: DataFrame, path: str, order: list[str], number: int | None = None) -> None:
    """Bring the chunk table up to date with one batch of changes.

    Old chunks of a changed or deleted node that are not written again are
    removed with it.  A replayed batch writes nothing.
    """
    table = KeyedTable(changes.sparkSession, path, ["id"], order)
    if number is not None and not table.is_new and table.holds(number):
        return
    rows = chunk_changes(changes, order).persist()
    try:
        current = table.read()
        updates = rows
        if current is not None:
            touched = rows.select("document_id", "original_node_id", *order).distinct()
            old = current.where("NOT deleted").drop(*order).join(touched, ["document_id", "original_node_id"])
            stale = old.join(rows.where("NOT deleted").select("id"), "id", "left_anti").withColumn("deleted", F.lit(True))
            updates = rows.unionByName(stale.select(*rows.columns))
        table.upsert(updates, number)
    finally:
        rows.unpersist()


def start_chunk_sync(changes: DataFrame, path: str, checkpoint: str, order: list[str], **trigger):
    return (
        changes.writeStream.foreachBatch(lambda batch, number: write_chunks(batch, path, order, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


HISTORY_KEYS = ["tenant_id", "target_table", "raw_label", "seq"]


def write_dictionary(changes: DataFrame, path: str, number: int | None = None) -> None:
    """Keep all versions of the label dictionary: (op, tenant_id, target_table, raw_label, mapped_column, at, seq).

    The state after a change counts, or before a deletion.
    """
    state = F.coalesce("after", "before")
    flat = changes.where(F.col("op").isin("c", "u", "d")).select("op", state.alias("s"), "seq")
    rows = flat.select(
        "op", "s.tenant_id", "s.target_table", "s.raw_label", "s.mapped_column",
        F.to_timestamp("s.updated_at").alias("at"), "seq",
    ).where(F.col("raw_label").isNotNull() & F.col("at").isNotNull())
    KeyedTable(changes.sparkSession, path, HISTORY_KEYS, ["at"]).upsert(rows, number)


def start_dictionary(changes: DataFrame, path: str, checkpoint: str, **trigger):
    return (
        changes.writeStream.foreachBatch(lambda batch, number: write_dictionary(batch, path, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def write_remapped(rows: DataFrame, dictionary: str, out: str, registry: Registry, at: str, number: int) -> None:
    """Map one batch of rows with the dictionary as it stood at each row's time."""
    known = KeyedTable(rows.sparkSession, dictionary, HISTORY_KEYS, ["at"]).read()
    if known is None:
        known = rows.sparkSession.createDataFrame([], "op string, tenant_id string, target_table string, raw_label string, mapped_column string, at timestamp, seq bigint")
    append(remap_drift(rows, known, registry, at=at), out, batch=number)


def start_remapping(rows: DataFrame, dictionary: str, out: str, checkpoint: str, registry: Registry, at: str = "event_time", **trigger):
    return (
        rows.writeStream.foreachBatch(lambda batch, number: write_remapped(batch, dictionary, out, registry, at, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def write_promotions(changes: DataFrame, rows_path: str, out_path: str, number: int = 0) -> None:
    """Send waiting rows of changed schemas to alignment again.

    ``changes``: op and the after state with target_table.
    """
    rows = changes.sparkSession.read.parquet(rows_path)
    tables = changes.select("op", F.col("after.target_table").alias("target_table"))
    append(requeue(promotable_rows(tables, rows)), out_path, batch=number)


def start_auto_promote(changes: DataFrame, rows_path: str, out_path: str, checkpoint: str, **trigger):
    return (
        changes.writeStream.foreachBatch(lambda batch, number: write_promotions(batch, rows_path, out_path, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )
