"""Waiting for all chunks of a document.

The state of a document is small: which chunk numbers have arrived, how many
there will be, when the first came.  Nodes are not kept in state; they are
appended to a staging table as they come, and a ready marker (complete, or
timed out) tells which chunks to read back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..fixed_values import ASSEMBLY_TIMEOUT_SECONDS
from ..operators.layout import assembled_order
from ..sources.sinks import append

READY = (
    "tenant_id string, document_id string, chunk_total int, chunks_received int, "
    "chunk_indexes array<int>, reason string"
)
_STATE = "chunk_total int, chunk_indexes array<int>"


def chunk_events(trees: DataFrame) -> DataFrame:
    """(tenant_id, document_id, chunk_index, chunk_total) from document metadata.

    A document without id gets one from its tenant.
    """
    number = lambda k: F.coalesce(F.col("metadata")[k].try_cast("int"), F.lit(0))
    document = F.coalesce(F.nullif("document_id", F.lit("")), F.concat(F.lit("doc_"), "tenant_id"))
    return trees.withColumns(
        {"document_id": document, "chunk_index": number("chunk_index"), "chunk_total": number("chunk_total")}
    )


class ChunkBarrier(StatefulProcessor):
    """Emits a ready marker when all chunks are there or the wait is over.

    The total is the largest seen; the same chunk again counts once; a chunk
    after the marker starts anew.
    """

    def __init__(self, timeout_seconds: float = ASSEMBLY_TIMEOUT_SECONDS):
        self.timeout_ms = int(timeout_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _marker(self, key, total: int, indexes: list[int], reason: str) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "tenant_id": [key[0]], "document_id": [key[1]], "chunk_total": [total],
                "chunks_received": [len(indexes)], "chunk_indexes": [sorted(indexes)], "reason": [reason],
            }
        )

    def _cancel(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.seen.get() if self.seen.exists() else None
        total, indexes = (int(stored[0]), list(stored[1])) if stored else (0, [])
        fresh = stored is None
        for batch in rows:
            for index, announced in zip(batch["chunk_index"], batch["chunk_total"]):
                if not indexes and announced <= 1:
                    yield self._marker(key, 1, [int(index)], "single")
                    continue
                total = max(total, int(announced))
                if int(index) not in indexes:
                    indexes.append(int(index))
                if len(indexes) >= total:
                    yield self._marker(key, total, indexes, "complete")
                    total, indexes, fresh = 0, [], True
                    self._cancel()
        if indexes:
            if fresh:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(now + self.timeout_ms)
            self.seen.update((total, indexes))
        elif self.seen.exists():
            self.seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            total, indexes = self.seen.get()
            self.seen.clear()
            yield self._marker(key, int(total), list(indexes), "timeout")

    def close(self) -> None:
        pass


def ready_documents(events: DataFrame, timeout_seconds: float = ASSEMBLY_TIMEOUT_SECONDS) -> DataFrame:
    """Ready markers of a stream of (tenant_id, document_id, chunk_index, chunk_total)."""
    slim = events.select("tenant_id", "document_id", "chunk_index", "chunk_total")
    return slim.groupBy("tenant_id", "document_id").transformWithStateInPandas(
        statefulProcessor=ChunkBarrier(timeout_seconds), outputStructType=READY,
        outputMode="append", timeMode="processingTime",
    )


def assemble(ready: DataFrame, staged: DataFrame) -> DataFrame:
    """Nodes of the ready documents in page order, from the staging table.

    ``staged``: tenant_id, document_id, chunk_index, received_at and node
    columns.  The newest arrival of a chunk counts.
    """
    keys = ["tenant_id", "document_id", "chunk_index"]
    wanted = ready.select("tenant_id", "document_id", F.explode("chunk_indexes").alias("chunk_index")).distinct()
    newest = staged.join(wanted, keys, "left_semi")
    last = newest.groupBy(*keys).agg(F.max("received_at").alias("received_at"))
    kept = newest.join(last, [*keys, "received_at"], "left_semi")
    return assembled_order(kept, ["tenant_id", "document_id"])


def start_staging(nodes: DataFrame, path: str, checkpoint: str, **trigger):
    """Append every arriving node to the staging table, by tenant."""
    return (
        nodes.writeStream.foreachBatch(lambda batch, number: append(batch, path, ["tenant_id"], number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )
