"""Ingest triage and object discovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..fixed_values import ETAG_CLAIM_SECONDS, ETAG_MEMORY_SECONDS
from ..operators.dedup import claim_etags, cleanup_list, new_etags, status_events, triage
from ..sources.sinks import append, insert_ignore, read_or_none


def write_triaged(events: DataFrame, root: str, order: list[str], number: int = 0) -> None:
    """Triage one batch against the hashes stored under ``root``.

    Writes routed events, status events and the cleanup list, then remembers
    the new hashes with the event that brought them.  A repeated batch finds
    its own first events again, so it routes them as before; with its
    ``number`` it replaces what it wrote.
    """
    stored = read_or_none(events.sparkSession, f"{root}/hashes")
    seen = None
    if stored is not None:
        mine = events.select("file_hash_sha256", "event_id")
        seen = stored.join(mine, ["file_hash_sha256", "event_id"], "left_anti")
    routed = triage(events, seen, order)
    batch = routed.persist()
    try:
        append(batch, f"{root}/routed", ["route"], number)
        append(status_events(batch), f"{root}/status", batch=number)
        append(cleanup_list(batch), f"{root}/cleanup", batch=number)
        insert_ignore(
            batch.where("NOT is_duplicate").select("file_hash_sha256", "event_id"), f"{root}/hashes", ["file_hash_sha256"]
        )
    finally:
        batch.unpersist()


def start_triage(events: DataFrame, root: str, checkpoint: str, order: list[str], **trigger):
    return (
        events.writeStream.foreachBatch(lambda batch, number: write_triaged(batch, root, order, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def claimed_once(discovered: DataFrame, time: str = "event_time", seconds: int = ETAG_MEMORY_SECONDS) -> DataFrame:
    """Each etag once within the memory span; the state is dropped after it."""
    return discovered.withWatermark(time, f"{seconds} seconds").dropDuplicatesWithinWatermark(["etag"])


class EtagClaims(StatefulProcessor):
    """An object is claimed for a short span, then confirmed for a long one or released.

    Rows are of kind found, confirmed or released.  A found row claims its etag
    unless a claim or a confirmation is in force.  State: until when, counted
    from the event's time; it lapses by itself after the longer span.
    """

    def __init__(self, claim_seconds: float = ETAG_CLAIM_SECONDS, memory_seconds: float = ETAG_MEMORY_SECONDS):
        self.claim, self.memory = pd.Timedelta(seconds=claim_seconds), pd.Timedelta(seconds=memory_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        life = int(max(self.claim, self.memory).total_seconds() * 1000)
        self.held = handle.getValueState("held", "until timestamp", life)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = until = pd.Timestamp(self.held.get()[0]) if self.held.exists() else None
        for frame in rows:
            frame = frame.sort_values("event_time", kind="stable")
            status = []
            for kind, at in zip(frame["kind"], frame["event_time"]):
                if kind == "confirmed":
                    until = at + self.memory
                elif kind == "released":
                    until = None
                elif until is None or at >= until:
                    until, kind = at + self.claim, "claimed"
                else:
                    kind = "known"
                status.append(kind)
            yield pd.DataFrame(
                {"etag": key[0], "object": frame["object"].to_numpy(), "event_time": frame["event_time"].to_numpy(), "status": status}
            )
        if until is None:
            self.held.clear()
        elif until != before:
            self.held.update((until.to_pydatetime(),))

    def close(self) -> None:
        pass


def etag_claims(events: DataFrame, claim_seconds: float = ETAG_CLAIM_SECONDS, memory_seconds: float = ETAG_MEMORY_SECONDS) -> DataFrame:
    """(etag, object, event_time, status): claimed, known, confirmed or released, for a stream with ``kind``."""
    slim = events.select("etag", "object", "event_time", "kind")
    return slim.groupBy("etag").transformWithStateInPandas(
        statefulProcessor=EtagClaims(claim_seconds, memory_seconds), outputMode="append", timeMode="processingTime",
        outputStructType="etag string, object string, event_time timestamp, status string",
    )


def write_discovered(events: DataFrame, root: str, order: str = "key", number: int = 0) -> None:
    """Keep objects whose etag is not stored yet and remember their etags.

    The objects are written first: a batch that broke off between the two
    writes finds them new again and, with its ``number``, replaces them.
    """
    known = read_or_none(events.sparkSession, f"{root}/etags")
    none = events.select("etag").limit(0)
    fresh = claim_etags(new_etags(events, none, none if known is None else known), order).persist()
    try:
        append(fresh, f"{root}/new_objects", batch=number)
        insert_ignore(fresh.select("etag"), f"{root}/etags", ["etag"])
    finally:
        fresh.unpersist()


def start_discovery(events: DataFrame, root: str, checkpoint: str, **trigger):
    """Small batches: read at most 500 messages or wait a second (set the first on the source)."""
    return (
        events.writeStream.foreachBatch(lambda batch, number: write_discovered(batch, root, number=number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def forward(source: DataFrame, sink: str, options: dict, checkpoint: str, **trigger):
    """Copy messages from one log to another, each once per checkpoint."""
    return (
        source.select(*[F.col(c) for c in source.columns if c in ("key", "value", "topic", "headers")])
        .writeStream.format(sink).options(**options)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )
