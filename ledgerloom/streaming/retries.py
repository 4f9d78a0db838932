"""Bounded retries, then review; reviews that nobody answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..fixed_values import MAX_RETRIES, RETRY_TTL_SECONDS, REVIEW_TIMEOUT_SECONDS
from ..functions.hof import presence
from ..functions.ids import name_uuid
from ..functions.text import is_permanent_dead_letter
from ..sources.sinks import append

ROUTED = "document_id string, event_time timestamp, attempt int, route string"
REVIEW_STATE = "document_id string, event_time timestamp, status string"


def relevant_failures(letters: DataFrame) -> DataFrame:
    """Dead letters that are verification failures, with ``permanent``.

    Reads critic_error, mapping_status, failure_class and exhausted.
    """
    failed = F.col("mapping_status").isin("FAILED_VERIFICATION", "FAILED")
    kept = letters.where(presence(F.col("critic_error")).isNotNull() | F.coalesce(failed, F.lit(False)))
    return kept.withColumn(
        "permanent",
        is_permanent_dead_letter(F.col("critic_error"), F.col("mapping_status"), F.col("failure_class"), F.col("exhausted")),
    )


def critic_error_of(unmapped):
    """Error text of a payload: of its first row's bag."""
    return F.coalesce(F.get(unmapped, F.lit(0))["critic_error"], F.lit(""))


class RetryBudget(StatefulProcessor):
    """At most ``limit`` retries per document; the count lapses after a quiet span.

    State: the count and the time of the last retry.  Permanent failures go
    to review at once and do not count.
    """

    def __init__(self, limit: int = MAX_RETRIES, ttl_seconds: int = RETRY_TTL_SECONDS):
        self.limit, self.ttl = limit, pd.Timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.budget = handle.getValueState("budget", "attempts int, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, last = 0, None
        if self.budget.exists():
            stored = self.budget.get()
            count, last = int(stored[0]), pd.Timestamp(stored[1])
        frame = pd.concat(list(rows)).sort_values("event_time", kind="stable")
        attempts, routes = [], []
        for at, permanent in zip(frame["event_time"], frame["permanent"]):
            if last is not None and at >= last + self.ttl:
                count, last = 0, None
            if bool(permanent) or count >= self.limit:
                routes.append("review")
            else:
                count, last = count + 1, at
                routes.append("retry")
            attempts.append(count)
        if last is not None:
            self.budget.update((count, last.to_pydatetime()))
        yield pd.DataFrame(
            {"document_id": key[0], "event_time": frame["event_time"].to_numpy(), "attempt": attempts, "route": routes}
        )

    def close(self) -> None:
        pass


def route_retries(failures: DataFrame, limit: int = MAX_RETRIES, ttl_seconds: int = RETRY_TTL_SECONDS) -> DataFrame:
    """(document_id, event_time, attempt, route) for a stream of failures (document_id, event_time, permanent)."""
    slim = failures.select("document_id", "event_time", "permanent")
    return slim.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=RetryBudget(limit, ttl_seconds), outputStructType=ROUTED, outputMode="append", timeMode="none"
    )


LOOP = "document_id string, event_time timestamp, kind string, attempt int, error string, payload string"


def retry_letters(letters: DataFrame) -> DataFrame:
    """What the retry loop takes: (document_id, event_time, permanent, error, payload) of relevant dead letters.

    ``payload`` is the raw-table message that tries the rows again: the cells
    as extracted, the error and what was extracted before.
    """
    have = set(letters.columns)

    def given(name: str, kind: str = "string"):
        return F.col(name) if name in have else F.lit(None).cast(kind)

    error = F.coalesce(presence(given("critic_error")), critic_error_of(F.col("unmapped_jsonb")) if "unmapped_jsonb" in have else F.lit(""))
    extracted = given("extracted_data", "map<string,string>")
    payload = F.struct(
        "document_id", given("tenant_id").alias("tenant_id"), given("node_id").alias("node_id"), F.coalesce(given("user_id"), F.lit("")).alias("user_id"),
        F.coalesce(given("source_page", "int"), F.lit(1)).alias("source_page"), given("source_bbox", "array<float>").alias("source_bbox"),
        given("target_table").alias("target_table"), given("target_table").alias("target_schema"), extracted.alias("extracted_data"),
        F.coalesce(given("markdown_content"), F.lit("")).alias("markdown_content"),
        F.coalesce(given("parent_section_text"), F.lit("")).alias("parent_section_text"), error.alias("reflexion_error"),
        F.coalesce(F.to_json(given("strict_columns", "array<map<string,string>>")), F.to_json(extracted)).alias("previous_extraction"),
        given("row_id", "bigint").alias("row_id"),
    )
    named = letters.withColumns({"critic_error": error, "exhausted": given("exhausted", "boolean"), "failure_class": given("failure_class")})
    return relevant_failures(named).select(
        "document_id", "event_time", "permanent", F.col("critic_error").alias("error"), F.to_json(payload).alias("payload")
    )


class RetryLoop(StatefulProcessor):
    """Bounded retries that hold the payload until it is due.

    A failure within the budget gives a ``log`` row at once and, after
    ``delay_seconds``, a ``retry`` row with its payload (at once without a
    delay).  Permanent failures and those beyond the budget give a ``review``
    row.  State: count and time of the last retry, and the waiting payloads by
    attempt; both lapse with the time to live, which is counted anew from every
    retry.
    """

    def __init__(self, limit: int = MAX_RETRIES, ttl_seconds: float = RETRY_TTL_SECONDS, delay_seconds: float = 0):
        if delay_seconds >= ttl_seconds:
            raise ValueError("a payload must be due before its state lapses")
        self.limit, self.ttl, self.delay_ms = limit, pd.Timedelta(seconds=ttl_seconds), int(delay_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        life = int(self.ttl.total_seconds() * 1000)
        self.budget = handle.getValueState("budget", "attempts int, last timestamp", life)
        self.waiting = handle.getMapState("waiting", "number long", "due long, at timestamp, attempt int, error string, payload string", life)

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["event_time", "kind", "attempt", "error", "payload"])
        frame.insert(0, "document_id", key[0])
        return frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, last = 0, None
        if self.budget.exists():
            stored = self.budget.get()
            count, last = int(stored[0]), pd.Timestamp(stored[1])
        for frame in rows:  # one Arrow batch after the other: a document's rows are never all in memory
            out = []
            for r in frame.sort_values("event_time", kind="stable").itertuples():
                if last is not None and r.event_time >= last + self.ttl:
                    count, last = 0, None
                if bool(r.permanent) or count >= self.limit:
                    out.append((r.event_time, "review", count, r.error, r.payload))
                    continue
                count, last = count + 1, r.event_time
                out.append((r.event_time, "log", count, r.error, r.payload))
                if not self.delay_ms:
                    out.append((r.event_time, "retry", count, r.error, r.payload))
                    continue
                due = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
                # of one document at most ``limit`` payloads wait within a time to live
                number = int(r.event_time.value) * (self.limit + 1) + count
                self.waiting.updateValue((number,), (due, r.event_time.to_pydatetime(), count, r.error, r.payload))
                self.handle.registerTimer(due)
            if out:
                yield self._rows(key, out)
        if last is not None:
            self.budget.update((count, last.to_pydatetime()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [(number, value) for number, value in self.waiting.iterator() if value[0] <= now]
        for number, _ in due:
            self.waiting.removeKey(number)
        if due:
            rows = sorted((pd.Timestamp(at), "retry", int(attempt), error, payload) for _, (_, at, attempt, error, payload) in due)
            yield self._rows(key, rows)

    def close(self) -> None:
        pass


def retry_loop(letters: DataFrame, limit: int = MAX_RETRIES, ttl_seconds: float = RETRY_TTL_SECONDS, delay_seconds: float = 0) -> DataFrame:
    """Rows of kind log, retry and review for a stream of ``retry_letters``."""
    slim = letters.select("document_id", "event_time", "permanent", "error", "payload")
    return slim.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=RetryLoop(limit, ttl_seconds, delay_seconds), outputStructType=LOOP,
        outputMode="append", timeMode="processingTime",
    )


def retry_messages(rows: DataFrame) -> DataFrame:
    """(key, value) to send: the payload with the number of the attempt."""
    attempt = F.concat(F.lit(',"reflexion_attempt":'), F.col("attempt").cast("string"), F.lit("}"))
    return rows.where("kind = 'retry'").select(
        F.col("document_id").alias("key"), F.concat(F.expr("substr(payload, 1, length(payload) - 1)"), attempt).alias("value")
    )


def retry_log(rows: DataFrame, agent: str = "retry") -> DataFrame:
    """One log row per attempt; its id depends on document, attempt and time alone."""
    return rows.where("kind = 'log'").select(
        name_uuid(F.col("document_id"), F.concat_ws("|", F.col("attempt").cast("string"), F.col("event_time").cast("string"))).alias("task_id"),
        F.get_json_object("payload", "$.tenant_id").alias("tenant_id"), "document_id", F.lit(agent).alias("agent_name"),
        F.coalesce(presence(F.col("error")), F.lit("verification failed")).alias("error"), "payload", "attempt", "event_time",
    )


def write_retries(rows: DataFrame, root: str, number: int) -> None:
    """One batch of the loop: messages, log rows and reviews; a replay replaces all three."""
    batch = rows.persist()
    try:
        append(retry_log(batch), f"{root}/retry_log", batch=number)
        append(batch.where("kind = 'review'").drop("kind"), f"{root}/reviews", batch=number)
        append(retry_messages(batch), f"{root}/retries", batch=number)
    finally:
        batch.unpersist()


def start_retry_loop(letters: DataFrame, root: str, checkpoint: str, limit: int = MAX_RETRIES,
                     ttl_seconds: float = RETRY_TTL_SECONDS, delay_seconds: float = 0, **trigger):
    return (
        retry_loop(letters, limit, ttl_seconds, delay_seconds)
        .writeStream.foreachBatch(lambda batch, number: write_retries(batch, root, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


class ReviewClock(StatefulProcessor):
    """A review that is not resolved in time becomes a permanent failure.

    Rows carry ``kind``: opened or resolved.
    """

    def __init__(self, timeout_seconds: float = REVIEW_TIMEOUT_SECONDS):
        self.timeout_ms = int(timeout_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("event_time", kind="stable")
        status = []
        for at, kind in zip(frame["event_time"], frame["kind"]):
            if kind == "resolved":
                self.opened.clear()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                status.append("RESOLVED")
            else:
                if not self.opened.exists():
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
                self.opened.update((at.to_pydatetime(),))
                status.append("PENDING")
        yield pd.DataFrame({"document_id": key[0], "event_time": frame["event_time"].to_numpy(), "status": status})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists():
            at = self.opened.get()[0]
            self.opened.clear()
            yield pd.DataFrame({"document_id": [key[0]], "event_time": [pd.Timestamp(at)], "status": ["FAILED_PERMANENT"]})

    def close(self) -> None:
        pass


def review_timeouts(reviews: DataFrame, timeout_seconds: float = REVIEW_TIMEOUT_SECONDS) -> DataFrame:
    slim = reviews.select("document_id", "event_time", "kind")
    return slim.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=ReviewClock(timeout_seconds), outputStructType=REVIEW_STATE,
        outputMode="append", timeMode="processingTime",
    )


class FailureCount(StatefulProcessor):
    """Running number of failures per event; from the limit on they are dead letters."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = int(self.count.get()[0]) if self.count.exists() else 0
        frame = pd.concat(list(rows))
        numbers = list(range(n + 1, n + 1 + len(frame)))
        self.count.update((n + len(frame),))
        yield pd.DataFrame(
            {"event_id": key[0], "attempt": numbers, "route": ["dead_letter" if i >= self.limit else "retry" for i in numbers]}
        )

    def close(self) -> None:
        pass


def bounded_failures(failures: DataFrame, limit: int = MAX_RETRIES) -> DataFrame:
    return failures.select("event_id").groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=FailureCount(limit), outputStructType="event_id string, attempt int, route string",
        outputMode="append", timeMode="none",
    )
