"""Job state and status feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import fold_jobs
from ..sources.sinks import upsert


def job_states(events: DataFrame, order: list[str]) -> DataFrame:
    """Current job states of a status stream.

    The same aggregate as for a table; Spark keeps it as streaming state, in
    update mode one row per changed document.
    """
    return fold_jobs(events, order)


def start_job_table(events: DataFrame, order: list[str], path: str, checkpoint: str, **trigger):
    """Keep a job table up to date; repeated batches change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, path, ["document_id"], ["updated_at"], batch=number)

    return (
        job_states(events, order).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def tenant_feed(events: DataFrame, tenant: str) -> DataFrame:
    """Status changes of one tenant."""
    return events.where(F.col("tenant_id") == tenant)
