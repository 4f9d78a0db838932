"""Document job state as one aggregate over status events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hof import presence
from ..functions.ids import stage_text

KEPT_FIELDS = ("s3_uri", "file_hash", "company_name", "ticker", "fiscal_period")
FLAG_FIELDS = ("sql_mapped", "vector_mapped", "graph_mapped")


def fold_jobs(events: DataFrame, order: list[str]) -> DataFrame:
    """Current state per document.

    Each field of a job depends on its own last useful event only, and the
    counters are counts, so the whole fold is one ``groupBy`` of ``max_by``
    and counts.  It combines on the map side (a document with very many
    events is no hot spot) and is the same expression for a stream, where the
    state is these aggregates.

    Increments before the first status event count too.
    """
    at = F.struct(*order)
    step = F.coalesce("sql_node_completed", F.lit(False)) | F.coalesce("graph_node_completed", F.lit(False))
    last = lambda c, ok: F.max_by(F.col(c), F.when(ok, at))
    named = presence(F.col("filename")).isNotNull() & (F.col("filename") != "unknown") & ~step
    optional = [c for c in (*KEPT_FIELDS, *FLAG_FIELDS) if c in events.columns]
    folded = events.groupBy("document_id").agg(
        F.max_by("tenant_id", at).alias("tenant_id"),
        F.coalesce(last("filename", named), F.lit("unknown")).alias("filename"),
        F.max_by(step, at).alias("_step"),
        last("status", ~step).alias("_status"),
        last("current_stage", ~step).alias("_stage"),
        last("error_message", ~step).alias("error_message"),
        F.coalesce(last("sql_nodes_total", F.col("sql_nodes_total").isNotNull() & ~step), F.lit(0)).alias("sql_nodes_total"),
        F.coalesce(last("graph_nodes_total", F.col("graph_nodes_total").isNotNull() & ~step), F.lit(0)).alias("graph_nodes_total"),
        F.max_by(F.coalesce("sql_nodes_total", "graph_nodes_total", F.lit(0)), F.when(~step, at)).alias("_announced"),
        F.count_if(F.coalesce("sql_node_completed", F.lit(False))).alias("sql_nodes_completed"),
        F.count_if(F.coalesce("graph_node_completed", F.lit(False))).alias("graph_nodes_completed"),
        *[last(c, F.col(c).isNotNull() & ~step).alias(c) for c in optional],
        F.max(at).alias("_last"),
    )
    sql_t, graph_t = F.col("sql_nodes_total"), F.col("graph_nodes_total")
    sql_c, graph_c = F.col("sql_nodes_completed"), F.col("graph_nodes_completed")
    complete = (sql_c >= sql_t) & (graph_c >= graph_t) & ((sql_t > 0) | (graph_t > 0))
    progress = stage_text(sql_c, sql_t, graph_c, graph_t)
    status = F.when(F.col("_step"), F.when(complete, "COMPLETED").otherwise("IN_PROGRESS")).otherwise(F.coalesce("_status", F.lit("UNKNOWN")))
    announced = (F.col("_status") == "IN_PROGRESS") & (F.col("_announced") > 0)
    stage = (
        F.when(F.col("_step") & complete, "Completed")
        .when(F.col("_step"), progress)
        .when(announced, stage_text(F.lit(0), sql_t, F.lit(0), graph_t))
        .otherwise(F.coalesce("_stage", F.lit("unknown")))
    )
    state = folded.withColumns({"status": status, "current_stage": stage})
    return state.select(
        "document_id", "tenant_id", "filename", "status", "current_stage", "error_message",
        "sql_nodes_total", "sql_nodes_completed", "graph_nodes_total", "graph_nodes_completed", *optional,
        F.col(f"_last.{order[0]}").alias("updated_at"),
    )


def completion_status(nodes: DataFrame) -> DataFrame:
    """Per document: node counts, flags and the status its routing ends with.

    Rows: document_id and the routes of a node (``array<string>`` of sql,
    vector, graph).
    """
    has = lambda r: F.array_contains("routes", r)
    rolled = nodes.groupBy("document_id").agg(
        F.bool_or(has("sql")).alias("sql_mapped"), F.bool_or(has("vector")).alias("vector_mapped"),
        F.bool_or(has("graph")).alias("graph_mapped"),
        F.count_if(has("sql")).alias("sql_nodes_total"), F.count_if(has("graph")).alias("graph_nodes_total"),
    )
    mapped = F.col("sql_mapped") | F.col("vector_mapped") | F.col("graph_mapped")
    return rolled.withColumn("status", F.when(mapped, "IN_PROGRESS").otherwise("COMPLETED"))


def route_failures(failures: DataFrame, keys: list[str], position: str, limit: int, width: int | None = None) -> DataFrame:
    """Numbers the failures of each event; from the ``limit``-th on they are dead letters."""
    from .segmented import DEFAULT_WIDTH, row_number

    numbered = row_number(failures, keys, position, out="attempt", start=1, width=width or DEFAULT_WIDTH)
    return numbered.withColumn("route", F.when(F.col("attempt") >= limit, "dead_letter").otherwise("retry"))
