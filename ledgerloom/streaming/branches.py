"""One stream of nodes, several outputs: early tables, diverted tables, nodes that wait for their document.

A table whose document is still incomplete is passed on at once.  A table that
a reviewer diverted goes to the text chunks instead.  All nodes, but for the
diverted, are staged for assembly; those passed on are marked there, so the
assembled document does not send them a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import append
from .changes import write_chunks


def branch(kind: Column, divert: Column, complete: Column) -> Column:
    """divert, early or staged: exactly one for every node."""
    early = kind.isin("TABLE", "KEY_VALUE") & ~F.coalesce(complete, F.lit(False))
    return F.when(F.coalesce(divert, F.lit(False)), "divert").when(F.coalesce(early, F.lit(False)), "early").otherwise("staged")


def branched(nodes: DataFrame) -> DataFrame:
    """Nodes with their ``branch``; reads type, divert_to_rag and complete (the document's last chunk is here)."""
    return nodes.withColumn("branch", branch(F.col("type"), F.col("divert_to_rag"), F.col("complete")))


def diverted_chunks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Diverted tables as created text: the section's text and the table's markdown."""
    text = F.concat_ws("\n", F.nullif("parent_section_text", F.lit("")), F.nullif("content", F.lit("")))
    state = F.struct(
        "tenant_id", "document_id", "node_id", text.alias("content"), "source_page", "source_bbox",
    )
    return rows.where("branch = 'divert'").select(F.lit("c").alias("op"), F.lit(None).cast(rows.select(state.alias("s")).schema["s"].dataType).alias("before"), state.alias("after"), *order)


def write_branches(nodes: DataFrame, root: str, order: list[str], number: int) -> None:
    """One batch of nodes, split once.  With its ``number`` a replay replaces what it wrote.

    ``raw_tables``: early tables; ``chunks``: keyed table of text chunks;
    ``resolved``: documents whose review ends with the divert; ``staged``: all
    others, with ``sent_early`` for those that have gone ahead.
    """
    rows = branched(nodes).persist()
    try:
        append(rows.where("branch = 'early'").drop("branch", "divert_to_rag", "complete"), f"{root}/raw_tables", batch=number)
        staged = rows.where("branch <> 'divert'").withColumn("sent_early", F.col("branch") == "early")
        append(staged.drop("branch", "divert_to_rag", "complete"), f"{root}/staged", batch=number)
        diverted = rows.where("branch = 'divert'")
        append(diverted.select("tenant_id", "document_id", "node_id", F.lit("RESOLVED").alias("status")), f"{root}/resolved", batch=number)
        write_chunks(diverted_chunks(diverted, order), f"{root}/chunks", order, number)
    finally:
        rows.unpersist()


def start_branches(nodes: DataFrame, root: str, checkpoint: str, order: list[str], **trigger):
    return (
        nodes.writeStream.foreachBatch(lambda batch, number: write_branches(batch, root, order, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )
