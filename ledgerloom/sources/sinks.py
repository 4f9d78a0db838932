"""Sinks: upserts on plain files, insert-ignore, fan-out, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .keyed import KeyedTable

BATCH = "batch_id"


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key: a maximum with partial aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None only if nothing is stored there.  Any other trouble is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or one without a data file
            return None
        raise


def upsert(
    updates: DataFrame, path: str, keys: list[str], order: list[str], keep: list[str] | None = None,
    batch: int | None = None, writer: str = "main",
) -> bool:
    """Add a batch to the keyed table at ``path``; nothing stored is read or rewritten.

    With a stream's ``batch`` number a replay writes nothing (False).
    """
    return KeyedTable(updates.sparkSession, path, keys, order, keep).upsert(updates, batch, writer)


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an upserted table without deletion markers."""
    return KeyedTable(spark, path).live()


def upsert_rows(rows: DataFrame, path: str, order: list[str], batch: int | None = None) -> bool:
    """Stored rows by (document, node, row index); every other column is replaced."""
    return upsert(rows, path, ["document_id", "node_id", "row_index"], order, batch=batch)


def update_by_id(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Update rows by id; user, page and box only when given."""
    given = ["user_id", "source_page", "source_bbox"]
    fields = [c for c in updates.columns if c != "id"]
    joined = current.join(updates.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in fields]), "id", "left")
    new = {
        c: F.coalesce(f"_n_{c}", c) if c in given else F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c))
        for c in fields
    }
    return joined.withColumns(new).drop("_hit", *[f"_n_{c}" for c in fields])


def append(rows: DataFrame, path: str, partition: list[str] | None = None, batch: int | None = None) -> None:
    """Add rows.  With a stream's ``batch`` number they form that batch's partition, which a replay replaces."""
    if batch is None:
        writer = rows.write.mode("append")
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
        return
    numbered = rows.withColumn(BATCH, F.lit(batch).cast("long"))
    writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BATCH, *(partition or [])).parquet(path)


def insert_ignore(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key is not stored yet; one row per new key."""
    current = read_or_none(rows.sparkSession, path)
    fresh = rows.dropDuplicates(keys)
    if current is not None:
        fresh = fresh.join(current.select(*keys), keys, "left_anti")
    append(fresh, path)


def fan_out(rows: DataFrame, path: str, route: str = "route", batch: int | None = None) -> None:
    """One folder per route (pass, review, fail)."""
    append(rows, path, [route], batch)


def export_goldens(goldens: DataFrame, path: str) -> None:
    """Golden documents as JSON, one folder per table."""
    goldens.write.mode("append").partitionBy("target_table").json(path)


def upsert_vectors(points: DataFrame, path: str, order: list[str], batch: int | None = None) -> bool:
    """Vector points by id; ``deleted`` points are no longer read."""
    return upsert(points, path, ["id"], order, batch=batch)


def upsert_edges(edges: DataFrame, path: str, order: list[str], batch: int | None = None) -> bool:
    return upsert(edges, path, ["tenant_id", "subject", "predicate", "object"], order, batch=batch)


def upsert_jobs(states: DataFrame, path: str, order: list[str], batch: int | None = None) -> bool:
    """Job states by document; file name, uri and hash keep their last known value."""
    named = states.withColumn("filename", F.when(F.col("filename") != "unknown", F.col("filename")))
    return upsert(named, path, ["document_id"], order, ["filename", "s3_uri", "file_hash"], batch)
