"""Sources: one factory for batch and stream, and decoders per record kind.

A stream source is a dict: ``{"format": "kafka", "options": {...}}`` on a
cluster, ``{"format": "json" | "parquet" | "text", "path": ..., "schema":
...}`` elsewhere.  Decoders take a frame with a string or binary ``value``
column (and ``key`` where there is one) and return typed columns; records that
do not decode go to ``rejects``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DISCOVERY_BATCH
from ..functions.hof import presence
from ..functions.ids import resolve_tenant

INGEST_EVENT = "event_id string, tenant_id string, s3_uri string, file_hash_sha256 string, timestamp string, metadata map<string,string>"
RAW_TABLE = (
    "document_id string, tenant_id string, node_id string, target_table string, extracted_data map<string,array<string>>, "
    "markdown_content string, parent_section_text string, source_page int, source_bbox array<float>, user_id string, row_id bigint"
)
ALIGNED = (
    "document_id string, tenant_id string, node_id string, target_table string, mapping_status string, timestamp string, "
    "strict_columns array<map<string,string>>, unmapped_jsonb array<map<string,string>>, user_id string, source_page int, source_bbox array<float>, row_id bigint"
)
STATUS_EVENT = (
    "document_id string, tenant_id string, filename string, current_stage string, status string, error_message string, s3_uri string, file_hash string, "
    "sql_mapped boolean, vector_mapped boolean, graph_mapped boolean, sql_nodes_total int, graph_nodes_total int, sql_node_completed boolean, "
    "graph_node_completed boolean, company_name string, ticker string, fiscal_period string, updated_at string"
)
DISCOVERY_EVENT = "tenant_id string, bucket string, key string, etag string"
ROW_STATE = "id bigint, tenant_id string, document_id string, node_id string, content string, source_page int, source_bbox array<float>, target_table string"
SYNONYM_STATE = "id string, tenant_id string, target_table string, raw_label string, mapped_column string, updated_at string"
SCHEMA_STATE = "target_table string, columns map<string,string>"
GOLDEN = (
    "document_id string, target_table string, predicted_table string, extracted_row map<string,string>, extracted_rows array<map<string,string>>, "
    "cells array<struct<row_index:int,column:string,value:string,tolerance:double>>, relations array<struct<type:string,left:string,right:string>>, "
    "_expect_critic_fail boolean, _expect_soft_fail boolean"
)


def stream(spark: SparkSession, source: dict) -> DataFrame:
    reader = spark.readStream.format(source["format"])
    if "schema" in source:
        reader = reader.schema(source["schema"])
    reader = reader.options(**source.get("options", {}))
    return reader.load(source["path"]) if "path" in source else reader.load()


#: Per format the options that bound a micro-batch, and whether they count messages.
ADMISSION = {
    "kafka": {"maxOffsetsPerTrigger": True},
    "rate": {"rowsPerSecond": True},
    "rate-micro-batch": {"rowsPerBatch": True},
    "json": {"maxFilesPerTrigger": False, "maxBytesPerTrigger": False},
    "csv": {"maxFilesPerTrigger": False, "maxBytesPerTrigger": False},
    "text": {"maxFilesPerTrigger": False, "maxBytesPerTrigger": False},
    "parquet": {"maxFilesPerTrigger": False, "maxBytesPerTrigger": False},
    "orc": {"maxFilesPerTrigger": False, "maxBytesPerTrigger": False},
    "avro": {"maxFilesPerTrigger": False, "maxBytesPerTrigger": False},
}


def bounded_stream(spark: SparkSession, source: dict, messages: int = DISCOVERY_BATCH, messages_per_file: int = 1) -> DataFrame:
    """A stream whose micro-batches are bounded.

    A bound that the source states itself stays.  Otherwise a log admits
    ``messages``, and a folder as many files as hold that many at
    ``messages_per_file``.  A format without a bound is refused.
    """
    kind = source["format"]
    if kind not in ADMISSION:
        raise ValueError(f"no bound is known for streams of format {kind}")
    options = dict(source.get("options", {}))
    if not any(o in options for o in ADMISSION[kind]):
        name, counts = next(iter(ADMISSION[kind].items()))
        options[name] = str(messages if counts else max(1, messages // messages_per_file))
    return stream(spark, {**source, "options": options})


def read(spark: SparkSession, source: dict) -> DataFrame:
    reader = spark.read.format(source["format"])
    if "schema" in source:
        reader = reader.schema(source["schema"])
    reader = reader.options(**source.get("options", {}))
    return reader.load(source["path"]) if "path" in source else reader.load()


def decoded(df: DataFrame, schema: str, proto: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``record``: the protobuf form of ``value`` where it decodes, else JSON.

    ``proto`` is (message name, descriptor file); without it only JSON is
    read.  Protobuf decoding needs the spark-protobuf jar on the cluster.
    """
    as_json = F.from_json(F.col("value").cast("string"), schema)
    if proto is None:
        return df.withColumn("record", as_json)
    from pyspark.sql.protobuf.functions import from_protobuf

    message, descriptor = proto
    typed = from_protobuf("value", message, descriptor, {"mode": "PERMISSIVE"})
    return df.withColumn("record", F.coalesce(typed.cast(f"struct<{schema}>"), as_json))


def is_json_object(value: Column) -> Column:
    return F.try_parse_json(value.cast("string")).isNotNull() & value.cast("string").rlike(r"(?U)^\s*\{")


def typed(df: DataFrame, required: list[str]) -> DataFrame:
    """Decoded records that hold every required field."""
    ok = F.col("record").isNotNull()
    for name in required:
        ok = ok & presence(F.col(f"record.{name}").cast("string")).isNotNull()
    extra = [c for c in df.columns if c not in ("record", "value")]
    return df.where(ok).select(*[F.col(c).alias(f"_{c}") for c in extra], "record.*")


def rejects(df: DataFrame, required: list[str]) -> DataFrame:
    """The raw values of all other records, for a dead-letter table."""
    bad = F.col("record").isNull()
    for name in required:
        bad = bad | presence(F.col(f"record.{name}").cast("string")).isNull()
    return df.where(bad).drop("record")


def ingest_events(df: DataFrame, proto: tuple[str, str] | None = None) -> DataFrame:
    events = typed(decoded(df, INGEST_EVENT, proto), ["event_id"])
    return events.withColumn("event_time", F.try_to_timestamp("timestamp"))


def document_trees(df: DataFrame, message: str, descriptor: str, depth: int = 5) -> DataFrame:
    """Protobuf document trees with nested nodes down to ``depth``."""
    from pyspark.sql.protobuf.functions import from_protobuf

    options = {"recursive.fields.max.depth": str(depth), "mode": "PERMISSIVE"}
    return df.withColumn("record", from_protobuf("value", message, descriptor, options)).select("record.*")


def raw_tables(df: DataFrame) -> DataFrame:
    return typed(decoded(df, RAW_TABLE), ["document_id"])


def aligned_payloads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, rejects); document, node and table are required."""
    required = ["document_id", "node_id", "target_table"]
    known = decoded(df, ALIGNED)
    return typed(known, required), rejects(known, required)


def payload_rows(payloads: DataFrame) -> DataFrame:
    """One stored row per row of a payload; the position is the row index."""
    pairs = F.arrays_zip(F.col("strict_columns").alias("strict"), F.col("unmapped_jsonb").alias("unmapped"))
    out = payloads.select(
        "tenant_id", "user_id", "document_id", "node_id", "target_table", "mapping_status", "source_page", "source_bbox",
        F.posexplode(pairs).alias("row_index", "_r"),
    )
    empty = F.create_map().cast("map<string,string>")
    return out.select("*", F.coalesce("_r.strict", empty).alias("strict"), F.coalesce("_r.unmapped", empty).alias("unmapped")).drop("_r")


def status_events(df: DataFrame) -> DataFrame:
    """Status records with the tenant resolved from payload and key."""
    key = F.col("key").cast("string") if "key" in df.columns else F.lit(None).cast("string")
    known = typed(decoded(df.withColumn("_k", key), STATUS_EVENT), ["document_id"])
    return known.withColumn("tenant_id", resolve_tenant(F.col("tenant_id"), F.col("document_id"), F.col("__k"))).drop("__k")


def cdc(df: DataFrame, state: str) -> DataFrame:
    """(op, before, after) of change envelopes."""
    envelope = f"payload struct<op:string,before:struct<{_struct(state)}>,after:struct<{_struct(state)}>>"
    known = decoded(df, envelope).where("record.payload.op IS NOT NULL")
    extra = [c for c in df.columns if c not in ("value",)]
    return known.select(*extra, "record.payload.*")


def _struct(ddl: str) -> str:
    """``a int, b string`` as ``a:int,b:string``."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def discovered(df: DataFrame) -> DataFrame:
    return typed(decoded(df, DISCOVERY_EVENT), ["etag"])


# --- files -------------------------------------------------------------------


def format_route(uri: Column) -> Column:
    """How a file is read, by its extension; unknown ones as a laid-out page file."""
    ext = F.lower(F.regexp_extract(uri, r"(\.[a-zA-Z0-9]+)(?:[?#].*)?$", 1))
    return (
        F.when(ext.isin(".xlsx", ".xls", ".csv"), "SPREADSHEET")
        .when(ext.isin(".png", ".jpg", ".jpeg"), "IMAGE")
        .when(ext.isin(".txt", ".md", ".html"), "TEXT")
        .when(ext.isin(".docx", ".doc", ".pptx", ".ppt"), "CONVERT")
        .otherwise("PDF_LAYOUT")
    )


def dispatch_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, route) of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", format_route(F.col("path")).alias("route"))


def text_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One TEXT node per text file, whole; its box is unknown."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("document_id"), F.lit("node_p1_1").alias("node_id"), F.lit("TEXT").alias("type"),
        F.col("value").alias("content"), F.lit(1).alias("page"), F.array(*[F.lit(0.0).cast("float")] * 4).alias("bbox"),
    )


def spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """A csv file; all cells as text."""
    return spark.read.csv(path, header=True)


def goldens(spark: SparkSession, path: str) -> DataFrame:
    """Golden documents (JSON, any depth); a single row becomes a list of one."""
    raw = spark.read.schema(GOLDEN).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    one = F.when(F.col("extracted_row").isNotNull(), F.array("extracted_row")).otherwise(F.array().cast("array<map<string,string>>"))
    rows = F.when(F.size("extracted_rows") > 0, F.col("extracted_rows")).otherwise(one)
    return raw.select(
        "document_id", "target_table", F.coalesce("predicted_table", "target_table").alias("predicted_table"),
        rows.alias("extracted_rows"), "cells", "relations",
        F.coalesce("_expect_critic_fail", F.lit(False)).alias("expect_fail"), F.coalesce("_expect_soft_fail", F.lit(False)).alias("expect_soft"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
