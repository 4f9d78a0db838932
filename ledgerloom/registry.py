"""Schema registry: table name -> column -> type name.

The registry is configuration.  ``load_registry`` reads one from JSON (any
number of schemas); ``default_registry`` holds the schemas the built-in rules
know.  It becomes Spark types here and nowhere else.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_labels import ALIASES, CORE_SCHEMAS
from .fixed_values import CONTEXT_COLUMNS, VIEW_SYNONYMS

Registry = dict[str, dict[str, str]]

SPARK_TYPES = {
    "str": T.StringType(),
    "float": T.DoubleType(),
    "int": T.LongType(),
    "datetime": T.TimestampType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "dict": T.StringType(),
}


def default_registry() -> Registry:
    return {table: dict(columns) for table, columns in CORE_SCHEMAS.items()}


def load_registry(spark: SparkSession, path: str) -> Registry:
    """Read ``{table: {column: type}}`` from one JSON file on any file system."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {
        table: {c: t.lower() for c, t in columns.items() if isinstance(t, str)}
        for table, columns in json.loads(text).items()
        if isinstance(columns, dict)
    }


def load_aliases(spark: SparkSession, path: str) -> dict[str, str]:
    """Read ``{label: column}``; labels are matched trimmed and in lower case."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {str(k).strip().lower(): str(v) for k, v in json.loads(text).items()}


def default_aliases() -> dict[str, str]:
    return dict(ALIASES)


def apply_schema_changes(registry: Registry, changes: DataFrame) -> Registry:
    """Registry after a CDC batch with columns (op, target_table, columns, seq).

    ``columns`` is ``map<string,string>``.  One row per table is kept (the
    newest create or update), so what reaches the driver is one entry per
    changed schema.
    """
    newest = (
        changes.where(F.col("op").isin("c", "u") & F.col("target_table").isNotNull())
        .groupBy("target_table")
        .agg(F.max_by("columns", "seq").alias("columns"))
    )
    updated = dict(registry)
    for row in newest.toLocalIterator():
        updated[row["target_table"]] = {c: t.lower() for c, t in (row["columns"] or {}).items()}
    return updated


def enriched(columns: dict[str, str], vertical: bool = False) -> dict[str, str]:
    """Context columns (and the period of a vertical table) before the rest."""
    head = {"period_name": "str"} if vertical else {}
    return {**head, **{c: "str" for c in CONTEXT_COLUMNS}, **columns}


def struct_type(columns: dict[str, str], vertical: bool = False) -> T.StructType:
    return T.StructType(
        [T.StructField(c, SPARK_TYPES.get(t, T.StringType())) for c, t in enriched(columns, vertical).items()]
    )


def view_name(table: str) -> str:
    return table if table.startswith("view_") else f"view_{table}"


def lookup_keys(column: str) -> list[str]:
    """Keys of the two bags under which a view finds a column's value.

    The order is fixed (synonym by synonym: as is, with spaces, title case,
    lower case), so the choice between several present keys is stable.
    """
    names = VIEW_SYNONYMS.get(column, [column])
    if column not in names:
        names = [column, *names]
    keys: list[str] = []
    for name in names:
        spaced = name.replace("_", " ")
        for key in (name, spaced, spaced.title(), name.lower()):
            if key not in keys:
                keys.append(key)
    return keys


def catalog(spark: SparkSession, registry: Registry) -> DataFrame:
    """(view, column, type, role): what can be selected, grouped and measured."""
    rows = []
    for table in sorted(registry):
        view = view_name(table)
        for column, kind in enriched(registry[table]).items():
            rows.append((view, column, kind, "dimension"))
            if kind in ("int", "float"):
                rows.append((view, f"total_{column}", "sum", "measure"))
                rows.append((view, f"avg_{column}", "avg", "measure"))
        rows.append((view, "count", "count", "measure"))
    return spark.createDataFrame(rows, "view string, column string, type string, role string")
