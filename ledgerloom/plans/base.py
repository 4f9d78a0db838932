"""Registered queries.

A query reads the given tables, shapes them into the records an operator
takes (``inputs`` text, plain SQL that both engines run), applies the operator
and names its output.  The oracle text computes the same result from the same
input records in its own way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Input text whose ``{table}`` marks stand for the tables."""
        return self.spark.sql(text.format(**{t: f"parquet.`{self.folder}/{t}.parquet`" for t in TABLES}))


def for_oracle(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def query(name: str, oracle: str | None = None, **inputs: str):
    """Register a function of a ``Source``; ``inputs`` become ``WITH`` tables of the oracle.

    The function receives the inputs as DataFrames by name.
    """

    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            source = Source(spark, folder)
            return build(source, **{k: source.sql(text) for k, text in inputs.items()})

        run.__name__, run.__doc__ = name, build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            shared = ", ".join(f"{k} AS ({for_oracle(text)})" for k, text in inputs.items())
            body = oracle.strip()
            if not shared:
                ORACLES[name] = body
            elif body[:15].upper() == "WITH RECURSIVE ":
                ORACLES[name] = f"WITH RECURSIVE {shared}, {body[15:]}"
            elif body[:5].upper() == "WITH ":
                ORACLES[name] = f"WITH {shared}, {body[5:]}"
            else:
                ORACLES[name] = f"WITH {shared} {body}"
        return build

    return register


def money(cents: str) -> str:
    """SQL text of a bigint number of cents as ``1234.56``."""
    return f"(CAST(CAST(floor(abs({cents}) / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(abs({cents}) % 100 AS STRING), 2, '0'))"


def grouped(cents: str) -> str:
    """SQL text of cents below a thousand million as ``1,234.56``."""
    units = f"CAST(floor(abs({cents}) / 100) AS BIGINT)"
    head = f"CAST(CAST(floor({units} / 1000) AS BIGINT) AS STRING)"
    body = f"(CASE WHEN {units} >= 1000 THEN {head} || ',' || lpad(CAST({units} % 1000 AS STRING), 3, '0') ELSE CAST({units} AS STRING) END)"
    return f"({body} || '.' || lpad(CAST(abs({cents}) % 100 AS STRING), 2, '0'))"
