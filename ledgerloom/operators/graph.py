"""Entities and relations as two tables; one-hop patterns as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import GRAPH_TEMPLATES
from ..functions.text import canonical_entity, canonical_predicate


def clean_triples(triples: DataFrame) -> DataFrame:
    """Canonical names; noise names and self-edges are dropped."""
    return triples.withColumns(
        {
            "subject": canonical_entity(F.col("subject")),
            "predicate": canonical_predicate(F.col("predicate")),
            "object": canonical_entity(F.col("object")),
        }
    ).where("subject <> object")  # false for a null on either side


def first_triples(blocks: DataFrame, column: str = "triples", limit: int | None = None) -> DataFrame:
    """The triples of each text block (``array<struct>``), exploded; the first ``limit`` of each if asked."""
    rest = [c for c in blocks.columns if c != column]
    return blocks.select(*rest, F.inline(column if limit is None else F.slice(column, 1, limit)))


def merge_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge per (tenant, subject, predicate, object); the newest provenance stays."""
    newest = F.max(F.struct(F.col(order), F.col("document_id"), F.col("source_page")))
    return edges.groupBy("tenant_id", "subject", "predicate", "object").agg(newest.alias("_p")).select(
        "tenant_id", "subject", "predicate", "object", "_p.document_id", "_p.source_page", f"_p.{order}"
    )


def entities(edges: DataFrame) -> DataFrame:
    """Distinct (tenant, name) of both ends."""
    ends = edges.select("tenant_id", F.explode(F.array("subject", "object")).alias("name"))
    return ends.distinct()


def one_hop(edges: DataFrame, template: str, tenant: str, name: str, limit: int | None = None) -> DataFrame:
    """(subject, predicate, object) around names containing ``name``.

    Templates match on the edge's type.  ``relationships`` reads edges in
    both directions.  ``limit`` asks for the first by name.
    """
    types, side, undirected = GRAPH_TEMPLATES[template]
    scoped = edges.where(F.col("tenant_id") == tenant).select("subject", "predicate", "object")
    if types is not None:
        scoped = scoped.where(F.col("predicate").isin(types))
    if undirected:
        ends = F.array(
            F.struct(F.col("subject"), F.col("predicate"), F.col("object")),
            F.struct(F.col("object").alias("subject"), F.col("predicate"), F.col("subject").alias("object")),
        )
        scoped = scoped.select(F.inline(ends))
    found = scoped.where(F.lower(side).contains(name.lower()))
    return found if limit is None else found.orderBy("subject", "predicate", "object").limit(limit)


def ontology(edges: DataFrame) -> DataFrame:
    """Edge types with the number of edges."""
    return edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"))


def correct_edges(edges: DataFrame, fixes: DataFrame) -> DataFrame:
    """Replace the predicate of matched (tenant, subject, predicate, object) edges."""
    keys = ["tenant_id", "subject", "predicate", "object"]
    joined = edges.join(fixes.select(*keys, "new_predicate"), keys, "left")
    return joined.withColumn("predicate", F.coalesce("new_predicate", "predicate")).drop("new_predicate")


def top_neighbours(edges: DataFrame, per_entity: int) -> DataFrame:
    """At most ``per_entity`` edges per subject, by name (a top-k report)."""
    w = Window.partitionBy("tenant_id", "subject").orderBy("predicate", "object")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_entity)
