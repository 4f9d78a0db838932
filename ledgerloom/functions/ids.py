"""Identifiers, hashes, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import UUID_OID_NAMESPACE_HEX
from .hof import presence


def name_uuid(*parts: Column) -> Column:
    """Name-based (version 5) UUID of the parts joined by ``/``.

    Pass the document and the node: a node id alone repeats across documents.
    """
    name = parts[0] if len(parts) == 1 else F.concat_ws("/", *parts)
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_OID_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def uri_parts(uri: Column) -> Column:
    """``struct<bucket, key, filename>`` of an object URI."""
    return F.struct(
        F.regexp_extract(uri, r"^[a-z0-9]+://([^/]+)/", 1).alias("bucket"),
        F.regexp_extract(uri, r"^[a-z0-9]+://[^/]+/(.*)$", 1).alias("key"),
        F.regexp_extract(uri, r"([^/]*)$", 1).alias("filename"),
    )


def resolve_tenant(payload_tenant: Column, document: Column, key: Column) -> Column:
    """Tenant of the payload, else the message key, never the document id."""
    usable = lambda c: F.when(~F.coalesce(c == document, F.lit(False)), presence(c))
    return F.coalesce(usable(payload_tenant), usable(key), F.lit("default-tenant"))


def stage_text(sql_done: Column, sql_total: Column, graph_done: Column, graph_total: Column) -> Column:
    return F.format_string("Ingesting (SQL: %d/%d, Graph: %d/%d)", sql_done, sql_total, graph_done, graph_total)


def citation_link(document: Column, page: Column, bbox: Column) -> Column:
    """``doc#page=N`` and the box when it is known."""
    box = F.slice(bbox, 1, 4)
    known = (F.size(box) == 4) & F.exists(box, lambda v: v != 0)
    return F.concat(
        document,
        F.format_string("#page=%d", page),
        F.coalesce(F.when(known, F.concat(F.lit("&bbox="), F.array_join(box.cast("array<string>"), ","))), F.lit("")),
    )


def node_id(page: Column, ordinal: Column) -> Column:
    return F.format_string("node_p%d_%d", page, ordinal)
