"""Page layout: boxes, reading order, sections, context, page plans.

Nodes: document_id, node_id, parent_id, ord (dense from 0 among siblings or in
the document), type, content, page, bbox ``array<float>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    LINE_EPSILON,
    PAGE_FOOTER_Y,
    PAGE_HEADER_Y,
    PAGES_PER_CHUNK,
    TABLE_SPAN_BOTTOM,
    TABLE_SPAN_TOP,
)
from ..functions.hof import presence, strip
from ..functions.ids import node_id
from ..functions.text import graph_signal
from .segmented import DEFAULT_WIDTH, carry_last, neighbours, running_total

TEXT_KINDS = ("TEXT", "SECTION_HEADER", "TITLE", "CHECKBOX", "CODE")
HEADERS = ("SECTION_HEADER", "TITLE")


# --- boxes -------------------------------------------------------------------


def node_type(label: Column) -> Column:
    """Layout label to node type."""
    return (
        F.when(label == "table", "TABLE")
        .when(label.isin("picture", "figure"), "IMAGE")
        .when(label == "key_value_region", "KEY_VALUE")
        .when(label == "form", "FORM")
        .when(label == "section_header", "SECTION_HEADER")
        .when(label == "title", "TITLE")
        .when(label.contains("checkbox"), "CHECKBOX")
        .when(label == "code", "CODE")
        .otherwise("TEXT")
    )


def node_content(label: Column, text: Column) -> Column:
    """Text of a box; checkboxes carry their state, tables and images none."""
    checked = label.contains("selected") & ~label.contains("unselected")
    return F.when(label.isin("table", "picture", "figure"), None).when(
        label.contains("checkbox"), F.concat(F.when(checked, "[CHECKED] ").otherwise("[UNCHECKED] "), text)
    ).otherwise(text)


def scale_box(bbox: Column, page_width: Column, page_height: Column, image_width: Column, image_height: Column) -> Column:
    """Pixels to page units."""
    sx, sy = page_width / image_width, page_height / image_height
    return F.array(bbox[0] * sx, bbox[1] * sy, bbox[2] * sx, bbox[3] * sy)


def known_box(bbox: Column) -> Column:
    return F.coalesce((F.size(bbox) >= 4) & F.exists(bbox, lambda v: v != 0), F.lit(False))


def without_header_footer(nodes: DataFrame) -> DataFrame:
    """Drop nodes in the header or footer band; unknown (missing or zero) boxes stay."""
    outside = (F.get("bbox", F.lit(3)) < PAGE_HEADER_Y) | (F.get("bbox", F.lit(1)) > PAGE_FOOTER_Y)
    return nodes.where(~(known_box(F.col("bbox")) & F.coalesce(outside, F.lit(False))))


def outside_tables(boxes: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of a page that touch none of its table boxes (x0, y0, x1, y1)."""
    b, t = boxes.alias("b"), tables.select(*keys, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")]).alias("t")
    on = [F.col(f"b.{k}") == F.col(f"t.{k}") for k in keys]
    touch = (
        (F.col("b.x1") >= F.col("t.t_x0")) & (F.col("b.x0") <= F.col("t.t_x1"))
        & (F.col("b.y1") >= F.col("t.t_y0")) & (F.col("b.y0") <= F.col("t.t_y1"))
    )
    return b.join(t, [*on, touch], "left_anti")


def provenance(page: Column, bbox: Column, parent_page: Column) -> Column:
    """Own page and box, else the parent's page (at least 1) and a zero box."""
    own = F.nullif(page, F.lit(0))
    zero = F.array(*[F.lit(0.0).cast("float")] * 4)
    return F.struct(
        F.coalesce(own, F.when(parent_page > 0, parent_page), F.lit(1)).alias("page"),
        F.when(own.isNotNull() & bbox.isNotNull(), bbox).otherwise(zero).alias("bbox"),
    )


# --- order -------------------------------------------------------------------


def line_starts(boxes: DataFrame, keys: list[str], y: str = "y0", epsilon: float = LINE_EPSILON) -> DataFrame:
    """(keys, starts): the y at which each text line of a page begins.

    Boxes sorted by y join the current line while they are within ``epsilon``
    of its running mean.  Equal y values join together, so the boxes are
    counted per y before the page's values meet in one fold.
    """
    counted = boxes.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_n"))
    sorted_ys = F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col("_n").alias("n"))))
    empty = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("starts")
    )

    def step(acc: Column, box: Column) -> Column:
        near = (acc["n"] > 0) & (F.abs(box["y"] - acc["total"] / F.nullif(acc["n"], F.lit(0))) <= epsilon)
        near = F.coalesce(near, F.lit(False))
        return F.struct(
            (F.when(near, acc["total"]).otherwise(0.0) + box["y"] * box["n"]).alias("total"),
            (F.when(near, acc["n"]).otherwise(F.lit(0).cast("long")) + box["n"]).alias("n"),
            F.when(near, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(box["y"]))).alias("starts"),
        )

    folded = counted.groupBy(*keys).agg(sorted_ys.alias("_ys"))
    return folded.select(*keys, F.aggregate("_ys", empty, step, lambda acc: acc["starts"]).alias("starts"))


def reading_order(boxes: DataFrame, keys: list[str], x: str = "x0", y: str = "y0", tie: str = "box_id", epsilon: float = LINE_EPSILON) -> DataFrame:
    """Adds line (from 0) and reading_index (from 0): lines from the top, boxes from the left."""
    starts = line_starts(boxes, keys, y, epsilon)
    lined = boxes.join(starts, keys).withColumn(
        "line", F.size(F.filter("starts", lambda s: s <= F.col(y).cast("double"))) - 1
    ).drop("starts")
    counts = lined.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "line", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "line").orderBy(x, y, tie)
    numbered = lined.withColumn("_i", F.row_number().over(inside))
    return numbered.join(before, [*keys, "line"]).withColumn(
        "reading_index", (F.col("_before") + F.col("_i") - 1).cast("long")
    ).drop("_i", "_before")


def assembled_order(nodes: DataFrame, keys: list[str], out: str = "ord") -> DataFrame:
    """Dense ordinal by (page, top of box, node id) over all nodes of a document.

    Numbered inside the page; the pages' counts are summed along the document.
    """
    top = F.coalesce(F.get("bbox", F.lit(1)), F.lit(0.0).cast("float"))
    paged = nodes.withColumns({"_page": F.coalesce("page", F.lit(0)), "_top": top})
    inside = Window.partitionBy(*keys, "_page").orderBy("_top", "node_id")
    numbered = paged.withColumn("_i", F.row_number().over(inside))
    counts = paged.groupBy(*keys, "_page").agg(F.count(F.lit(1)).alias("_n"))
    before = running_total(counts, keys, "_page", F.col("_n"), "_before", inclusive=False).drop("_n")
    return numbered.join(before, [*keys, "_page"]).withColumn(
        out, F.col("_before") + F.col("_i") - 1
    ).drop("_page", "_top", "_i", "_before")


def with_node_ids(elements: DataFrame, keys: list[str], position: str = "ord") -> DataFrame:
    """Ids numbered over all nodes of the document, so siblings never share one."""
    return elements.withColumn("node_id", node_id(F.coalesce("page", F.lit(1)), F.col(position) + 1))


def with_sections(nodes: DataFrame, keys: list[str], position: str = "ord", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``section_id``: the last header or title before a node (null for headers and leading nodes)."""
    header = F.col("type").isin(*HEADERS)
    marked = nodes.withColumn("_h", F.when(header, F.col("node_id")))
    carried = carry_last(marked, keys, position, {"_h": "section_id"}, width=width)
    return carried.withColumn("section_id", F.when(~header, F.col("section_id"))).drop("_h")


def with_sibling_context(nodes: DataFrame, keys: list[str], position: str = "ord", parent_text: str | None = None, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``context``: parent text, the text before, up to two texts after.

    The following texts stop at the first sibling that is not text.
    """
    text = F.when((F.col("type") == "TEXT"), presence(F.col("content")))
    marked = nodes.withColumn("_t", text)
    looked = neighbours(marked, keys, position, {"_p": ("_t", -1), "_n1": ("_t", 1), "_n2": ("_t", 2)}, width)
    parent = presence(F.col(parent_text)) if parent_text else F.lit(None).cast("string")
    second = F.when(F.col("_n1").isNotNull(), F.col("_n2"))
    return looked.withColumn("context", F.concat_ws("\n", parent, "_p", "_n1", second)).drop("_t", "_p", "_n1", "_n2")


def carry_scale(tables: DataFrame, keys: list[str], position: str, scale: str, headers: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Scale footnote and headers of earlier tables for tables that have none."""
    out = carry_last(tables, keys, position, {scale: "context_scale", headers: "carried_headers"}, inclusive=True, width=width)
    return out


def text_sample(nodes: DataFrame, keys: list[str], position: str = "ord", limit: int | None = None, width: int = DEFAULT_WIDTH) -> DataFrame:
    """(keys, sample): text nodes in order, all or until more than ``limit`` characters, cut there."""
    texts = nodes.where((F.col("type") == "TEXT") & presence(F.col("content")).isNotNull())
    kept = texts
    if limit is not None:
        before = running_total(texts, keys, position, F.length("content"), "_before", inclusive=False, width=width)
        kept = before.where(F.col("_before") <= limit)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(position, "content"))), lambda s: s["content"])
    sample = F.array_join(parts, "\n")
    return kept.groupBy(*keys).agg((sample if limit is None else F.substring(sample, 1, limit)).alias("sample"))


# --- trees and routing -------------------------------------------------------


def flatten_tree(documents: DataFrame, keys: list[str], nodes: str = "nodes") -> DataFrame:
    """Nested nodes to one row per node with parent_id, depth and sibling ord.

    The depth is the one of the schema; levels are exploded one by one.
    """
    level_type = documents.schema[nodes].dataType
    level = documents.select(*keys, F.lit(None).cast("string").alias("parent_id"), F.posexplode_outer(nodes).alias("ord", "n")).where("n IS NOT NULL")
    out, depth = None, 0
    while True:
        fields = level_type.elementType.fieldNames()
        plain = [f for f in fields if f != "children"]
        flat = level.select(*keys, "parent_id", "ord", F.lit(depth).alias("depth"), *[F.col(f"n.{f}").alias(f) for f in plain])
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
        if "children" not in fields:
            return out
        level_type = level_type.elementType["children"].dataType
        if not isinstance(level_type, T.ArrayType):
            return out
        level = level.select(*keys, F.col("n.node_id").alias("parent_id"), F.posexplode("n.children").alias("ord", "n"))
        depth += 1


def node_routes(kind: Column, content: Column, context: Column | None = None) -> Column:
    """Destinations of a node: sql, vector, graph; images go nowhere."""
    context = F.lit("") if context is None else F.coalesce(context, F.lit(""))
    filled = F.coalesce(strip(content) != "", F.lit(False))
    table, pairs, text = kind == "TABLE", kind.isin("KEY_VALUE", "FORM"), kind.isin(*TEXT_KINDS)
    around = graph_signal(F.concat_ws("\n", context, F.coalesce(content, F.lit(""))))
    sql = F.when(table | pairs, "sql")
    vector = F.when((table | pairs | text) & filled, "vector")
    graph = F.when(((table | pairs) & around) | ((kind == "TEXT") & filled & graph_signal(content, 50)), "graph")
    return F.array_compact(F.array(sql, vector, graph))


def routed(nodes: DataFrame) -> DataFrame:
    """One row per node and destination."""
    return nodes.withColumn("route", F.explode("routes"))


def early_tables(nodes: DataFrame) -> DataFrame:
    """Tables and key-value nodes, which are passed on before their document is complete."""
    return nodes.where(F.col("type").isin("TABLE", "KEY_VALUE"))


# --- page plans --------------------------------------------------------------


def page_flags(tables: DataFrame, keys: list[str], page: str, top: str, bottom: str, height: str) -> DataFrame:
    """Per page: does a table reach its bottom, does one start at its top?"""
    return tables.groupBy(*keys, page).agg(
        F.bool_or(F.col(bottom) > F.col(height) * TABLE_SPAN_BOTTOM).alias("spans_bottom"),
        F.bool_or(F.col(top) < F.col(height) * TABLE_SPAN_TOP).alias("continues_top"),
    )


def plan_chunks(pages: DataFrame, keys: list[str], page: str = "page", size: int = PAGES_PER_CHUNK) -> DataFrame:
    """Page ranges of ``size`` pages that do not cut through a table.

    Pages: keys, page (dense from 0), spans_bottom, continues_top.  A range is
    extended while its last page's table goes on; when the next page does not
    continue it, that page is the last one added.  The fold sees two flags per
    page of one file, nothing of the page's content.
    """
    flags = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce("spans_bottom", F.lit(False)).alias("s"), F.coalesce("continues_top", F.lit(False)).alias("c"))))
    listed = pages.groupBy(*keys).agg(flags.alias("_flags"))
    start = F.struct(
        F.lit(0).cast("long").alias("start"), F.lit(size - 1).cast("long").alias("end"), F.lit(False).alias("final"),
        F.array().cast("array<struct<start_page:bigint,end_page:bigint>>").alias("chunks"),
    )

    def step(acc: Column, x: Column) -> Column:
        p = x["p"].cast("long")
        following = F.get("_flags", (p + 1).cast("int"))
        at_end = p >= acc["end"]
        extend = at_end & ~acc["final"] & x["s"] & following.isNotNull()
        close = (at_end & ~extend) | following.isNull()
        done = F.struct(acc["start"].alias("start_page"), p.alias("end_page"))
        return F.struct(
            F.when(close, p + 1).otherwise(acc["start"]).alias("start"),
            F.when(close, p + size).when(extend, p + 1).otherwise(acc["end"]).alias("end"),
            F.when(close, False).when(extend, ~following["c"]).otherwise(acc["final"]).alias("final"),
            F.when(close, F.concat(acc["chunks"], F.array(done))).otherwise(acc["chunks"]).alias("chunks"),
        )

    planned = listed.select(*keys, F.aggregate("_flags", start, step, lambda acc: acc["chunks"]).alias("_chunks"))
    return planned.select(
        *keys, F.size("_chunks").alias("chunk_total"), F.posexplode("_chunks").alias("chunk_index", "_c")
    ).select(*keys, "chunk_index", "chunk_total", "_c.start_page", "_c.end_page")


def headings(spans: DataFrame, keys: list[str], page: str = "page", position: str = "ord") -> DataFrame:
    """Last heading per page: larger than 11 or bold, 4 to 99 characters."""
    text = strip(F.col("text"))
    big = (F.col("size") > 11) | F.lower("font").contains("bold")
    ok = big & (F.length(text) > 3) & (F.length(text) < 100)
    return spans.groupBy(*keys, page).agg(F.max_by(text, F.when(ok, F.col(position))).alias("heading"))


def with_chunk_context(plan: DataFrame, page_headings: DataFrame, keys: list[str], page: str = "page", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds the last heading up to the end of each range; none for the first range.

    ``page_headings`` has a row for every page.
    """
    carried = carry_last(page_headings, keys, page, {"heading": "injected_context"}, inclusive=True, width=width)
    at_end = carried.select(*keys, F.col(page).alias("end_page"), "injected_context")
    joined = plan.join(at_end, [*keys, "end_page"], "left")
    return joined.withColumn("injected_context", F.when(F.col("start_page") > 0, F.coalesce("injected_context", F.lit(""))).otherwise(""))


def fan_out(events: DataFrame, plan: DataFrame, key: str = "event_id") -> DataFrame:
    """One event per page range, with the range in its metadata."""
    joined = events.join(plan, key)
    s = lambda c: F.col(c).cast("string")
    added = F.create_map(
        F.lit("start_page"), s("start_page"), F.lit("end_page"), s("end_page"),
        F.lit("chunk_index"), s("chunk_index"), F.lit("chunk_total"), s("chunk_total"),
    )
    return joined.withColumn("metadata", F.map_concat("metadata", added))
