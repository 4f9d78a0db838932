"""Layout: reading order, sections, context, boxes, routing, page plans."""

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import layout as L
from ..operators import refs as R
from .base import ORACLES, query

BOXES = """
SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS box_id, CAST((l_suppkey * 7) % 60 AS DOUBLE) AS y0, CAST(l_partkey % 500 AS DOUBLE) AS x0 FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_linenumber, l_suppkey"""

_LINES = """o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, box_id) AS i FROM b),
w AS (SELECT page, box_id, x0, y0, i, 0 AS line, y0 AS total, 1 AS n FROM o WHERE i = 1 UNION ALL
 SELECT o.page, o.box_id, o.x0, o.y0, o.i, CASE WHEN abs(o.y0 - total / n) <= 15 THEN line ELSE line + 1 END, CASE WHEN abs(o.y0 - total / n) <= 15 THEN total + o.y0 ELSE o.y0 END, CASE WHEN abs(o.y0 - total / n) <= 15 THEN n + 1 ELSE 1 END
 FROM w JOIN o ON o.page = w.page AND o.i = w.i + 1)"""


@query(
    "reading_order",
    f"WITH RECURSIVE {_LINES} SELECT page, box_id, line, row_number() OVER (PARTITION BY page ORDER BY line, x0, y0, box_id) - 1 AS reading_index FROM w",
    b=BOXES,
)
def reading_order(src, b):
    out = L.reading_order(b.withColumn("tie", F.struct("y0", "box_id")), ["page"], tie="tie")
    return out.select("page", "box_id", "line", "reading_index")


# Turns of a conversation as the nodes of a document.
TURNS = """
SELECT conv_id AS d, turn AS ord, 'n' || CAST(turn AS STRING) AS node_id, CAST(1 + floor(turn / 3) AS INT) AS page,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN 'SECTION_HEADER' WHEN (conv_id + turn) % 11 = 0 THEN 'TITLE' WHEN (conv_id * turn) % 5 = 3 THEN 'TABLE' WHEN (conv_id + turn) % 13 = 0 THEN 'IMAGE' ELSE 'TEXT' END AS type,
  CASE WHEN (conv_id + 2 * turn) % 9 = 0 THEN '' ELSE text END AS content FROM {conversations}"""


@query(
    "section_assign",
    """SELECT d, ord, coalesce(CASE WHEN type NOT IN ('SECTION_HEADER', 'TITLE') THEN last_value(CASE WHEN type IN ('SECTION_HEADER', 'TITLE') THEN node_id END IGNORE NULLS) OVER (PARTITION BY d ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, '') AS section_id FROM n""",
    n=TURNS,
)
def section_assign(src, n):
    return L.with_sections(n, ["d"]).select("d", "ord", F.coalesce("section_id", F.lit("")).alias("section_id"))


@query("section_assign_narrow", ORACLES["section_assign"])
def section_assign_narrow(src):
    """The same over segments of four nodes."""
    return L.with_sections(src.sql(TURNS), ["d"], width=4).select("d", "ord", F.coalesce("section_id", F.lit("")).alias("section_id"))


@query(
    "sibling_context",
    """WITH t AS (SELECT d, ord, CASE WHEN type = 'TEXT' AND content <> '' THEN content END AS t FROM n),
x AS (SELECT d, ord, lag(t) OVER w AS p, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2 FROM t WINDOW w AS (PARTITION BY d ORDER BY ord))
SELECT d, ord, concat_ws(chr(10), p, n1, CASE WHEN n1 IS NOT NULL THEN n2 END) AS context FROM x""",
    n=TURNS,
)
def sibling_context(src, n):
    return L.with_sibling_context(n, ["d"], width=64).select("d", "ord", "context")


@query(
    "text_sample",
    """WITH t AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY d ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE type = 'TEXT' AND content <> '')
SELECT d, md5(string_agg(content, chr(10) ORDER BY ord)) AS whole, md5(substring(string_agg(content, chr(10) ORDER BY ord) FILTER (before <= 400), 1, 400)) AS sample FROM t GROUP BY d""",
    n=TURNS,
)
def text_sample(src, n):
    whole = L.text_sample(n, ["d"]).select("d", F.md5("sample").alias("whole"))
    return whole.join(L.text_sample(n, ["d"], limit=400, width=8).select("d", F.md5("sample").alias("sample")), "d")


@query(
    "node_routes",
    """SELECT d, ord, concat_ws(',', CASE WHEN type = 'TABLE' THEN 'sql' END, CASE WHEN type <> 'IMAGE' AND trim(content) <> '' THEN 'vector' END,
  CASE WHEN (type = 'TABLE' OR (type = 'TEXT' AND length(trim(content)) >= 50)) AND regexp_matches(content, '(?i)director|auditor|merger|guarantee|kmp|subsidiary|ownership|borrowing') THEN 'graph' END) AS routes FROM n""",
    n=TURNS,
)
def node_routes(src, n):
    routed = n.select("d", "ord", L.node_routes(F.col("type"), F.col("content")).alias("r"))
    return routed.select("d", "ord", F.array_join("r", ",").alias("routes"))


@query(
    "completion_status",
    """SELECT d AS document_id, count(*) FILTER (type = 'TABLE') AS sql_nodes_total, bool_or(type <> 'IMAGE' AND trim(content) <> '') AS vector_mapped,
  CASE WHEN bool_or(type = 'TABLE' OR (type <> 'IMAGE' AND trim(content) <> '')) THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status FROM n GROUP BY d""",
    n=TURNS,
)
def completion_status(src, n):
    nodes = n.select(F.col("d").alias("document_id"), L.node_routes(F.col("type"), F.col("content")).alias("routes"))
    return J.completion_status(nodes).select("document_id", "sql_nodes_total", "vector_mapped", "status")


PLACED = """
SELECT l_orderkey AS d, CAST(l_linenumber AS INT) AS page, 'n' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS node_id, CAST(l_quantity * 16 AS FLOAT) AS y0 FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"""


@query(
    "assembled_order",
    "SELECT d, node_id, y0::DOUBLE AS y0, row_number() OVER (PARTITION BY d ORDER BY page, y0, node_id) - 1 AS ord FROM p",
    p=PLACED,
)
def assembled_order(src, p):
    nodes = p.withColumn("bbox", F.array(F.lit(0.0).cast("float"), "y0", F.lit(0.0).cast("float"), "y0"))
    return L.assembled_order(nodes, ["d"]).select("d", "node_id", F.col("y0").cast("double").alias("y0"), "ord")


@query(
    "node_ids",
    "SELECT d, y0::DOUBLE AS y0, 'node_p' || CAST(page AS VARCHAR) || '_' || CAST(row_number() OVER (PARTITION BY d ORDER BY page, y0, node_id) AS VARCHAR) AS node_id FROM p",
    p=PLACED,
)
def node_ids(src, p):
    nodes = p.withColumn("bbox", F.array(F.lit(0.0).cast("float"), "y0", F.lit(0.0).cast("float"), "y0"))
    out = L.with_node_ids(L.assembled_order(nodes, ["d"]), ["d"])
    return out.select("d", F.col("y0").cast("double").alias("y0"), "node_id")


@query(
    "header_footer_filter",
    "SELECT d, page, node_id FROM p WHERE y0 = 0 OR NOT (y0 + 20 < 50 OR y0 > 742)",
    p=PLACED,
)
def header_footer_filter(src, p):
    zero, edge = F.lit(0.0).cast("float"), F.when(F.col("y0") == 0, 0.0).otherwise(F.col("y0") + 20).cast("float")
    nodes = p.withColumn("bbox", F.array(zero, "y0", zero, edge))
    return L.without_header_footer(nodes).select("d", "page", "node_id")


RECTANGLES = """
SELECT l_orderkey AS d, l_partkey AS id, l_linenumber = 1 AS is_table, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0,
  CAST(l_partkey % 300 + 10 * l_linenumber AS DOUBLE) AS x1, CAST(l_suppkey % 700 + l_quantity AS DOUBLE) AS y1 FROM {lineitem}"""


@query(
    "boxes_outside_tables",
    "SELECT d, id FROM r b WHERE NOT is_table AND NOT EXISTS (SELECT 1 FROM r t WHERE t.is_table AND t.d = b.d AND NOT (b.x1 < t.x0 OR b.x0 > t.x1 OR b.y1 < t.y0 OR b.y0 > t.y1))",
    r=RECTANGLES,
)
def boxes_outside_tables(src, r):
    return L.outside_tables(r.where("NOT is_table"), r.where("is_table"), ["d"]).select("d", "id")


@query(
    "layout_labels",
    """WITH l AS (SELECT p_partkey AS k, p_name, CASE p_partkey % 9 WHEN 0 THEN 'table' WHEN 1 THEN 'picture' WHEN 2 THEN 'key_value_region' WHEN 3 THEN 'form' WHEN 4 THEN 'section_header' WHEN 5 THEN 'title' WHEN 6 THEN 'checkbox_selected' WHEN 7 THEN 'checkbox_unselected' ELSE 'paragraph' END AS label FROM part)
SELECT k, CASE WHEN label = 'table' THEN 'TABLE' WHEN label = 'picture' THEN 'IMAGE' WHEN label = 'key_value_region' THEN 'KEY_VALUE' WHEN label LIKE 'checkbox%' THEN 'CHECKBOX' WHEN label = 'paragraph' THEN 'TEXT' ELSE upper(label) END AS type,
  CASE WHEN label IN ('table', 'picture') THEN '' WHEN label = 'checkbox_selected' THEN '[CHECKED] ' || p_name WHEN label = 'checkbox_unselected' THEN '[UNCHECKED] ' || p_name ELSE p_name END AS content FROM l""",
)
def layout_labels(src):
    kinds = ["table", "picture", "key_value_region", "form", "section_header", "title", "checkbox_selected", "checkbox_unselected", "paragraph"]
    label = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("p_partkey") % 9 + 1).cast("int"))
    p = src.table("part").select(F.col("p_partkey").alias("k"), "p_name", label.alias("label"))
    return p.select("k", L.node_type(F.col("label")).alias("type"), F.coalesce(L.node_content(F.col("label"), F.col("p_name")), F.lit("")).alias("content"))


@query(
    "scaled_boxes",
    "SELECT p_partkey AS k, round(p_size * 612.0 / 1000, 4)::DOUBLE AS x0, round((p_size + 10) * 792.0 / 2000, 4)::DOUBLE AS y1 FROM part",
)
def scaled_boxes(src):
    size = F.col("p_size").cast("double")
    box = L.scale_box(F.array(size, size, size + 5, size + 10), F.lit(612.0), F.lit(792.0), F.lit(1000.0), F.lit(2000.0))
    return src.table("part").select(F.col("p_partkey").alias("k"), box.alias("b")).select("k", F.round(F.col("b")[0], 4).alias("x0"), F.round(F.col("b")[3], 4).alias("y1"))


PAGES = """
SELECT o_custkey AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page, o_orderkey % 4 = 0 AS spans_bottom, o_orderkey % 3 <> 0 AS continues_top,
  CASE WHEN o_orderkey % 5 = 0 THEN 'H' || CAST(o_orderkey AS STRING) END AS heading FROM {orders}"""

_PLAN = """f AS (SELECT d, page, spans_bottom AS s, lead(continues_top) OVER (PARTITION BY d ORDER BY page) AS c, max(page) OVER (PARTITION BY d) AS last FROM g),
z AS (SELECT d, page, s, c, last, 0 AS st, 4 AS en, false AS fin, false AS closed FROM f WHERE page = -1
 UNION ALL SELECT d, page, s, c, last, 0, CASE WHEN last = 0 THEN 0 ELSE 4 END, false, page = last FROM f WHERE page = 0
 UNION ALL SELECT f.d, f.page, f.s, f.c, f.last, q.st, CASE WHEN f.page >= q.en AND NOT q.fin AND f.s AND f.page < f.last THEN f.page + 1 ELSE q.en END,
  CASE WHEN f.page >= q.en AND NOT q.fin AND f.s AND f.page < f.last THEN NOT f.c ELSE q.fin END,
  f.page = f.last OR (f.page >= q.en AND NOT (NOT q.fin AND f.s))
  FROM (SELECT d, page, CASE WHEN closed THEN page + 1 ELSE st END AS st, CASE WHEN closed THEN page + 5 ELSE en END AS en, CASE WHEN closed THEN false ELSE fin END AS fin FROM z) q JOIN f ON f.d = q.d AND f.page = q.page + 1)"""


@query(
    "page_plan",
    f"""WITH RECURSIVE {_PLAN}, h AS (SELECT d, page, last_value(heading IGNORE NULLS) OVER (PARTITION BY d ORDER BY page) AS hd FROM g)
SELECT z.d, st AS start_page, z.page AS end_page, CASE WHEN st > 0 THEN coalesce(hd, '') ELSE '' END AS injected_context FROM z JOIN h ON h.d = z.d AND h.page = z.page WHERE closed""",
    g=PAGES,
)
def page_plan(src, g):
    plan = L.plan_chunks(g, ["d"])
    headed = L.with_chunk_context(plan, g.select("d", "page", "heading"), ["d"])
    return headed.select("d", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), "injected_context")


@query(
    "page_headings",
    "SELECT l_orderkey AS d, arg_max('text ' || CAST(l_partkey AS VARCHAR), l_partkey) FILTER (l_quantity > 40 OR l_linestatus = 'O') AS heading FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 40 OR l_linestatus = 'O') > 0",
)
def page_headings(src):
    spans = src.table("lineitem").select(
        F.col("l_orderkey").alias("d"), F.lit(1).alias("page"), F.col("l_partkey").alias("ord"), (F.col("l_quantity") / 40 * 11).alias("size"),
        F.when(F.col("l_linestatus") == "O", "Arial-Bold").otherwise("Arial").alias("font"),
        F.concat(F.lit(" text "), F.col("l_partkey").cast("string")).alias("text"),
    )
    return L.headings(spans, ["d"]).where("heading IS NOT NULL").select("d", "heading")


REFS = "SELECT user_id AS answer, event_id AS seq, event_type AS document_id, CAST(floor(value) AS INT) AS source_page FROM {events}"


@query(
    "keep_first_refs",
    "SELECT answer, document_id, source_page, min(seq) AS seq FROM r GROUP BY ALL",
    r=REFS,
)
def keep_first_refs(src, r):
    return R.keep_first_refs(r, ["answer"], "seq")


@query(
    "numbered_citations",
    """WITH f AS (SELECT answer, document_id, source_page, min(seq) AS seq FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY seq) AS number FROM f)
SELECT answer, number, document_id || '#page=' || CAST(source_page AS VARCHAR) || CASE WHEN seq % 2 = 0 THEN '&bbox=1.5,2.5,3.5,4.5' ELSE '' END AS link FROM n""",
    r=REFS,
)
def numbered_citations(src, r):
    first = R.keep_first_refs(r, ["answer"], "seq")
    box = F.when(F.col("seq") % 2 == 0, F.array(*[F.lit(x).cast("float") for x in (1.5, 2.5, 3.5, 4.5)])).otherwise(F.array(*[F.lit(0.0).cast("float")] * 4))
    return R.numbered_citations(first.withColumn("source_bbox", box), ["answer"], "seq").select("answer", "number", "link")


@query(
    "reference_union",
    """SELECT answer, document_id, source_page, CASE WHEN bool_or(seq % 3 = 0) THEN 0 ELSE 1 END AS source_rank FROM r GROUP BY ALL""",
    r=REFS,
)
def reference_union(src, r):
    out = R.union_refs(r.where("seq % 3 = 0"), r.where("seq % 3 <> 0"), ["answer"], "seq")
    return out.select("answer", "document_id", "source_page", "source_rank")
