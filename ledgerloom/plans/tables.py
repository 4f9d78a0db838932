"""Tables: notations, structure, key-value lines, batches, years, stitching."""

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import alignment as A
from ..operators import stitching as S
from ..sources.readers import is_json_object
from .base import query

# One table per customer and key range, in five notations.
CELLS = """
SELECT o_orderkey AS k, CASE o_orderkey % 6
  WHEN 0 THEN '{{"headers":["Item","Amount"],"rows":[["' || o_orderstatus || '","' || CAST(o_custkey AS STRING) || '"],["x",""]]}}'
  WHEN 1 THEN '{{"Item":["' || o_orderstatus || '","x"],"Amount":["' || CAST(o_custkey AS STRING) || '"]}}'
  WHEN 2 THEN 'Item<fcel>Amount<nl><fcel>' || o_orderstatus || '<fcel>' || CAST(o_custkey AS STRING) || '<ecel><nl><fcel>x<nl>'
  WHEN 3 THEN '| Item | Amount |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderstatus || ' | ' || CAST(o_custkey AS STRING) || ' |' || chr(10) || '| x |'
  WHEN 4 THEN 'just ' || o_orderpriority ELSE '' END AS content
FROM {orders}"""


@query(
    "normalize_tables",
    """SELECT k, CASE k % 6 WHEN 4 THEN 'blob' WHEN 5 THEN 'empty' WHEN 2 THEN 'otsl' WHEN 3 THEN 'markdown' ELSE 'json' END AS notation,
  CASE k % 6 WHEN 4 THEN 'content' WHEN 5 THEN '' ELSE 'Item,Amount' END AS headers,
  CASE k % 6 WHEN 4 THEN content WHEN 5 THEN '' ELSE o_orderstatus || ',' || CAST(o_custkey AS VARCHAR) || ';x,' END AS rows
FROM c JOIN orders ON o_orderkey = k""",
    c=CELLS,
)
def normalize_tables(src, c):
    t = c.withColumn("t", T.normalize_table(F.col("content"))).withColumn("n", T.table_notation(F.col("content")))
    rows = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";")
    return t.select("k", F.col("n").alias("notation"), F.array_join("t.headers", ",").alias("headers"), rows.alias("rows"))


@query(
    "table_markdown",
    """SELECT k, CASE k % 6 WHEN 4 THEN '| content |' || chr(10) || '|---|' || chr(10) || '| ' || content || ' |' WHEN 5 THEN '' ELSE
  '| Item | Amount |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderstatus || ' | ' || CAST(o_custkey AS VARCHAR) || ' |' || chr(10) || '| x |  |' END AS markdown,
  CASE k % 6 WHEN 4 THEN -1 WHEN 5 THEN -1 ELSE 2 END AS amounts FROM c JOIN orders ON o_orderkey = k""",
    c=CELLS,
)
def table_markdown(src, c):
    t = c.withColumn("t", T.normalize_table(F.col("content")))
    columns = T.table_to_columnar(F.col("t"))
    return t.withColumn("m", columns).select("k", T.to_markdown(F.col("t")).alias("markdown"), F.coalesce(F.size(F.col("m")["Amount"]), F.lit(-1)).alias("amounts"))


PAIRS = """SELECT event_id AS k, 'Type: ' || event_type || chr(10) || ' User = ' || CAST(user_id AS STRING) || chr(10) || chr(10) || 'url: http://x=1' || chr(10) || '2x = 5' || chr(10) || 'Type: last ' || event_type AS body FROM {events}"""


@query(
    "key_value_lines",
    "SELECT event_id AS k, 'last ' || event_type AS type, CAST(user_id AS VARCHAR) AS user, 'http://x=1' AS url, 3 AS keys, true AS looks FROM events",
    p=PAIRS,
)
def key_value_lines(src, p):
    m = p.withColumn("m", T.key_value_lines(F.col("body"))).withColumn("looks", T.looks_key_value(F.col("body")))
    return m.select("k", F.col("m")["Type"].alias("type"), F.col("m")["User"].alias("user"), F.col("m")["url"].alias("url"), F.size("m").alias("keys"), "looks")


STRUCTURES = """
SELECT o_orderkey AS k, CASE o_orderkey % 9
  WHEN 0 THEN '{{"headers":["a","b"],"rows":[["1","2"],["3","4"]]}}' WHEN 1 THEN '{{"headers":["a","A",""],"rows":[["1","2","3"],["1"]]}}' WHEN 2 THEN '{{"headers":[],"rows":[]}}'
  WHEN 3 THEN 'not json ' || o_orderstatus WHEN 4 THEN '' WHEN 5 THEN '{{"headers":["content"],"rows":[["' || o_orderstatus || '"]]}}' WHEN 6 THEN '{{"x":1}}'
  WHEN 7 THEN '{{"headers":["a","b","c","d"],"rows":[["1","","",""],["","","",""]]}}' ELSE '{{"headers":["a"],"rows":[["1"],["1","2"],["1","2"],["3"]]}}' END AS content FROM {orders}"""


@query(
    "structure_critic",
    """WITH r(v, ok, issues, ragged, ratio) AS (VALUES (0, true, '', 0, 0.0), (1, true, 'table.duplicate_header:soft,table.blank_headers:soft,table.ragged_rows:soft', 1, 0.0), (2, false, 'table.no_headers:hard,table.no_rows:soft', 0, 0.0),
  (3, false, 'table.not_json:hard', 0, 0.0), (4, false, 'table.empty:hard', 0, 0.0), (5, true, 'table.fallback_blob:soft', 0, 0.0), (6, false, 'table.schema:hard', 0, 0.0), (7, true, 'table.sparse:soft', 0, 0.875), (8, false, 'table.ragged_rows:hard', 2, 0.0))
SELECT k, ok, issues, ragged, ratio::DOUBLE AS ratio FROM s JOIN r ON v = k % 9""",
    s=STRUCTURES,
)
def structure_critic(src, s):
    r = s.withColumn("r", T.structure_report(F.col("content")))
    issues = F.array_join(F.transform("r.issues", lambda i: F.concat(i["rule_id"], F.lit(":"), i["severity"])), ",")
    return r.select("k", "r.ok", issues.alias("issues"), F.col("r.ragged_rows").alias("ragged"), F.col("r.empty_cell_ratio").alias("ratio"))


@query(
    "structure_preflight",
    "SELECT k, k % 9 IN (2, 3, 4, 6, 8) AS rejected, CASE k % 9 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS issues FROM s",
    s=STRUCTURES,
)
def structure_preflight(src, s):
    v = s.withColumn("v", A.structure_preflight(T.structure_report(F.col("content"))))
    return v.select("k", F.exists("v", lambda x: x["severity"] == "hard").alias("rejected"), F.size("v").alias("issues"))


@query("json_quarantine", "SELECT k, k % 9 NOT IN (3, 4) AS decodes FROM s", s=STRUCTURES)
def json_quarantine(src, s):
    return s.select("k", F.coalesce(is_json_object(F.col("content")), F.lit(False)).alias("decodes"))


@query(
    "row_batches",
    """WITH n AS (SELECT k, b, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS target FROM (SELECT k, i, CAST(floor(i / 10) AS BIGINT) AS b FROM p) GROUP BY k, b)
SELECT n.k, n.b AS batch, target, coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM p WHERE p.k = n.k AND i BETWEEN n.b * 10 - 3 AND n.b * 10 - 1), '') AS context FROM n""",
    p="SELECT l_suppkey AS k, l_orderkey AS i FROM {lineitem} GROUP BY l_suppkey, l_orderkey",
)
def row_batches(src, p):
    out = A.row_batches(p, ["k"], "i", ["k"])
    text = lambda c: F.array_join(F.transform(c, lambda r: r["i"].cast("string")), ",")
    return out.select("k", "batch", text("target_rows").alias("target"), text("context_rows").alias("context"))


YEARS = "SELECT o_orderkey AS k, year(o_orderdate) AS y, o_custkey AS a, o_orderpriority AS label FROM {orders}"


@query(
    "unpivot_years",
    """SELECT k, label, CAST(y AS VARCHAR) AS period, CAST(a AS VARCHAR) AS amount FROM y WHERE k % 3 <> 0 UNION ALL SELECT k, label, CAST(y + 1 AS VARCHAR), CAST(k AS VARCHAR) FROM y WHERE k % 3 <> 0
UNION ALL SELECT k, label, '', '' FROM y WHERE k % 3 = 0""",
    y=YEARS,
)
def unpivot_years(src, y):
    """Two years in a row become two rows; rows of one year stay."""
    text = lambda c: F.col(c).cast("string")
    later = (F.col("y") + 1).cast("string")
    two = F.create_map(F.lit("label"), F.col("label"), F.concat(F.lit("FY"), text("y")), text("a"), later, text("k"))
    one = F.create_map(F.lit("label"), F.col("label"), later, text("k"))
    rows = y.select("k", F.when(F.col("k") % 3 != 0, two).otherwise(one).alias("data"))
    m = F.col("data")
    g = lambda c: F.coalesce(m[c], F.lit(""))
    return A.unpivot_years(rows).select("k", m["label"].alias("label"), g("context_reporting_period").alias("period"), g("amount").alias("amount"))


@query(
    "unpivot_wide",
    "SELECT k, CAST(p AS VARCHAR) AS period, CASE WHEN y = p THEN a ELSE -1 END AS amount FROM y, range(1992, 1999) r(p)",
    y=YEARS,
)
def unpivot_wide(src, y):
    names = {p: f"FY{p}" if p % 2 else str(p) for p in range(1992, 1999)}
    wide = y.select("k", *[F.when(F.col("y") == p, F.col("a")).alias(n) for p, n in names.items()])
    return A.unpivot_wide(wide, ["k"], list(names.values())).select("k", "period", F.coalesce("amount", F.lit(-1)).alias("amount"))


# A document per customer; its orders are nodes: tables that share headers run on.
NODES = """
SELECT d, ord, 'n' || CAST(o AS STRING) AS node_id, CAST(1 + floor(ord / 2) AS INT) AS page,
  CASE WHEN o % 7 = 0 THEN 'TEXT' WHEN o % 11 = 0 THEN 'IMAGE' ELSE 'TABLE' END AS type,
  CASE WHEN o % 14 = 0 THEN 'short note' WHEN o % 7 = 0 THEN repeat('long text ', 30) WHEN o % 11 = 0 THEN ''
   ELSE '{{"' || CASE WHEN o % 5 = 0 THEN 'Name' ELSE 'Item' END || '":["' || CAST(o AS STRING) || '"],"Amount":["' || CAST(o % 100 AS STRING) || '"]}}' END AS content
FROM (SELECT o_custkey AS d, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM {orders}) x"""

# The head of a run is found by walking the tables of a document in order.
_WALK = """t AS (SELECT d, ord, page, content LIKE '%"Name"%' AS name, row_number() OVER (PARTITION BY d ORDER BY ord) AS i,
  (SELECT count(*) FROM n s WHERE s.d = n.d AND s.ord < n.ord AND s.type <> 'TABLE' AND NOT (s.type = 'TEXT' AND length(trim(s.content)) BETWEEN 1 AND 159)) AS sep,
  (SELECT count(*) FROM n s WHERE s.d = n.d AND s.ord < n.ord AND s.type <> 'TABLE') AS gap FROM n WHERE type = 'TABLE'),
w AS (SELECT d, i, ord, page, name, sep, gap, ord AS head, page AS hp, name AS hn, sep AS hs, gap AS hg FROM t WHERE i = 1 UNION ALL
 SELECT t.d, t.i, t.ord, t.page, t.name, t.sep, t.gap, CASE WHEN {ok} THEN head ELSE t.ord END, CASE WHEN {ok} THEN hp ELSE t.page END, CASE WHEN {ok} THEN hn ELSE t.name END,
  CASE WHEN {ok} THEN hs ELSE t.sep END, CASE WHEN {ok} THEN hg ELSE t.gap END FROM w JOIN t ON t.d = w.d AND t.i = w.i + 1)"""


@query(
    "table_stitch",
    "WITH RECURSIVE " + _WALK.format(ok="hs = t.sep AND t.page IN (hp, hp + 1) AND hn = t.name") + " SELECT d, head, ord FROM w",
    n=NODES,
)
def table_stitch(src, n):
    tables = S.parsed_tables(n, ["d"])
    return S.table_heads(tables, ["d"]).select("d", "head", "ord")


@query(
    "page_table_merge",
    "WITH RECURSIVE " + _WALK.format(ok="hg = t.gap AND t.page = hp + 1") + " SELECT d, head, ord FROM w",
    n=NODES,
)
def page_table_merge(src, n):
    tables = S.parsed_tables(n, ["d"], skip_weak=False)
    return S.table_heads(tables, ["d"], mode="page").select("d", "head", "ord")


@query(
    "stitched_rows",
    "WITH RECURSIVE " + _WALK.format(ok="hs = t.sep AND t.page IN (hp, hp + 1) AND hn = t.name")
    + """ SELECT w.d, head, w.ord AS part, regexp_extract(content, ':\\["(\\d+)"\\],', 1) || '|' || regexp_extract(content, 'Amount":\\["(\\d+)"', 1) AS cells FROM w JOIN n ON n.d = w.d AND n.ord = w.ord""",
    n=NODES,
)
def stitched_rows(src, n):
    rows = S.stitched_rows(n, ["d"])
    return rows.select("d", "head", "part", F.array_join("values", "|").alias("cells"))


def _narrow(mode):
    def build(src, n):
        tables = S.parsed_tables(n, ["d"], skip_weak=mode == "assembly")
        return S.table_heads(tables, ["d"], mode=mode, width=8).select("d", "head", "ord")

    return build


# the same fold in blocks of eight nodes, composed in levels
query(
    "table_stitch_narrow",
    "WITH RECURSIVE " + _WALK.format(ok="hs = t.sep AND t.page IN (hp, hp + 1) AND hn = t.name") + " SELECT d, head, ord FROM w",
    n=NODES,
)(_narrow("assembly"))
query(
    "page_table_merge_narrow",
    "WITH RECURSIVE " + _WALK.format(ok="hg = t.gap AND t.page = hp + 1") + " SELECT d, head, ord FROM w",
    n=NODES,
)(_narrow("page"))


CARRIED = """SELECT l_orderkey AS d, l_partkey * 8 + l_linenumber AS i, CASE WHEN l_partkey % 3 = 0 THEN 'in millions' WHEN l_partkey % 7 = 0 THEN 'in thousands' END AS scale,
  CASE WHEN min(l_suppkey) % 4 = 0 THEN 'h' || CAST(min(l_suppkey) AS STRING) END AS headers FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_linenumber"""


@query(
    "carry_scale",
    """SELECT d, i, coalesce(last_value(scale IGNORE NULLS) OVER w, '') AS context_scale, coalesce(last_value(headers IGNORE NULLS) OVER w, '') AS carried_headers
FROM c WINDOW w AS (PARTITION BY d ORDER BY i, coalesce(headers, '') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    c=CARRIED,
)
def carry_scale(src, c):
    from ..operators.layout import carry_scale as carry

    out = carry(c, ["d"], "i", "scale", "headers", width=64)  # narrow: most orders cross segments
    return out.select("d", "i", F.coalesce("context_scale", F.lit("")).alias("context_scale"), F.coalesce("carried_headers", F.lit("")).alias("carried_headers"))
