"""Text: routing, identifiers, facts, signals, chunks, failures."""

from pyspark.sql import functions as F

from ..fixed_values import CHUNK_BREAKS, CHUNK_CHARS, CHUNK_OVERLAP, GRAPH_INGEST_EXTRA_PATTERNS, GRAPH_SIGNAL_PATTERNS, ROUTER_RULES
from ..functions import text as X
from ..functions.hof import presence
from .base import query

# Business phrases chosen by the order's numbers, around its own text.
PHRASES = """
SELECT o_orderkey AS k, o_orderpriority || ' ' ||
  CASE o_orderkey % 13 WHEN 0 THEN 'Consolidated Balance  Sheets: total assets and current liabilities' WHEN 1 THEN 'Statement of operations, net income, cost of sales'
   WHEN 2 THEN 'Cash flows from operating activities and financing activities' WHEN 3 THEN 'Exhibit 21 subsidiaries of the registrant' WHEN 4 THEN 'Note 12 segment reporting'
   WHEN 5 THEN 'Bank statement opening balance withdrawal deposit' WHEN 6 THEN 'Account number, statement period, ending balance' WHEN 7 THEN 'INVOICE number 7, bill to, amount due'
   WHEN 8 THEN 'unit price quantity line total' WHEN 9 THEN 'Purchase order PO # 55' WHEN 10 THEN 'Form 1040 adjusted gross income W-2' WHEN 11 THEN 'utility kwh meter reading amount due' ELSE 'nothing special' END
  || CASE o_custkey % 5 WHEN 0 THEN ' net income' WHEN 1 THEN ' subtotal' WHEN 2 THEN ' director and auditor of the holding company' ELSE '' END
  || CASE o_custkey % 7 WHEN 0 THEN ' Companies Act, Ind AS, ₹ in crores' WHEN 1 THEN ' Form 10-K US-GAAP item 8.' WHEN 2 THEN ' $ in millions' WHEN 3 THEN ' in thousand and USD thousands' ELSE '' END
  || CASE o_orderkey % 4 WHEN 0 THEN ' CIN: L17110MH1973PLC0' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0') WHEN 1 THEN ' cik 00' || lpad(CAST(o_custkey AS STRING), 6, '0') || ' end' WHEN 2 THEN ' Ticker: ABC NSE:XYZ_1' ELSE '' END
  || CASE WHEN o_orderkey % 6 = 0 THEN ' see page ' || CAST(o_custkey % 700 AS STRING) ELSE '' END AS body
FROM {orders}"""


def _hits(patterns) -> str:
    return " + ".join(f"CAST(regexp_matches(body, '(?i)' || '{p.replace(chr(39), chr(39) * 2)}') AS INT)" for p in patterns)


_SCORES = ", ".join(f"struct_pack(s := ({_hits(ps)}) * {w}::DOUBLE, r := {-i}, n := '{name}')" for i, (name, w, ps) in enumerate(ROUTER_RULES))


@query(
    "schema_router",
    f"""WITH a AS (SELECT k, unnest([{_SCORES}]) AS u FROM t), b AS (SELECT k, u.s AS s, u.r AS r, u.n AS n FROM a WHERE u.s > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, r DESC) AS p, lead(s) OVER (PARTITION BY k ORDER BY s DESC, r DESC) AS s2 FROM b)
SELECT t.k, CASE WHEN s >= 1.5 AND (s2 IS NULL OR s >= s2 + 0.75) THEN n ELSE '' END AS schema, round(coalesce(s, 0), 4) AS score FROM t LEFT JOIN c ON c.k = t.k AND p = 1""",
    t=PHRASES,
)
def schema_router(src, t):
    return t.select("k", X.route_schema(F.col("body")).alias("r")).select("k", "r.schema", F.round("r.score", 4).alias("score"))


@query(
    "jurisdiction",
    r"""WITH h AS (SELECT k, CAST(contains(lower(body), 'companies act') AS INT) + CAST(contains(lower(body), 'ind as') AS INT) + CAST(contains(body, '₹') AS INT) + CAST(regexp_matches(body, '(?i)crores?') AS INT) + CAST(regexp_matches(body, '(?i)\bcin\b') AS INT) AS i,
  CAST(regexp_matches(body, '(?i)form\s+10-?k') AS INT) + CAST(contains(lower(body), 'us-gaap') AS INT) + CAST(regexp_matches(body, '(?i)item\s+8\.') AS INT) AS u FROM t)
SELECT k, CASE WHEN i > u THEN 'IND' WHEN u > i THEN 'US' ELSE 'GLOBAL' END AS jurisdiction FROM h""",
    t=PHRASES,
)
def jurisdiction(src, t):
    return t.select("k", X.jurisdiction(F.col("body")).alias("jurisdiction"))


@query(
    "identifiers",
    r"""SELECT k, upper(regexp_extract(body, '(?i)\b([LU]\d{5}[A-Z]{2}\d{4}PLC\d{6})\b', 1)) AS cin, regexp_extract(body, '(?i)\bCIK[:\s]*(\d{6,10})\b', 1) AS cik,
  regexp_extract(body, '\bTicker[:\s]*([A-Z]{1,5})\b', 1) AS ticker, upper(regexp_extract(body, '(?i)\bNSE[:\s]*([A-Z0-9_-]{2,15})\b', 1)) AS nse_symbol FROM t""",
    t=PHRASES,
)
def identifiers(src, t):
    return t.select("k", X.identifiers(F.col("body")).alias("i")).select("k", "i.*").fillna("")


@query(
    "scale_footnote",
    r"""SELECT k, CASE WHEN regexp_matches(body, '(?i)in\s+millions?') THEN 'in millions' WHEN regexp_matches(body, '(?i)usd\s+thousands?') THEN 'usd thousands' WHEN regexp_matches(body, '(?i)in\s+thousands?') THEN 'in thousand' ELSE '' END AS footnote FROM t""",
    t=PHRASES,
)
def scale_footnote(src, t):
    return t.select("k", F.coalesce(X.scale_footnote(F.col("body")), F.lit("")).alias("footnote"))


_SIGNALS = "|".join(GRAPH_SIGNAL_PATTERNS)


@query(
    "graph_signals",
    f"""SELECT k, regexp_matches(body, '(?i)({_SIGNALS})') AS routed, length(trim(body)) >= 40 AND regexp_matches(body, '(?i)({'|'.join(GRAPH_SIGNAL_PATTERNS + GRAPH_INGEST_EXTRA_PATTERNS)})') AS ingested FROM t""",
    t=PHRASES,
)
def graph_signals(src, t):
    return t.select("k", X.graph_signal(F.col("body")).alias("routed"), X.graph_signal(F.col("body"), 40, ingest=True).alias("ingested"))


@query(
    "text_flags",
    r"""SELECT k, regexp_matches(lower(body), 'balance sheet|income statement|profit and loss|p&l|cash flow|statement of financial|bank statement|invoice|accounts payable|accounts receivable|ebitda|shareholders|retained earnings') AS financial,
  regexp_matches(lower(body), '\b(total|sum|average|avg|count|how many|aggregate|across all|overall|rollup|mean|median)\b') AS aggregation,
  coalesce(TRY_CAST(CASE WHEN TRY_CAST(regexp_extract(body, '(?i)\b(?:page|pg)\.?\s*(\d{1,3})\b', 1) AS INT) BETWEEN 1 AND 500 THEN regexp_extract(body, '(?i)\b(?:page|pg)\.?\s*(\d{1,3})\b', 1) END AS INT), 1) AS page FROM t""",
    t=PHRASES,
)
def text_flags(src, t):
    b = F.col("body")
    return t.select(
        "k", X.looks_financial(b).alias("financial"), X.is_aggregation_question(b).alias("aggregation"), X.page_number(F.lit(1), b).alias("page")
    )


@query(
    "numeric_matrix",
    r"SELECT doc_id AS k, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\b\d+[\d,]*\.?\d*\b'))) >= 2 AS matrix FROM documents",
)
def numeric_matrix(src):
    return src.table("documents").select(F.col("doc_id").alias("k"), X.has_numeric_matrix(F.col("text")).alias("matrix"))


FAILURES = """
SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '[bs.identity] Logic Error: x' WHEN 2 THEN 'No critic registered for y' WHEN 3 THEN 'value does not match' WHEN 4 THEN 'OCR returned empty'
  WHEN 5 THEN 'boom' ELSE 'closing is off' END AS error,
  CASE l_suppkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'FAILED_VERIFICATION' ELSE '' END AS status,
  CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'UNKNOWN_TABLE' ELSE 'invoices' END AS tab FROM {lineitem}"""


@query(
    "failure_class",
    r"""WITH b AS (SELECT *, lower(error || ' ' || status || ' ' || tab) AS blob FROM t)
SELECT k, CASE WHEN error = '' AND status IN ('FAILED', 'NEEDS_REVIEW') AND tab = '' THEN 'permanent' WHEN error = '' AND status = 'FAILED' THEN 'permanent'
  WHEN regexp_matches(blob, 'no critic registered|critic\.missing_|unknown_table|ocr returned empty') THEN 'permanent'
  WHEN regexp_matches(blob, 'logic error|\[bs\.|closing|does not match|hint:') THEN 'retryable' WHEN status = 'FAILED_VERIFICATION' THEN 'retryable'
  WHEN status = 'FAILED' OR tab IN ('', 'UNKNOWN_TABLE') THEN 'permanent' ELSE 'unknown' END AS class,
  CASE k % 5 WHEN 0 THEN 'initial' WHEN 1 THEN 'repair' WHEN 2 THEN 'focused_repair' ELSE 'escalated_repair' END AS tier,
  regexp_matches(lower(error || ' ' || status), 'no critic registered|unknown_table|ocr returned empty|permanent') AS dead FROM b""",
    t=FAILURES,
)
def failure_class(src, t):
    e, s, tab = F.col("error"), F.col("status"), F.col("tab")
    return t.select(
        "k", X.failure_class(e, s, tab).alias("class"), X.attempt_tier((F.col("k") % 5).cast("int")).alias("tier"),
        X.is_permanent_dead_letter(e, s, F.lit(None), F.lit(None)).alias("dead"),
    )


BLOBS = """SELECT event_id AS k, '{{"total_amount": "' || CAST(CAST(round(value * 100) AS BIGINT) AS STRING) || '", "note_x": "' || event_type || '", "cash": ' || CAST(user_id AS STRING) || ', "Cash": $1,0' || CAST(user_id % 100 AS STRING) || '}}' AS body FROM {events}"""


@query(
    "blob_numbers",
    "SELECT k, CAST(regexp_extract(body, '\"total_amount\": \"(\\d+)\"', 1) AS DOUBLE) AS total_amount, CAST(replace(regexp_extract(body, '\"Cash\": \\$([\\d,]+)', 1), ',', '') AS DOUBLE) AS cash, 2 AS keys FROM t",
    t=BLOBS,
)
def blob_numbers(src, t):
    m = X.blob_numbers(F.col("body"))
    staged = t.withColumn("m", m)
    return staged.select("k", F.col("m")["total_amount"].alias("total_amount"), F.col("m")["cash"].alias("cash"), F.size("m").alias("keys"))


XBRL = """SELECT o_orderkey AS k, '<html><ix:nonFraction contextRef="c" name="us-gaap:Revenues" scale="6"><b>' || CAST(o_custkey AS STRING) || '</b></ix:nonFraction> and <ix:nonNumeric name="dei:Name">N' || CAST(o_orderkey % 50 AS STRING) || '</ix:nonNumeric>'
  || CASE WHEN o_orderkey % 3 = 0 THEN '<ix:nonFraction name="us-gaap:Revenues">' || CAST(o_orderkey AS STRING) || '</ix:nonFraction>' ELSE '' END
  || CASE WHEN o_orderkey % 4 = 0 THEN '<ix:nonNumeric name="us-gaap:Revenues">text</ix:nonNumeric><ix:nonNumeric name="dei:Name">later</ix:nonNumeric>' ELSE '' END || '</html>' AS body FROM {orders}"""


@query(
    "ixbrl_facts",
    """SELECT k, 'Revenues' AS concept, CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) ELSE regexp_extract(body, '<b>(\\d+)</b>', 1) END AS value FROM t
UNION ALL SELECT k, 'Name', 'N' || CAST(k % 50 AS VARCHAR) FROM t""",
    t=XBRL,
)
def ixbrl_facts(src, t):
    return X.ixbrl_facts(t, "k", "body")


IND_AS = """SELECT c_custkey AS k, '<x><ind-as:RevenueFromOperations c="1">' || CAST(c_custkey * 3 AS STRING) || '</ind-as:RevenueFromOperations><in-gaap:Name> ' || c_name || ' </in-gaap:Name><ind-as:RevenueFromOperations>9</ind-as:RevenueFromOperations></x>' AS body FROM {customer}"""


@query(
    "ind_as_facts",
    "SELECT k, 'RevenueFromOperations' AS concept, CAST(k * 3 AS VARCHAR) AS value FROM t UNION ALL SELECT c_custkey, 'Name', c_name FROM customer",
    t=IND_AS,
)
def ind_as_facts(src, t):
    return X.ind_as_facts(t, "k", "body")


@query(
    "page_tag_facts",
    r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(title|h1|h2|h3)[^>]*>(.*?)</(?:title|h1|h2|h3)>', 1)) AS concept, unnest(regexp_extract_all(html, '(?is)<(title|h1|h2|h3)[^>]*>(.*?)</(?:title|h1|h2|h3)>', 2)) AS raw, generate_subscripts(regexp_extract_all(html, '(?is)<(title|h1|h2|h3)[^>]*>(.*?)</(?:title|h1|h2|h3)>', 1), 1) AS pos FROM pages),
c AS (SELECT page_id, concept, trim(regexp_replace(raw, '<[^>]+>', '', 'g')) AS value, pos FROM m)
SELECT page_id, concept, arg_min(value, pos) AS value FROM c WHERE value <> '' GROUP BY ALL""",
)
def page_tag_facts(src):
    """Title and headings of whole web pages, the first of each tag."""
    return X.tag_facts(src.table("pages"), "page_id", "html", r"(?is)<(title|h1|h2|h3)[^>]*>(.*?)</(?:title|h1|h2|h3)>")


def _last_break(mark: str) -> str:
    """SQL text: end of the last mark within the window ``w``, null unless it begins past the overlap."""
    m = "'" + mark.replace("\n", "' || chr(10) || '") + "'"
    at = f"length(w) - strpos(reverse(w), reverse({m})) - {len(mark) - 1}"
    return f"CASE WHEN strpos(w, {m}) > 0 AND {at} > {CHUNK_OVERLAP} THEN {at} + {len(mark)} END"


@query(
    "text_chunks",
    f"""WITH RECURSIVE c AS (
  SELECT doc_id, text, 0 AS s, 0 AS e, 0 AS n FROM documents
  UNION ALL
  SELECT doc_id, text, s2, s2 + CASE WHEN s2 + {CHUNK_CHARS} >= length(text) THEN length(w) ELSE coalesce({", ".join(_last_break(m) for m in CHUNK_BREAKS)}, length(w)) END, n + 1
  FROM (SELECT *, substring(text, s2 + 1, {CHUNK_CHARS}) AS w FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(s + 1, e - {CHUNK_OVERLAP}) END AS s2 FROM c WHERE e < length(text)) a) b),
t AS (SELECT doc_id, n, trim(substring(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk_text FROM c WHERE n > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_count FROM t WHERE chunk_text <> '')
SELECT d.doc_id, coalesce(chunk_count, 1)::INTEGER AS chunk_count, coalesce(chunk_index, 0)::INTEGER AS chunk_index, coalesce(chunk_text, '') AS chunk_text FROM documents d LEFT JOIN k USING (doc_id)""",
)
def text_chunks(src):
    """Whole documents in overlapping chunks."""
    return X.chunk_text(src.table("documents").select("doc_id", "text"), "text")


@query(
    "column_names",
    r"SELECT p_partkey AS k, lower(regexp_replace(regexp_replace(' ' || p_name || ' (' || p_brand || ')!', '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name, lower(regexp_replace(regexp_replace(trim(p_name || '/' || p_type), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM part",
)
def column_names(src):
    p = src.table("part")
    label = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")!"))
    return p.select(F.col("p_partkey").alias("k"), X.column_name(label).alias("name"), X.file_slug(F.concat("p_name", F.lit("/"), "p_type")).alias("slug"))


@query(
    "dispatch_routes",
    """WITH e AS (SELECT page_id, lower(regexp_extract(url, '(\\.[a-zA-Z0-9]+)(?:[?#].*)?$', 1)) AS x FROM pages)
SELECT CASE WHEN x IN ('.csv', '.xlsx', '.xls') THEN 'SPREADSHEET' WHEN x IN ('.png', '.jpg', '.jpeg') THEN 'IMAGE' WHEN x IN ('.txt', '.md', '.html') THEN 'TEXT' WHEN x IN ('.doc', '.docx', '.ppt', '.pptx') THEN 'CONVERT' ELSE 'PDF_LAYOUT' END AS route, count(*) AS pages FROM e GROUP BY 1""",
)
def dispatch_routes(src):
    from ..sources.readers import format_route

    return src.table("pages").groupBy(format_route(F.col("url")).alias("route")).agg(F.count(F.lit(1)).alias("pages"))


@query("non_blank", "SELECT doc_id AS k FROM documents WHERE trim(text) <> ''")
def non_blank(src):
    return src.table("documents").where(presence(F.trim("text")).isNotNull()).select(F.col("doc_id").alias("k"))
