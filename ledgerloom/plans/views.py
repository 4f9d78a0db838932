"""Typed views, exact rows, fall-backs, synonyms, measures, catalogs."""

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import catalog as K
from ..operators import measures as M
from ..operators import views as V
from ..registry import default_registry
from .base import grouped, money, query

REGISTRY = default_registry()
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

# One stored income statement row per order: values under varying keys.
FILINGS = f"""
SELECT o_orderkey AS id, 't' || CAST(o_custkey % 3 AS STRING) AS tenant_id, 'd' || CAST(o_custkey AS STRING) AS document_id,
  o_orderkey AS row_index, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED_VERIFICATION' WHEN o_orderkey % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'MAPPED' END AS mapping_status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'vendor_invoice_headers' WHEN o_orderkey % 7 = 0 THEN 'standardized_balance_sheet' ELSE 'standardized_income_statement' END AS target_table,
  o_orderkey % 4 AS variant, CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '(' || {grouped(_CENTS)} || ')' ELSE '$' || {grouped(_CENTS)} END AS amount,
  CASE WHEN o_orderkey % 6 = 0 THEN '-' || {money(_CENTS)} ELSE {money(_CENTS)} END AS second,
  CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS day, o_orderpriority AS label
FROM {{orders}}"""


def stored(filings):
    """The stored form: two bags per row."""
    v, amount = F.col("variant"), F.col("amount")
    key = F.when(v == 0, "total_revenue").when(v == 1, "net_sales").when(v == 2, "Total Revenue").otherwise("revenue")
    strict = F.when(v.isin(0, 2), F.create_map(key, amount, F.lit("period"), F.col("label"))).otherwise(
        F.create_map(F.lit("period"), F.col("label"), F.lit("invoice_date"), F.col("day"))
    )
    bag = F.create_map(F.lit("Net Income"), F.col("second"), F.when(v.isin(1, 3), key).otherwise(F.lit("note")), amount)
    return filings.select(
        "id", "tenant_id", F.lit("u").alias("user_id"), "document_id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"),
        "row_index", F.lit(1).alias("source_page"), F.array().cast("array<float>").alias("source_bbox"),
        "target_table", "mapping_status", strict.alias("strict"), bag.alias("unmapped"),
    )


_CLEAN = """CASE WHEN NOT regexp_matches({0}, '[0-9]') THEN NULL WHEN {0} LIKE '%(%)%' OR {0} LIKE '%-%'
  THEN -TRY_CAST(regexp_replace({0}, '[^0-9.]', '', 'g') AS DOUBLE) ELSE TRY_CAST(regexp_replace({0}, '[^0-9.]', '', 'g') AS DOUBLE) END""".format


@query(
    "registry_view",
    f"""SELECT id, tenant_id, document_id AS sys_document_id, row_index, mapping_status, {_CLEAN('amount')} AS total_revenue,
  {_CLEAN('second')} AS net_income, CASE WHEN variant IN (0, 2) THEN label ELSE label END AS period
FROM f WHERE target_table = 'standardized_income_statement'""",
    f=FILINGS,
)
def registry_view(src, f):
    view = V.registry_view(stored(f), "standardized_income_statement", REGISTRY)
    return view.select("id", "tenant_id", "sys_document_id", "row_index", "mapping_status", "total_revenue", "net_income", "period")


@query(
    "typed_dates",
    """SELECT id, CASE WHEN variant IN (1, 3) AND day <> 'unknown' THEN strftime(CAST(day AS DATE), '%Y-%m-%d') ELSE '' END AS invoice_date
FROM f WHERE target_table = 'vendor_invoice_headers'""",
    f=FILINGS,
)
def typed_dates(src, f):
    view = V.registry_view(stored(f), "vendor_invoice_headers", REGISTRY)
    return view.select("id", F.coalesce(F.date_format("invoice_date", "yyyy-MM-dd"), F.lit("")).alias("invoice_date"))


@query(
    "exact_rows",
    f"""SELECT id, sys_document_id, mapping_status, total_revenue FROM (SELECT id, document_id AS sys_document_id, mapping_status, row_index, {_CLEAN('amount')} AS total_revenue
FROM f WHERE target_table = 'standardized_income_statement' AND tenant_id = 't1' AND label = '1-URGENT')
ORDER BY CASE mapping_status WHEN 'MAPPED' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, row_index NULLS LAST, id""",
    f=FILINGS,
)
def exact_rows(src, f):
    rows = V.exact_rows(stored(f), "standardized_income_statement", REGISTRY, "t1", filters={"period": "1-URGENT"})
    return rows.select("id", "sys_document_id", "mapping_status", "total_revenue")


@query(
    "fallback_scan",
    """WITH s AS (SELECT *, CASE WHEN document_id = 'd7' AND target_table = 'corporate_subsidiaries' THEN 0
   WHEN document_id = 'd7' THEN 1 + CASE target_table WHEN 'standardized_balance_sheet' THEN 0 WHEN 'standardized_income_statement' THEN 1 WHEN 'standardized_cash_flow' THEN 2 WHEN 'vendor_invoice_headers' THEN 3 ELSE 99 END
   WHEN target_table = 'corporate_subsidiaries' THEN 1000 END AS b FROM f WHERE tenant_id = 't1')
SELECT id, target_table, document_id FROM s WHERE b = (SELECT min(b) FROM s) ORDER BY CASE mapping_status WHEN 'MAPPED' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, row_index, id""",
    f=FILINGS,
)
def fallback_scan(src, f):
    return V.fallback_rows(stored(f), "corporate_subsidiaries", "t1", "d7").select("id", "target_table", "document_id")


@query(
    "bag_rows",
    """SELECT id, coalesce(CASE WHEN variant IN (0, 2) THEN label ELSE label END, '') AS period, second AS net_income, amount FROM f WHERE tenant_id = 't2' AND target_table = 'vendor_invoice_headers'
ORDER BY CASE mapping_status WHEN 'MAPPED' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, row_index NULLS LAST, id LIMIT 200""",
    f=FILINGS,
)
def bag_rows(src, f):
    rows = V.bag_rows(stored(f), "t2", table="vendor_invoice_headers", limit=200)
    m = F.col("fields")
    amount = F.coalesce(m["total_revenue"], m["net_sales"], m["Total Revenue"], m["revenue"], m["note"])
    return rows.select("id", m["period"].alias("period"), m["Net Income"].alias("net_income"), amount.alias("amount"))


@query(
    "null_fill_donors",
    """WITH v AS (SELECT id, document_id AS g, mapping_status IN ('MAPPED', 'NEEDS_REVIEW') AS ok, CASE WHEN id % 4 = 1 THEN amount END AS a FROM f),
d AS (SELECT g, bool_or(ok) AS any_ok, arg_min(a, id) FILTER (NOT ok AND a IS NOT NULL) AS donor FROM v GROUP BY g)
SELECT id, coalesce(a, donor, '') AS a, a IS NULL AND donor IS NOT NULL AS filled FROM v JOIN d USING (g) WHERE ok OR NOT any_ok""",
    f=FILINGS,
)
def null_fill_donors(src, f):
    rows = f.select("id", "mapping_status", F.col("document_id").alias("g"), F.when(F.col("id") % 4 == 1, F.col("amount")).alias("a"))
    out = V.with_donors(rows, ["a"], group="g")
    return out.select("id", F.coalesce("a", F.lit("")).alias("a"), F.array_contains("proxy_columns", "a").alias("filled"))


METRICS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 10.5E0 END AS ebit, CASE WHEN o_orderkey % 7 = 0 THEN 20.25E0 END AS operating_income,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS total_revenue, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 0.5E0 END AS cost_of_goods_sold,
  CASE WHEN o_orderkey % 11 = 0 THEN 99.0E0 END AS gross_profit, CASE WHEN o_orderkey % 4 <> 1 THEN 30.0E0 END AS operating_expenses,
  CASE WHEN o_orderkey % 6 <> 0 THEN 60.0E0 END AS profit_before_tax, 12.0E0 AS tax_expense, CASE WHEN o_orderkey % 9 = 0 THEN 5.0E0 END AS interest_expense,
  0.0E0 AS cash_beginning_of_period, 77.0E0 AS cash_end_of_period FROM {orders}"""


@query(
    "derived_metrics",
    """SELECT id, round(coalesce(ebit, operating_income, gross_profit - operating_expenses, total_revenue - cost_of_goods_sold - operating_expenses, profit_before_tax + interest_expense, -1), 4) AS ebit,
  coalesce(CASE WHEN ebit IS NOT NULL THEN NULL WHEN operating_income IS NOT NULL THEN 'Operating Income' WHEN gross_profit - operating_expenses IS NOT NULL THEN 'Gross Profit minus Operating Expenses'
   WHEN total_revenue - cost_of_goods_sold - operating_expenses IS NOT NULL THEN 'Revenue minus COGS minus Opex' WHEN profit_before_tax + interest_expense IS NOT NULL THEN 'Profit Before Tax plus Interest Expense' END, '') AS ebit_proxy_source,
  round(coalesce(operating_income, ebit, gross_profit - operating_expenses, -1), 4) AS operating_income, round(coalesce(gross_profit, total_revenue - cost_of_goods_sold, -1), 4) AS gross_profit,
  round(coalesce(profit_before_tax - tax_expense, operating_income - coalesce(interest_expense, 0) - tax_expense, -1), 4) AS net_income, cash_end_of_period AS cash_and_equivalents FROM m""",
    m=METRICS,
)
def derived_metrics(src, m):
    d = V.derive_metrics(m)
    r = lambda c: F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c)
    return d.select("id", r("ebit"), F.coalesce("ebit_proxy_source", F.lit("")).alias("ebit_proxy_source"), r("operating_income"), r("gross_profit"), r("net_income"), "cash_and_equivalents")


@query(
    "metric_synonyms",
    """SELECT id, coalesce(CASE WHEN amount = 'n/a' THEN 'n/a' ELSE amount END, '') AS total_revenue, second AS net_income FROM f WHERE variant <> 9""",
    f=FILINGS,
)
def metric_synonyms(src, f):
    rows = stored(f).withColumn("m", V.lifted_fields(F.col("strict"), F.col("unmapped")))
    note = F.col("m")["note"]
    return rows.select("id", F.coalesce(V.metric(F.col("m"), "total_revenue"), note).alias("total_revenue"), V.metric(F.col("m"), "net_income").alias("net_income"))


@query("target_tables", "SELECT DISTINCT target_table FROM f ORDER BY 1", f=FILINGS)
def target_tables(src, f):
    return V.target_tables(stored(f))


@query(
    "distinct_tables_per_doc",
    "SELECT document_id, string_agg(DISTINCT target_table, ',' ORDER BY target_table) AS tables FROM f WHERE tenant_id = 't0' GROUP BY document_id",
    f=FILINGS,
)
def distinct_tables_per_doc(src, f):
    return K.tables_per_document(stored(f), "t0").select("document_id", F.array_join("tables", ",").alias("tables"))


# --- synonyms and drift ------------------------------------------------------

DRIFT = """
SELECT o_orderkey AS id, 't' || CAST(o_custkey % 3 AS STRING) AS tenant_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Umsatz' WHEN o_orderkey % 3 = 0 THEN ' Net Sales ' ELSE 'UMSATZ' END AS l1,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Cost of Sales' ELSE 'Unknown thing' END AS l2, CASE WHEN o_orderkey % 7 = 0 THEN '5' END AS given, CAST(o_custkey AS STRING) AS v FROM {orders}"""


VERSIONED = """
SELECT o_orderkey AS id, 't' || CAST(o_custkey % 3 AS STRING) AS tenant_id, CASE WHEN o_orderkey % 2 = 0 THEN ' Umsatz' ELSE 'Erlös' END AS label,
  CAST(o_orderdate AS TIMESTAMP) AS day, CAST(o_custkey AS STRING) AS v FROM {orders}"""
_LABELS = """
SELECT CASE WHEN c_custkey % 7 = 0 THEN 'd' WHEN c_custkey % 2 = 0 THEN 'u' ELSE 'c' END AS op, 't' || CAST(c_custkey % 3 AS STRING) AS tenant_id,
  CASE WHEN c_nationkey % 2 = 0 THEN 'umsatz' ELSE 'Erlös' END AS raw_label, CASE WHEN c_custkey % 5 < 3 THEN 'total_revenue' ELSE 'other_income' END AS mapped_column,
  CAST(make_date(1992 + CAST(c_custkey % 7 AS INT), 1 + CAST(c_nationkey % 12 AS INT), 1) AS TIMESTAMP) AS day, c_custkey AS seq FROM {customer}"""


@query(
    "synonym_versions",
    """WITH n AS (SELECT tenant_id, raw_label, day, arg_max(mapped_column, seq) AS m, arg_max(op, seq) AS op FROM labels GROUP BY ALL),
v AS (SELECT tenant_id, raw_label, day, CASE WHEN op = 'd' THEN NULL ELSE m END AS m FROM n),
j AS (SELECT d.*, v.m FROM d ASOF LEFT JOIN v ON d.tenant_id = v.tenant_id AND (CASE WHEN d.label = ' Umsatz' THEN 'umsatz' ELSE d.label END) = v.raw_label AND d.day >= v.day)
SELECT id, CASE WHEN m = 'total_revenue' THEN v ELSE '' END AS total_revenue, CASE WHEN m = 'other_income' THEN v ELSE '' END AS other,
  CASE WHEN m IS NULL THEN label ELSE '' END AS left_over FROM j""",
    d=VERSIONED,
    labels=_LABELS,
)
def synonym_versions(src, d, labels):
    """Each row is mapped by the dictionary of its own day."""
    table = F.lit("standardized_income_statement").alias("target_table")
    changes = labels.select("op", "tenant_id", table, "raw_label", "mapped_column", F.col("day").alias("at"), "seq")
    rows = d.select("id", "tenant_id", table, "day", F.create_map().cast("map<string,string>").alias("strict"), F.create_map("label", "v").alias("drift"))
    out = A.remap_drift(rows, changes, REGISTRY, aliases={"-": "-"}, at="day")
    s = lambda c, n: F.coalesce(F.col("strict")[c], F.lit("")).alias(n)
    return out.select("id", s("total_revenue", "total_revenue"), s("other_income", "other"), F.array_join(F.map_keys("drift"), ",").alias("left_over"))


@query(
    "synonym_remap",
    """WITH m AS (SELECT *, CASE WHEN lower(trim(l1)) = 'net sales' THEN 'total_revenue' WHEN tenant_id = 't0' THEN 'revenue_from_operations' WHEN tenant_id = 't1' AND l1 = 'UMSATZ' THEN 'other_income' WHEN tenant_id = 't1' THEN 'revenue_from_operations' END AS t1,
  CASE WHEN l2 = 'Cost of Sales' THEN 'cost_of_goods_sold' END AS t2 FROM d)
SELECT id, CASE WHEN given IS NOT NULL THEN given WHEN t1 = 'total_revenue' THEN v ELSE '' END AS total_revenue,
  CASE WHEN t1 = 'revenue_from_operations' THEN v ELSE '' END AS operations, CASE WHEN t1 = 'other_income' THEN v ELSE '' END AS other,
  CASE WHEN t2 IS NOT NULL THEN 'x' ELSE '' END AS cogs,
  concat_ws(',', CASE WHEN t1 IS NULL OR (t1 = 'total_revenue' AND given IS NOT NULL) THEN l1 END, CASE WHEN t2 IS NULL THEN l2 END) AS left_over FROM m""",
    d=DRIFT,
)
def synonym_remap(src, d):
    synonyms = src.spark.createDataFrame(
        [("t0", "standardized_income_statement", "Umsatz", "revenue_from_operations", 1),
         ("t1", "standardized_income_statement", "Umsatz", "revenue_from_operations", 1),
         ("t1", "standardized_income_statement", "UMSATZ", "other_income", 0)],
        "tenant_id string, target_table string, raw_label string, mapped_column string, seq int",
    )
    rows = d.select(
        "id", "tenant_id", F.lit("standardized_income_statement").alias("target_table"),
        F.create_map(F.lit("total_revenue"), F.col("given")).alias("strict"),
        F.create_map(F.col("l1"), F.col("v"), F.col("l2"), F.lit("x")).alias("drift"),
    )
    out = A.remap_drift(rows, synonyms, REGISTRY)
    s = lambda c, n: F.coalesce(F.col("strict")[c], F.lit("")).alias(n)
    return out.select(
        "id", s("total_revenue", "total_revenue"), s("revenue_from_operations", "operations"), s("other_income", "other"),
        s("cost_of_goods_sold", "cogs"), F.array_join(F.map_keys("drift"), ",").alias("left_over"),
    )


@query(
    "drift_ratio",
    """WITH n AS (SELECT id, CASE WHEN given IS NOT NULL THEN 1 ELSE 0 END AS p, CASE WHEN l1 = l2 THEN 1 ELSE 2 END AS dn FROM d)
SELECT id, p AS populated, round(dn / (dn + p), 4)::DOUBLE AS ratio FROM n""",
    d=DRIFT,
)
def drift_ratio(src, d):
    strict = F.create_map(F.lit("total_revenue"), F.col("given"), F.lit("context_scale"), F.lit("x"), F.lit("_m"), F.lit("1"))
    bag = F.create_map(F.col("l1"), F.col("v"), F.col("l2"), F.lit("x"), F.lit("row_status"), F.lit("MAPPED"))
    staged = d.withColumns({"s": strict, "b": bag})
    return staged.select("id", A.populated(F.col("s")).alias("populated"), F.round(A.drift_ratio(F.col("s"), F.col("b")), 4).alias("ratio"))


@query(
    "drifted_columns",
    """WITH k AS (SELECT tenant_id, id, 0 AS pos, l1 AS c FROM d UNION ALL SELECT tenant_id, id, 1, l2 FROM d), m AS (SELECT tenant_id, c, min(id * 10 + pos) AS f FROM k GROUP BY ALL)
SELECT tenant_id, string_agg(c, '|' ORDER BY f) AS columns FROM m GROUP BY 1""",
    d=DRIFT,
)
def drifted_columns(src, d):
    rows = d.select("tenant_id", "id", F.create_map(F.col("l1"), F.col("v"), F.col("l2"), F.lit("x")).alias("drift"))
    out = A.drifted_column_list(rows, ["tenant_id"], "id")
    return out.select("tenant_id", F.array_join("drifted_columns", "|").alias("columns"))


@query(
    "requeue_rows",
    "SELECT id AS row_id, document_id, second AS net_income, CASE WHEN variant IN (0, 2) THEN 4 - CASE WHEN false THEN 1 ELSE 0 END ELSE 4 END AS fields FROM f WHERE mapping_status = 'NEEDS_REVIEW' AND target_table = 'vendor_invoice_headers'",
    f=FILINGS,
)
def requeue_rows(src, f):
    out = A.requeue(K.waiting_rows(stored(f), "vendor_invoice_headers"))
    return out.select("row_id", "document_id", F.col("extracted_data")["Net Income"].alias("net_income"), F.size("extracted_data").alias("fields"))


@query(
    "row_patches",
    "SELECT id, CASE WHEN id % 9 = 0 THEN 'MAPPED' ELSE mapping_status END AS mapping_status, CASE WHEN id % 9 = 0 THEN 'patched' ELSE label END AS period FROM f",
    f=FILINGS,
)
def row_patches(src, f):
    rows = stored(f)
    patches = f.where("id % 9 = 0").select("id", F.create_map(F.lit("period"), F.lit("patched")).alias("updates"))
    return A.patch_rows(rows, patches, ["id"]).select("id", "mapping_status", F.col("strict")["period"].alias("period"))


# --- measures ----------------------------------------------------------------

@query(
    "measures_by_dim",
    """SELECT l_returnflag AS unit_of_measure, l_linestatus AS item_code, count(*) AS count, round(sum(l_quantity)::DECIMAL(28,4), 2)::DOUBLE AS total_quantity, round(sum(l_extendedprice::DECIMAL(28,4)), 2)::DOUBLE AS total_total_amount,
  round(sum(l_extendedprice::DECIMAL(28,4))::DOUBLE / count(l_extendedprice), 2) AS avg_total_amount FROM lineitem GROUP BY ALL""",
)
def measures_by_dim(src):
    view = src.table("lineitem").select(
        F.lit("t").alias("tenant_id"), F.col("l_returnflag").alias("unit_of_measure"), F.col("l_linestatus").alias("item_code"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("total_amount"),
    )
    cube = M.cube_of("invoice_line_items", REGISTRY["invoice_line_items"])
    out = M.measures(view, cube, ["unit_of_measure", "item_code"], ["count", "total_quantity", "total_total_amount", "avg_total_amount"], "t")
    return out.withColumns({c: F.round(c, 2) for c in ("total_quantity", "total_total_amount", "avg_total_amount")})


@query(
    "vendor_invoice_cube",
    """SELECT s_name AS vendor_name, n_name AS region, round(sum(l_extendedprice::DECIMAL(28,4)), 2)::DOUBLE AS total_line_amount, count(*) AS invoice_count
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL""",
)
def vendor_invoice_cube(src):
    view = src.table("lineitem").join(src.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        src.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("l_returnflag").alias("tenant_id"), F.col("s_name").alias("vendor_name"), F.col("n_name").alias("region"), F.col("l_extendedprice").alias("line_amount"))
    out = M.measures(view, M.VENDOR_INVOICES, ["vendor_name", "region"], tenant="R")
    return out.withColumn("total_line_amount", F.round("total_line_amount", 2))


# --- catalogs ----------------------------------------------------------------

JOBS = """
SELECT CAST(doc_id AS STRING) AS document_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 't' || CAST(doc_id % 2 AS STRING) END AS tenant_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || '.pdf' END AS filename,
  CASE WHEN doc_id % 4 = 0 THEN 'Company ' || lang END AS company_name, CASE WHEN doc_id % 5 = 0 THEN 'TCK' || CAST(doc_id % 7 AS STRING) END AS ticker, CAST(NULL AS STRING) AS fiscal_period,
  's3://b/' || CAST(doc_id AS STRING) AS s3_uri, CASE doc_id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status, n_chars AS age
FROM {documents}"""
LABELS = "SELECT CAST(doc_id AS STRING) AS document_id, 't' || CAST((doc_id + quality) % 2 AS STRING) AS tenant_id, CAST(quality AS STRING) AS q, CAST(toxic AS STRING) AS x FROM {labels}"


@query(
    "doc_catalog",
    """WITH e AS (SELECT DISTINCT document_id, tenant_id, 'C' || q AS c, 'P' || x AS p FROM lab)
SELECT coalesce(j.document_id, e.document_id) AS document_id, coalesce(j.filename, 'Document ' || coalesce(j.document_id, e.document_id)) AS filename,
  coalesce(j.company_name, e.c, '') AS company_name, coalesce(j.ticker, '') AS ticker, coalesce(e.p, '') AS fiscal_period
FROM jobs j FULL JOIN e ON j.document_id = e.document_id AND (j.tenant_id = e.tenant_id OR j.tenant_id IS NULL)
WHERE j.tenant_id = 't1' OR e.tenant_id = 't1' OR j.tenant_id IS NULL""",
    jobs=JOBS, lab=LABELS,
)
def doc_catalog(src, jobs, lab):
    rows = lab.select(
        "document_id", "tenant_id", F.create_map(F.lit("company_name"), F.concat(F.lit("C"), "q")).alias("strict"),
        F.create_map(F.lit("Period"), F.concat(F.lit("P"), "x")).alias("unmapped"),
    )
    out = K.document_catalog(jobs, rows, "t1")
    return out.fillna("", ["company_name", "ticker", "fiscal_period"])


REVIEWS = "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 't9' ELSE 't1' END AS tenant_id, CAST(doc_id AS STRING) AS document_id, CASE WHEN quality = 1 THEN 'PENDING' ELSE 'DONE' END AS status, doc_id * 7 % 1000 AS created_at, 'r' AS payload FROM {labels}"


@query(
    "review_queue",
    "SELECT r.id, r.document_id, coalesce(j.s3_uri, '') AS s3_uri FROM (SELECT * FROM rev WHERE tenant_id = 't1' AND status = 'PENDING' ORDER BY created_at DESC, id) r LEFT JOIN jobs j USING (document_id)",
    jobs=JOBS, rev=REVIEWS,
)
def review_queue(src, jobs, rev):
    return K.pending_reviews(rev, jobs, "t1").select("id", "document_id", F.coalesce("s3_uri", F.lit("")).alias("s3_uri"))


@query(
    "review_source",
    """WITH l AS (SELECT event_id AS id, 't1' AS tenant_id, CAST(user_id AS STRING) AS document_id, event_id AS created_at FROM events WHERE event_type = 'error'),
u AS (SELECT document_id, 0 AS source_rank, created_at, id FROM rev WHERE tenant_id = 't1' UNION ALL SELECT document_id, 1, created_at, id FROM l)
SELECT document_id, id, source_rank FROM u QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY source_rank, created_at, id) = 1""",
    rev=REVIEWS,
)
def review_source(src, rev):
    letters = src.table("events").where("event_type = 'error'").select(
        F.col("event_id").alias("task_id"), F.lit("t1").alias("tenant_id"), F.col("user_id").cast("string").alias("document_id"),
        F.col("event_id").alias("created_at"), F.lit("d").alias("payload"),
    )
    return K.review_source(rev, letters, "t1").select("document_id", "id", "source_rank")


@query(
    "resolved_reviews",
    "SELECT id, CASE WHEN CAST(document_id AS BIGINT) % 4 = 0 AND tenant_id = 't1' THEN 'RESOLVED' ELSE status END AS status FROM rev",
    rev=REVIEWS,
)
def resolved_reviews(src, rev):
    decisions = src.table("documents").where("doc_id % 4 = 0").select(
        F.lit("t1").alias("tenant_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("RESOLVED").alias("new_status")
    )
    return K.resolve_reviews(rev, decisions).select("id", "status")


@query(
    "discarded_reviews",
    "SELECT id FROM rev WHERE NOT (CAST(document_id AS BIGINT) % 4 = 0 AND tenant_id = 't1')",
    rev=REVIEWS,
)
def discarded_reviews(src, rev):
    decisions = src.table("documents").where("doc_id % 4 = 0").select(F.lit("t1").alias("tenant_id"), F.col("doc_id").cast("string").alias("document_id"))
    return K.resolve_reviews(rev, decisions, discard=True).select("id")


@query(
    "recent_jobs",
    "SELECT o_orderkey AS document_id, o_orderstatus AS status FROM orders WHERE o_custkey % 2 = 0 AND (o_orderstatus = 'P' OR o_orderdate > TIMESTAMP '1999-01-02 00:00:00' - INTERVAL 24 HOURS) ORDER BY o_orderdate DESC, o_orderkey",
)
def recent_jobs(src):
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise(F.col("o_orderstatus"))
    jobs = src.table("orders").select(
        F.col("o_orderkey").alias("document_id"), status.alias("status"), (F.col("o_custkey") % 2).cast("string").alias("tenant_id"),
        F.col("o_orderdate").alias("updated_at"),
    )
    out = K.recent_jobs(jobs, "0", F.to_timestamp(F.lit("1999-01-02 00:00:00")))
    return out.select("document_id", F.when(F.col("status") == "PENDING", "P").otherwise(F.col("status")).alias("status"))


@query(
    "latest_jobs",
    """SELECT user_id AS document_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS status, max(event_id) AS updated_at FROM (SELECT * FROM events) GROUP BY user_id""",
)
def latest_jobs(src):
    events = src.table("events").select(
        F.col("user_id").alias("document_id"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("status"), F.col("event_id").alias("updated_at")
    )
    return K.latest_jobs(events)


@query(
    "active_counts",
    "SELECT coalesce(tenant_id, '') AS tenant_id, count(*) FILTER (status NOT IN ('COMPLETED', 'FAILED', 'DUPLICATE')) AS active FROM jobs GROUP BY ALL",
    jobs=JOBS,
)
def active_counts(src, jobs):
    return K.active_count(jobs).select(F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "active")


@query(
    "work_list",
    "SELECT o_orderkey AS id, c_name AS agent_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey",
)
def work_list(src):
    tasks = src.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("agent_id"), F.col("o_orderstatus").alias("tenant_id"), F.col("o_orderdate").alias("updated_at"))
    agents = src.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return K.work_list(tasks, agents, "F").select("id", "agent_name")


@query(
    "task_prompts",
    "SELECT o_orderkey AS id, coalesce(c_mktsegment, '') AS system_prompt FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def task_prompts(src):
    tasks = src.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("agent_id"))
    agents = src.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("system_prompt"))
    return K.with_prompt(tasks, agents).select("id", F.coalesce("system_prompt", F.lit("")).alias("system_prompt"))


@query(
    "tenant_check",
    "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)",
)
def tenant_check(src):
    owners = src.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return K.owned(src.table("orders"), owners, ["o_custkey"]).select(F.col("o_orderkey").alias("id"))


@query(
    "claimable_tasks",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 3600 SECONDS) ORDER BY o_orderdate, o_orderkey LIMIT 25",
)
def claimable_tasks(src):
    status = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "F", "RUNNING").otherwise("DONE")
    tasks = src.table("orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("locked_at"), F.col("o_orderdate").alias("created_at"))
    return K.claimable_tasks(tasks, F.to_timestamp(F.lit("1996-01-01 00:00:00")), 3600, 25).select("id")


@query(
    "token_totals",
    "SELECT conv_id AS thread_id, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS input_tokens, coalesce(sum(length(text)) FILTER (role <> 'user'), 0)::BIGINT AS output_tokens, count(*) AS turns FROM conversations GROUP BY 1",
)
def token_totals(src):
    user = F.col("role") == "user"
    turns = src.table("conversations").select(
        F.col("conv_id").alias("thread_id"), F.when(user, F.length("text")).otherwise(0).alias("input_tokens"), F.when(~user, F.length("text")).otherwise(0).alias("output_tokens")
    )
    return K.token_totals(turns)


@query(
    "promotable_rows",
    """SELECT id, s AS target_table FROM f JOIN (SELECT DISTINCT 'standardized_balance_sheet' AS s UNION ALL SELECT 'vendor_invoice_headers') ON mapping_status = 'NEEDS_REVIEW' AND (target_table = s OR (target_table = 'UNKNOWN_TABLE'))""",
    f=FILINGS.replace("'standardized_income_statement'", "'UNKNOWN_TABLE'"),
)
def promotable_rows(src, f):
    changes = f.where("id % 2 = 0 AND target_table <> 'UNKNOWN_TABLE'").select(F.when(F.col("id") % 4 == 0, "c").otherwise("u").alias("op"), "target_table")
    return K.promotable_rows(changes, stored(f)).select("id", "target_table")


@query(
    "question_document",
    """WITH c AS (SELECT DISTINCT document_id, coalesce(company_name, '') AS c, coalesce(ticker, '') AS t, coalesce(filename, '') AS n FROM jobs)
SELECT document_id FROM c ORDER BY CASE WHEN (c <> '' AND contains('total of tck5 please', lower(c))) OR (length(t) >= 3 AND contains('total of tck5 please', lower(t))) OR (n <> '' AND contains('total of tck5 please', lower(n))) THEN 0 ELSE 1 END, document_id LIMIT 1""",
    jobs=JOBS,
)
def question_document(src, jobs):
    return K.resolve_document(jobs, "Total of TCK5 please")


@query(
    "job_retry_events",
    """SELECT document_id AS event_id, tenant_id, s3_uri, 'h' || document_id AS file_hash_sha256, filename AS original_filename
FROM jobs WHERE status = 'FAILED' AND tenant_id = 't0'""",
    jobs=JOBS,
)
def job_retry_events(src, jobs):
    """Failed jobs of a tenant as new ingest events."""
    failed = jobs.where("status = 'FAILED' AND tenant_id = 't0'").withColumn("file_hash", F.concat(F.lit("h"), "document_id"))
    events = K.retry_event(failed)
    return events.select("event_id", "tenant_id", "s3_uri", "file_hash_sha256", F.col("metadata")["original_filename"].alias("original_filename"))


@query("job_by_id", "SELECT document_id, status, filename FROM jobs WHERE tenant_id = 't1' AND document_id = '31'", jobs=JOBS)
def job_by_id(src, jobs):
    return K.job_of(jobs, "31", "t1").select("document_id", "status", "filename")


CORRECTED = """SELECT doc_id AS id, 't' || CAST(doc_id % 2 AS STRING) AS tenant_id, CASE WHEN doc_id % 3 = 0 THEN 'invoices' ELSE 'bank' END AS target_table,
  quality = 1 AS promoted, doc_id * 37 % 211 AS created_at FROM {labels}"""


@query(
    "corrections_list",
    """SELECT 'of table' AS list, id FROM c WHERE tenant_id = 't1' AND target_table = 'invoices' AND NOT promoted UNION ALL
SELECT 'of tenant', id FROM c WHERE tenant_id = 't0' UNION ALL
SELECT 'newest', id FROM (SELECT id FROM c WHERE NOT promoted ORDER BY created_at DESC, id DESC LIMIT 9)""",
    c=CORRECTED,
)
def corrections_list(src, c):
    """Corrections of a tenant and table that wait, all of a tenant, and the nine newest that wait."""
    lists = {
        "of table": K.corrections_list(c, "t1", "invoices", unpromoted=True), "of tenant": K.corrections_list(c, "t0"),
        "newest": K.unpromoted_corrections(c, limit=9),
    }
    parts = [rows.select(F.lit(name).alias("list"), "id") for name, rows in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "added_synonym",
    """SELECT id, CASE WHEN tenant_id = 't0' AND l1 IN ('Umsatz', 'UMSATZ') THEN 'other_income' WHEN lower(trim(l1)) = 'net sales' THEN 'total_revenue' ELSE '' END AS filled
FROM d WHERE given IS NULL AND l2 <> 'Cost of Sales'""",
    d=DRIFT,
)
def added_synonym(src, d):
    """A label that a user adds beats the one stored before."""
    stored_labels = src.spark.createDataFrame(
        [("t0", "standardized_income_statement", "Umsatz", "revenue_from_operations", 4)],
        "tenant_id string, target_table string, raw_label string, mapped_column string, seq int",
    )
    labels = A.add_synonym(stored_labels, "t0", "standardized_income_statement", "umsatz", "other_income")
    labels = A.add_synonym(labels, "t0", "standardized_income_statement", "Umsatz", "other_income")
    rows = d.where("given IS NULL AND l2 <> 'Cost of Sales'").select(
        "id", "tenant_id", F.lit("standardized_income_statement").alias("target_table"),
        F.create_map().cast("map<string,string>").alias("strict"), F.create_map("l1", "v").alias("drift"),
    )
    out = A.remap_drift(rows, labels, REGISTRY)
    return out.select("id", F.array_join(F.map_keys("strict"), ",").alias("filled"))


@query(
    "approved_generic",
    "SELECT id, 'GENERIC_APPROVED' AS mapping_status, 0 AS mapped FROM f WHERE mapping_status = 'NEEDS_REVIEW'",
    f=FILINGS,
)
def approved_generic(src, f):
    """Waiting rows that a reviewer stores as they are."""
    waiting = stored(f).where("mapping_status = 'NEEDS_REVIEW'")
    return A.approve_generic(waiting).select("id", "mapping_status", F.size("strict").alias("mapped"))
