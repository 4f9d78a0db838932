"""Records: duplicates, job state, corrections, evaluation, graph, vectors."""

from pyspark.sql import functions as F

from ..functions import ids as I
from ..operators import corrections as C
from ..operators import dedup as D
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import jobs as J
from ..operators import vector as V
from .base import money, query

# --- duplicates --------------------------------------------------------------


@query(
    "exact_dedup",
    "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents",
)
def exact_dedup(src):
    docs = D.with_content_hash(src.table("documents").select("doc_id", "text"), "text").drop("text")
    return D.flag_duplicates(docs, "file_hash", ["doc_id"], "doc_id").select("doc_id", "is_duplicate")


@query(
    "triage_routing",
    """WITH h AS (SELECT doc_id AS event_id, sha256(text) AS hash FROM documents), s AS (SELECT DISTINCT sha256(text) AS hash FROM benchmark UNION SELECT sha256(text) FROM documents WHERE doc_id % 50 = 7),
d AS (SELECT event_id, hash IN (SELECT hash FROM s) OR row_number() OVER (PARTITION BY hash ORDER BY event_id) > 1 AS dup FROM h)
SELECT event_id, CASE WHEN dup THEN 'EXACT_DUPLICATE' WHEN event_id % 6 = 0 THEN 'VERSION_UPDATE' ELSE 'NEW_DOCUMENT' END AS result, CASE WHEN dup THEN 'cleanup' ELSE 'process' END AS route FROM d""",
)
def triage_routing(src):
    docs = src.table("documents")
    events = docs.select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("tenant_id"), F.concat(F.lit("s3://b/"), F.col("doc_id").cast("string")).alias("s3_uri"),
        I.content_hash(F.col("text")).alias("file_hash_sha256"), F.create_map(F.lit("is_version_update"), (F.col("doc_id") % 6 == 0).cast("string")).alias("metadata"),
    )
    seen = src.table("benchmark").select("text").unionByName(docs.where("doc_id % 50 = 7").select("text")).select(I.content_hash(F.col("text")).alias("file_hash_sha256"))
    return D.triage(events, seen).select("event_id", "result", "route")


@query(
    "cleanup_list",
    "SELECT 's3://b/x/' || CAST(doc_id AS VARCHAR) AS s3_uri, 'b' AS bucket, 'x/' || CAST(doc_id AS VARCHAR) AS key, CAST(doc_id AS VARCHAR) AS filename FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1",
)
def cleanup_list(src):
    events = src.table("documents").select(
        F.col("doc_id").alias("event_id"), F.concat(F.lit("s3://b/x/"), F.col("doc_id").cast("string")).alias("s3_uri"),
        I.content_hash(F.col("text")).alias("file_hash_sha256"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return D.cleanup_list(D.triage(events))


@query(
    "etag_anti",
    """WITH e AS (SELECT event_id, 'e' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS etag FROM events), r AS (SELECT DISTINCT 'e' || CAST(o_orderkey AS VARCHAR) AS etag FROM orders WHERE o_orderstatus = 'F'), k AS (SELECT DISTINCT 'e' || CAST(o_orderkey AS VARCHAR) AS etag FROM orders WHERE o_orderstatus = 'P')
SELECT etag, min(event_id) AS event_id FROM e WHERE etag NOT IN (SELECT etag FROM r) AND etag NOT IN (SELECT etag FROM k) GROUP BY etag""",
)
def etag_anti(src):
    tag = lambda c: F.concat(F.lit("e"), c.cast("string")).alias("etag")
    events = src.table("events").select("event_id", tag(F.round(F.col("value") * 100).cast("long")))
    orders = src.table("orders").select("o_orderstatus", tag(F.col("o_orderkey")))
    new = D.new_etags(events, orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"))
    return D.claim_etags(new, "event_id")


@query(
    "name_uuids",
    """WITH s AS (SELECT c_custkey AS k, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('d' || CAST(c_nationkey AS VARCHAR) || '/' || c_name)) AS h FROM customer)
SELECT k, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', 1 + (strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM s""",
)
def name_uuids(src):
    c = src.table("customer")
    return c.select(F.col("c_custkey").alias("k"), I.name_uuid(F.concat(F.lit("d"), F.col("c_nationkey").cast("string")), F.col("c_name")).alias("id"))


# --- job state ---------------------------------------------------------------

STATUS = """
SELECT event_id AS seq, CAST(user_id AS STRING) AS document_id, CASE WHEN event_id % 9 = 0 THEN CAST(user_id AS STRING) ELSE 't' || CAST(user_id % 3 AS STRING) END AS tenant_id, CASE WHEN event_id % 4 = 0 THEN 'f' || CAST(event_id AS STRING) WHEN event_id % 4 = 1 THEN 'unknown' END AS filename,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status, event_type AS current_stage, CAST(NULL AS STRING) AS error_message,
  CASE WHEN event_id % 7 = 0 THEN CAST(floor(value) AS INT) % 9 END AS sql_nodes_total, CASE WHEN event_id % 11 = 0 THEN CAST(floor(value) AS INT) % 5 END AS graph_nodes_total,
  event_id % 3 = 1 AS sql_node_completed, event_id % 6 = 2 AS graph_node_completed, CASE WHEN event_id % 13 = 0 THEN 'h' || CAST(event_id AS STRING) END AS file_hash
FROM {events}"""


@query(
    "job_state_fold",
    """WITH e AS (SELECT *, sql_node_completed OR graph_node_completed AS step FROM s),
a AS (SELECT document_id, coalesce(arg_max(filename, seq) FILTER (NOT step AND filename IS NOT NULL AND filename <> 'unknown'), 'unknown') AS filename, arg_max(step, seq) AS st, arg_max(status, seq) FILTER (NOT step) AS us, arg_max(current_stage, seq) FILTER (NOT step) AS ustage,
  coalesce(arg_max(sql_nodes_total, seq) FILTER (NOT step AND sql_nodes_total IS NOT NULL), 0) AS sql_t, coalesce(arg_max(graph_nodes_total, seq) FILTER (NOT step AND graph_nodes_total IS NOT NULL), 0) AS graph_t,
  arg_max(coalesce(sql_nodes_total, graph_nodes_total, 0), seq) FILTER (NOT step) AS ann, count(*) FILTER (sql_node_completed) AS sql_c, count(*) FILTER (graph_node_completed) AS graph_c,
  coalesce(arg_max(file_hash, seq) FILTER (NOT step AND file_hash IS NOT NULL), '') AS file_hash, max(seq) AS seq FROM e GROUP BY document_id),
c AS (SELECT *, sql_c >= sql_t AND graph_c >= graph_t AND (sql_t > 0 OR graph_t > 0) AS done FROM a)
SELECT document_id, filename, file_hash, seq, sql_c AS sql_nodes_completed, graph_c AS graph_nodes_completed, CASE WHEN st THEN CASE WHEN done THEN 'COMPLETED' ELSE 'IN_PROGRESS' END ELSE coalesce(us, 'UNKNOWN') END AS status,
  CASE WHEN st AND done THEN 'Completed' WHEN st THEN printf('Ingesting (SQL: %d/%d, Graph: %d/%d)', sql_c, sql_t, graph_c, graph_t) WHEN us = 'IN_PROGRESS' AND ann > 0 THEN printf('Ingesting (SQL: 0/%d, Graph: 0/%d)', sql_t, graph_t) ELSE coalesce(ustage, 'unknown') END AS current_stage FROM c""",
    s=STATUS,
)
def job_state_fold(src, s):
    out = J.fold_jobs(s, ["seq"])
    return out.select("document_id", "filename", F.coalesce("file_hash", F.lit("")).alias("file_hash"), F.col("updated_at").alias("seq"), "sql_nodes_completed", "graph_nodes_completed", "status", "current_stage")


@query(
    "tenant_resolution",
    "SELECT seq, CASE WHEN tenant_id <> document_id THEN tenant_id WHEN seq % 2 = 0 THEN 'key' ELSE 'default-tenant' END AS tenant FROM s",
    s=STATUS,
)
def tenant_resolution(src, s):
    key = F.when(F.col("seq") % 2 == 0, "key").otherwise(F.col("document_id"))
    return s.select("seq", I.resolve_tenant(F.col("tenant_id"), F.col("document_id"), key).alias("tenant"))


@query(
    "failure_routing",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) >= 3 THEN 'dead_letter' ELSE 'retry' END AS route FROM events WHERE event_type = 'error'",
)
def failure_routing(src):
    failures = src.table("events").where("event_type = 'error'").select("user_id", "event_id")
    return J.route_failures(failures, ["user_id"], "event_id", 3)


@query(
    "upsert_rows",
    "SELECT user_id AS document_id, CAST(floor(value) AS INT) % 3 AS row_index, arg_max(event_type, event_id) AS status FROM events GROUP BY ALL",
)
def upsert_rows(src):
    from ..sources.sinks import latest_per_key

    e = src.table("events").select(F.col("user_id").alias("document_id"), (F.col("value").cast("int") % 3).alias("row_index"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    old, new = e.where("seq % 2 = 0"), e.where("seq % 2 = 1")
    return latest_per_key(old.unionByName(new), ["document_id", "row_index"], ["seq"]).drop("seq")


@query(
    "upsert_sink",
    """SELECT user_id AS document_id, CAST(floor(value) AS INT) % 3 AS row_index, arg_max(event_type, event_id) AS status,
  arg_max(event_type || '!', event_id) FILTER (WHERE event_id % 5 = 0) AS note, max(event_id) AS seq
FROM events GROUP BY ALL HAVING max(event_id) % 11 <> 0""",
)
def upsert_sink(src):
    """Batches that come out of order, a fold between them, a replay, deletions: read back as the newest rows."""
    import uuid

    from ..session import scratch_root
    from ..sources.keyed import KeyedTable

    e = src.table("events").select(
        F.col("user_id").alias("document_id"), (F.col("value").cast("int") % 3).alias("row_index"), F.col("event_type").alias("status"),
        F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit("!"))).alias("note"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 11 == 0).alias("deleted"),
    )
    path = f"{scratch_root(src.spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    table = KeyedTable(src.spark, path, ["document_id", "row_index"], ["seq"], ["note"])
    for number, part in enumerate((2, 0)):
        table.upsert(e.where(F.col("seq") % 4 == part), number)
    table.fold()
    table.upsert(e.where("seq % 4 = 0"), 1)  # replayed
    table.upsert(e.where("seq % 4 = 1"), 0, "other")
    table.upsert(e.where("seq % 4 = 3"), 2)
    return table.live()


# --- corrections -------------------------------------------------------------

EDITS = f"""
SELECT c_custkey AS id, c_mktsegment AS target_table, 't' || CAST(c_nationkey % 2 AS STRING) AS tenant_id, c_custkey * 37 % 1009 AS created_at, {money('CAST(round(c_acctbal * 100) AS BIGINT)')} AS bal, c_name AS name,
  CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_name || ' ' WHEN c_custkey % 5 = 0 THEN 'renamed' ELSE c_name END AS new_name, CASE WHEN c_custkey % 4 = 0 THEN '[bs.identity] off' WHEN c_custkey % 7 = 0 THEN '[cf.x] off' ELSE 'other' END AS critic_error, c_custkey % 6 = 0 AS added
FROM {{customer}}"""


def edited(e):
    before = F.create_map(F.lit("bal"), F.col("bal"), F.lit("name"), F.col("name"), F.lit("_x"), F.lit("1"))
    after = F.create_map(F.lit("bal"), F.col("bal"), F.lit("name"), F.col("new_name"), F.lit("_x"), F.lit("2"))
    added = F.create_map(F.lit("bal"), F.col("bal"), F.lit("name"), F.col("new_name"), F.lit("extra"), F.lit("5"))
    return e.withColumns({"before": before, "after": F.when(F.col("added"), added).otherwise(after), "drift": F.create_map(F.lit("Kontostand"), F.concat(F.lit(" "), "bal"), F.lit("note"), F.lit("zzz"))})


@query(
    "field_patches",
    """SELECT id, 'name' AS "column", name AS before, new_name AS after FROM e WHERE trim(name) <> trim(new_name) UNION ALL SELECT id, 'extra', '', '5' FROM e WHERE added""",
    e=EDITS,
)
def field_patches(src, e):
    return C.patch_rows_long(edited(e), ["id"]).fillna("", ["before"])


@query("synonym_infer", "SELECT id, 'Kontostand' AS raw_label, 'bal' AS mapped_column FROM e", e=EDITS)
def synonym_infer(src, e):
    return C.synonym_mappings(edited(e), "id").select("id", "raw_label", "mapped_column")


@query(
    "few_shot_topk",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, target_table ORDER BY created_at DESC, id) AS n FROM e), s AS (SELECT *, CASE WHEN contains(critic_error, 'bs.identity') THEN 10 ELSE 0 END AS match_score FROM r)
SELECT tenant_id, target_table, id, match_score, row_number() OVER (PARTITION BY tenant_id, target_table ORDER BY match_score DESC, n) AS rank FROM s QUALIFY rank <= 3""",
    e=EDITS,
)
def few_shot_topk(src, e):
    needles = e.select("tenant_id", "target_table").distinct().withColumn("needle", C.critic_needle(F.lit("see [bs.identity] Logic Error")))
    return C.few_shot(e, needles).select("tenant_id", "target_table", "id", "match_score", "rank")


@query(
    "golden_cells",
    """SELECT 'hitl_' || CAST(id AS VARCHAR) AS document_id, CASE WHEN trim(name) <> trim(new_name) OR added THEN CAST(trim(name) <> trim(new_name) AS INT) + CAST(added AS INT) ELSE 2 END AS cells,
  'hitl_' || lower(target_table) || '_' || CAST(id AS VARCHAR) AS file_name FROM e""",
    e=EDITS,
)
def golden_cells(src, e):
    rows = edited(e).withColumn("field_patches", C.field_patches(F.col("before"), F.col("after"))).withColumn("document_id", F.col("id").cast("string"))
    return C.to_golden(rows).select("document_id", F.size("cells").alias("cells"), "file_name")


@query("promoted_flags", "SELECT id, id % 3 = 0 OR id % 5 = 0 AS promoted FROM e", e=EDITS)
def promoted_flags(src, e):
    rows = e.withColumn("promoted", F.col("id") % 3 == 0)
    return C.mark_promoted(rows, e.where("id % 5 = 0")).select("id", "promoted")


@query(
    "review_issues",
    "SELECT id, CASE WHEN critic_error = 'other' THEN '' ELSE '(row):' || critic_error || ';' END || 'Feld:' || bal || CASE WHEN added THEN ';Zusatz:' ELSE '' END AS issues, 'Review of ' || target_table || ' with ' || CAST(CASE WHEN critic_error = 'other' THEN 1 ELSE 2 END + CASE WHEN added THEN 1 ELSE 0 END AS VARCHAR) || ' issue(s).' || CASE WHEN added THEN ' Drifted columns: Zusatz.' ELSE '' END AS summary FROM e",
    e=EDITS,
)
def review_issues(src, e):
    meta = F.when(F.col("critic_error") == "other", F.create_map(F.lit("Feld"), F.col("bal"))).otherwise(
        F.create_map(F.lit("Feld"), F.col("bal"), F.lit("critic_error"), F.col("critic_error"))
    )
    rows = e.withColumns({
        "metas": F.array(meta), "drifted": F.when(F.col("added"), F.array(F.lit("Zusatz"))).otherwise(F.array().cast("array<string>")),
        "errors": F.array().cast("array<string>"),
    })
    text = lambda i: F.concat(i["column"], F.lit(":"), F.coalesce(i["current_value"], F.when(i["column"] == "(row)", i["issue"]), F.lit("")))
    return C.review_issues(rows).select("id", F.array_join(F.transform("issues", text), ";").alias("issues"), "summary")


# --- evaluation --------------------------------------------------------------

# Goldens of six tables made from orders: c cents split into a + b.  `bad` documents break a rule,
# `flip` turns the expectation round, `off` spoils the gold cell, `lost` the predicted table.
GOLD = """
SELECT o_orderkey AS k, o_orderkey % 6 AS kind, c, CAST(floor(c / 2) AS BIGINT) AS a, c - CAST(floor(c / 2) AS BIGINT) AS b,
  o_custkey % 9 = 0 AS bad, o_custkey % 7 = 0 AS flip, o_custkey % 11 = 0 AS off, o_custkey % 10 = 0 AS lost
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM {orders}) x"""

GOLD_TABLES = [
    "vendor_invoice_headers", "bank_statement_transactions", "standardized_balance_sheet", "standardized_cash_flow", "receipt_headers", "purchase_order_headers",
]


def goldens(g):
    """Typed goldens; the wrong amounts of bad documents are whole multiples of the total."""
    k, c, a, b = F.col("kind"), F.col("c"), F.col("a"), F.col("b")
    wrong = F.when(F.col("bad"), c).otherwise(0)
    text = lambda cents: F.format_string("%.2f", cents / 100.0)
    row = lambda **cells: F.map_from_entries(F.array(*[F.struct(F.lit(n), v if n == "_related" else text(v)) for n, v in cells.items()]))
    nested = lambda table, *rows: F.concat(F.lit('{"' + table + '":['), F.concat_ws(",", *[F.to_json(r) for r in rows]), F.lit("]}"))
    none = F.lit(0)
    rows = [
        F.array(row(subtotal_amount=c, total_amount=c, _related=nested("invoice_line_items", row(total_amount=a), row(amount=b + wrong)))),
        F.array(row(deposit_amount=c, balance=5 * c), row(withdrawal_amount=a, balance=5 * c - a + 3 * wrong)),
        F.array(row(total_assets=c, total_liabilities=a, total_shareholders_equity=b + wrong)),
        F.array(row(net_cash_from_operating_activities=c, net_cash_from_investing_activities=none, net_cash_from_financing_activities=none, net_change_in_cash=c,
                    cash_at_end=3 * c, _related=nested("standardized_balance_sheet", row(cash_and_equivalents=3 * c + 6 * wrong, prior_cash_and_equivalents=2 * c)))),
        F.array(row(subtotal=a + wrong, tax_amount=b, total_amount=c)),
        F.array(row(subtotal_amount=a + wrong, tax_amount=b, total_value=c)),
    ]
    names = [(0, "total_amount"), (1, "balance"), (0, "total_assets"), (0, "cash_at_end"), (0, "total_amount"), (0, "total_value")]
    by = lambda parts: F.element_at(F.array(*[F.lit(p) if isinstance(p, (str, int)) else p for p in parts]), (k + 1).cast("int"))
    index, column = by([n[0] for n in names]), by([n[1] for n in names])
    extracted = rows[-1]
    for i, r in enumerate(rows[:-1]):
        extracted = F.when(k == i, r).otherwise(extracted)
    predicted = F.get(extracted, index)[column]
    cell = F.struct(
        index.cast("int").alias("row_index"), column.alias("column"),
        F.when(F.col("off"), F.concat(F.lit("1"), predicted)).otherwise(predicted).alias("value"), F.lit(0.01).alias("tolerance"),
    )
    relation = F.struct(F.lit("sum_equals").alias("type"), F.lit("total_assets").alias("left"), F.lit("total_liabilities").alias("right"))
    fails, table = F.col("bad") != F.col("flip"), by(GOLD_TABLES)
    return g.select(
        F.col("k").cast("string").alias("document_id"), table.alias("target_table"),
        F.when(F.col("lost"), "utility_bills").otherwise(table).alias("predicted_table"), extracted.alias("extracted_rows"), F.array(cell).alias("cells"),
        F.when(k == 2, F.array(relation)).otherwise(F.array().cast("array<struct<type:string,left:string,right:string>>")).alias("relations"),
        (fails & (k != 3)).alias("expect_fail"), (fails & (k == 3)).alias("expect_soft"),
    )


_GOLD_ROWS = """o AS (SELECT *, CASE WHEN kind = 3 THEN NOT (flip AND NOT bad) ELSE NOT flip END AS critic_ok, bad = flip AS scored FROM g),
d AS (SELECT *, CASE WHEN scored THEN 1 + CASE WHEN kind = 2 THEN 1 ELSE 0 END ELSE 0 END AS total,
  CASE WHEN scored THEN CASE WHEN off THEN 0 ELSE 1 END + CASE WHEN kind = 2 AND critic_ok THEN 1 ELSE 0 END ELSE 0 END AS matched FROM o)"""


@query("cell_matches", 'SELECT k, NOT off AS match FROM g WHERE bad = flip', g=GOLD)
def cell_matches(src, g):
    return E.match_cells(goldens(g)).select(F.col("document_id").cast("long").alias("k"), "match")


@query(
    "golden_documents",
    f"""WITH {_GOLD_ROWS}
SELECT k, critic_ok, NOT lost AS schema_ok, CASE WHEN bad AND kind <> 3 THEN 1 ELSE 0 END::BIGINT AS hard, CASE WHEN bad AND kind = 3 THEN 2 ELSE 0 END::BIGINT AS soft,
  total::BIGINT AS cells_total, matched::BIGINT AS cells_matched FROM d""",
    g=GOLD,
)
def golden_documents(src, g):
    out = E.evaluated(goldens(g))
    return out.select(F.col("document_id").cast("long").alias("k"), "critic_ok", "schema_ok", "hard", "soft", "cells_total", "cells_matched")


@query(
    "eval_summary",
    f"""WITH {_GOLD_ROWS}
SELECT count(*) AS documents, sum(matched)::BIGINT AS cells_matched, sum(total)::BIGINT AS cells_total, round(sum(matched) / sum(total), 6) AS cell_accuracy,
  round(count(*) FILTER (critic_ok) / count(*), 6) AS critic_pass_rate, round(count(*) FILTER (NOT lost) / count(*), 6) AS schema_accuracy FROM d""",
    g=GOLD,
)
def eval_summary(src, g):
    """Six tables: running balances, nested lines and statements, identities, totals."""
    return E.summary(E.evaluated(goldens(g)))


# --- graph -------------------------------------------------------------------

TRIPLES = """
SELECT l_orderkey AS seq, 't' || CAST(l_linenumber % 2 AS STRING) AS tenant_id, CASE WHEN l_partkey % 17 = 0 THEN ' The company. ' ELSE s_name || CASE WHEN l_partkey % 2 = 0 THEN '.,' ELSE '' END END AS subject,
  CASE l_partkey % 4 WHEN 0 THEN 'owns' WHEN 1 THEN 'has-subsidiary' WHEN 2 THEN 'director of' ELSE 'audits' END AS predicate, CASE WHEN l_partkey % 13 = 0 THEN s_name ELSE n_name END AS object,
  'd' || CAST(l_orderkey % 100 AS STRING) AS document_id, l_linenumber AS source_page FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"""

_CLEAN = """c AS (SELECT tenant_id, upper(trim(regexp_replace(trim(subject), '[\\s.,]+$', ''))) AS s, upper(translate(predicate, ' -', '__')) AS p, upper(trim(object)) AS o, seq, document_id, source_page FROM t),
k AS (SELECT * FROM c WHERE s NOT IN ('THE COMPANY', 'COMPANY') AND length(s) >= 3 AND s <> o)"""


@query(
    "graph_merge",
    f"WITH {_CLEAN} SELECT tenant_id, s AS subject, p AS predicate, o AS object, max(seq) AS seq FROM k GROUP BY ALL",
    t=TRIPLES,
)
def graph_merge(src, t):
    return G.merge_edges(G.clean_triples(t)).select("tenant_id", "subject", "predicate", "object", "seq")


@query("graph_entities", f"WITH {_CLEAN} SELECT DISTINCT tenant_id, s AS name FROM k UNION SELECT DISTINCT tenant_id, o FROM k", t=TRIPLES)
def graph_entities(src, t):
    return G.entities(G.clean_triples(t))


@query("graph_ontology", f"WITH {_CLEAN} SELECT p AS predicate, count(*) AS edges FROM (SELECT DISTINCT tenant_id, s, p, o FROM k) GROUP BY p", t=TRIPLES)
def graph_ontology(src, t):
    return G.ontology(G.merge_edges(G.clean_triples(t)))


for _name, _types, _side in (
    ("subsidiaries", "'OWNS', 'HAS_SUBSIDIARY'", "s"), ("parent_company", "'OWNS', 'HAS_SUBSIDIARY'", "o"),
    ("key_personnel", "'DIRECTOR_OF', 'CEO_OF'", "o"), ("auditors", "'AUDITS'", "o"),
):
    def _hop(src, t, name=_name, side=_side):
        word = "supplier#00000000" if side == "s" else "nation_1"
        return G.one_hop(G.merge_edges(G.clean_triples(t)), name, "t1", word)

    query(
        f"graph_{_name}",
        f"WITH {_CLEAN} SELECT DISTINCT s AS subject, p AS predicate, o AS object FROM k WHERE tenant_id = 't1' AND p IN ({_types}) AND contains(lower({_side}), '{'supplier#00000000' if _side == 's' else 'nation_1'}')",
        t=TRIPLES,
    )(_hop)


@query(
    "graph_relationships",
    f"WITH {_CLEAN}, u AS (SELECT DISTINCT s, p, o FROM k WHERE tenant_id = 't1'), b AS (SELECT s, p, o FROM u UNION ALL SELECT o, p, s FROM u) SELECT s AS subject, p AS predicate, o AS object FROM b WHERE contains(lower(s), 'nation_2')",
    t=TRIPLES,
)
def graph_relationships(src, t):
    return G.one_hop(G.merge_edges(G.clean_triples(t)), "relationships", "t1", "Nation_2", limit=None)


@query(
    "graph_correction",
    f"WITH {_CLEAN} SELECT DISTINCT tenant_id, s AS subject, CASE WHEN p = 'AUDITS' AND tenant_id = 't0' THEN 'STATUTORY_AUDITOR' ELSE p END AS predicate, o AS object FROM k",
    t=TRIPLES,
)
def graph_correction(src, t):
    edges = G.merge_edges(G.clean_triples(t))
    fixes = edges.where("tenant_id = 't0' AND predicate = 'AUDITS'").withColumn("new_predicate", F.lit("STATUTORY_AUDITOR"))
    return G.correct_edges(edges, fixes).select("tenant_id", "subject", "predicate", "object")


@query(
    "graph_neighbours",
    f"WITH {_CLEAN}, u AS (SELECT DISTINCT tenant_id, s, p, o FROM k) SELECT tenant_id, s AS subject, p AS predicate, o AS object, row_number() OVER (PARTITION BY tenant_id, s ORDER BY p, o) AS rank FROM u QUALIFY rank <= 2",
    t=TRIPLES,
)
def graph_neighbours(src, t):
    return G.top_neighbours(G.merge_edges(G.clean_triples(t)), 2).select("tenant_id", "subject", "predicate", "object", "rank")


@query(
    "first_triples",
    "SELECT o_custkey AS d, o_orderkey AS n FROM orders",
)
def first_triples(src):
    """All triples of every block."""
    return G.first_triples(triple_blocks(src)).select("d", "n")


@query(
    "first_triples_of_block",
    "SELECT o_custkey AS d, o_orderkey AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) <= 5",
)
def first_triples_of_block(src):
    """The first five of every block, as asked."""
    return G.first_triples(triple_blocks(src), limit=5).select("d", "n")


def triple_blocks(src):
    return src.table("orders").groupBy(F.col("o_custkey").alias("d"), "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("n")))).alias("triples"))


# --- vectors -----------------------------------------------------------------

QUERY_VECTOR = [1.0 if i % 3 == 0 else (-0.5 if i % 3 == 1 else 0.25) for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"


@query(
    "vector_topk",
    f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 4) AS score FROM embeddings WHERE label % 2 = 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 50",
)
def vector_topk(src):
    points = src.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") % 2).cast("string").alias("tenant_id"))
    return V.top_k(points, QUERY_VECTOR, tenant="0").select("id", F.round("score", 4).alias("score"))


@query(
    "vector_topk_document",
    f"SELECT vec_id AS id FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 50",
)
def vector_topk_document(src):
    points = src.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("t").alias("tenant_id"), F.col("label").cast("string").alias("document_id"))
    return V.top_k(points, QUERY_VECTOR, tenant="t", document="3").select("id")


@query(
    "vector_topk_batch",
    """WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label)
SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS rank FROM embeddings, q QUALIFY rank <= 5""",
)
def vector_topk_batch(src):
    e = src.table("embeddings")
    queries = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    points = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.top_k_batch(points, queries, 5).select("query_id", "id", "rank")


@query(
    "keyword_rerank",
    """WITH c AS (SELECT doc_id AS id, text, n_chars / 7 % 101 AS s FROM documents )
SELECT id, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'ion') AS INT) + CAST(contains(lower(text), 'ebit') AS INT) * 3)::DOUBLE AS keyword_score FROM c ORDER BY keyword_score DESC, s DESC, id LIMIT 5""",
)
def keyword_rerank(src):
    candidates = src.table("documents").select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") / 7 % 101).alias("score"))
    return V.rerank(candidates, "the of ion").select("id", "keyword_score")


@query(
    "vector_default",
    "SELECT doc_id AS k, coalesce(round(embedding[1]::DOUBLE, 4), round(1e-5, 4)) AS first, vec_id IS NULL AS is_default FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE trim(text) <> ''",
)
def vector_default(src):
    nodes = src.table("documents").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("document_id"), F.lit("n").alias("node_id"), F.lit("TEXT").alias("type"), F.col("text").alias("content"))
    vectors = src.table("embeddings").select(F.col("vec_id").cast("string").alias("document_id"), F.lit("n").alias("node_id"), F.col("embedding").alias("vector"))
    out = V.with_vectors(nodes, vectors)
    return out.select("k", F.round(F.col("vector")[0].cast("double"), 4).alias("first"), (F.size("vector") == 384).alias("is_default"))
