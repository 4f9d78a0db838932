"""Document rules: header against lines, running balances, statements, verdicts."""

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import confidence as C
from ..operators import critic as K
from ..operators import documents as D
from ..operators import rules as R
from ..operators.segmented import running_total
from .base import ORACLES, query
from .rules import LINES, _LINE_STOP, eq

# --- invoices ----------------------------------------------------------------

INVOICE_LINES = """
SELECT l_orderkey AS k, l_linenumber AS row_index, l_extendedprice AS total_amount FROM {lineitem}"""

# Headers carry the sum of their lines; every 17th is off, every 5th has no subtotal.
INVOICE_HEADERS = """
SELECT k, 0 AS row_index,
  CASE WHEN k % 5 <> 0 THEN s END AS subtotal_amount, s AS total_amount
FROM (SELECT l_orderkey AS k, sum(l_extendedprice) + CASE WHEN l_orderkey % 17 = 0 THEN 0.01E0 * sum(l_extendedprice) ELSE 0.0E0 END AS s
      FROM {lineitem} GROUP BY l_orderkey) x"""


@query(
    "inv_header_vs_lines",
    f"""WITH s AS (SELECT k, sum(total_amount) AS line_sum FROM lines GROUP BY k)
SELECT k, CASE WHEN subtotal_amount IS NOT NULL THEN 'hard' ELSE 'soft' END AS severity,
  round(coalesce(subtotal_amount, total_amount), 2) AS expected, round(line_sum, 2) AS actual
FROM heads JOIN s USING (k) WHERE NOT {eq("line_sum", "coalesce(subtotal_amount, total_amount)")}""",
    lines=INVOICE_LINES, heads=INVOICE_HEADERS,
)
def inv_header_vs_lines(src, lines, heads):
    found = D.invoice_header_vs_lines(heads, lines, ["k"])
    return found.select("k", "severity", F.round("expected", 2).alias("expected"), F.round("actual", 2).alias("actual"))


# --- bank statements ---------------------------------------------------------

MOVES = """
SELECT user_id AS k, event_id AS row_index, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id % 41 = 0 THEN 0 ELSE 1 END AS direction
FROM {events}"""


def statement_lines(moves):
    """Deposits, withdrawals and a running balance with breaks, gaps and clashes."""
    total = running_total(moves, ["k"], "row_index", F.col("cents") * F.col("direction"), "total")
    i, amount = F.col("row_index"), F.col("cents") / 100.0
    off = F.when(i % 97 == 0, 5000.0).otherwise(0.0)
    return total.select(
        "k", "row_index",
        F.when(F.col("direction") == 1, amount).when(i % 211 == 0, 1.0).alias("deposit_amount"),
        F.when(F.col("direction") == -1, amount).when(i % 211 == 0, 2.0).alias("withdrawal_amount"),
        F.when(i % 5 != 0, F.col("total") / 100.0 + off).alias("balance"),
    )


_TX = """r AS (SELECT *, sum(cents * direction) OVER (PARTITION BY k ORDER BY row_index) / 100.0 AS total FROM moves),
tx AS (SELECT k, row_index,
  coalesce(CASE WHEN direction = 1 THEN cents / 100.0 WHEN row_index % 211 = 0 THEN 1.0 END, 0) AS dep,
  coalesce(CASE WHEN direction = -1 THEN cents / 100.0 WHEN row_index % 211 = 0 THEN 2.0 END, 0) AS wd,
  CASE WHEN row_index % 5 <> 0 THEN total + CASE WHEN row_index % 97 = 0 THEN 5000.0 ELSE 0.0 END END AS bal FROM r)"""


@query(
    "running_balance",
    f"""WITH {_TX},
p AS (SELECT *, last_value(bal IGNORE NULLS) OVER (PARTITION BY k ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  row_number() OVER (PARTITION BY k ORDER BY row_index) > 1 AS later FROM tx),
v AS (SELECT k, row_index, 0 AS seq, 'bank.tx.mutex_deposit_withdrawal' AS rule_id, 'hard' AS severity, -1.0 AS expected FROM p WHERE dep <> 0 AND wd <> 0
 UNION ALL SELECT k, row_index, 1, 'bank.tx.completeness.movement', 'soft', -1.0 FROM p WHERE dep = 0 AND wd = 0 AND bal IS NOT NULL AND later
 UNION ALL SELECT k, row_index, 2, 'bank.tx.running_balance', 'hard', prev + dep - wd FROM p WHERE NOT (dep <> 0 AND wd <> 0) AND NOT {eq("bal", "prev + dep - wd")}),
s AS (SELECT k, min(row_index * 10 + seq) AS stop FROM v WHERE severity = 'hard' GROUP BY k)
SELECT k, row_index, rule_id, severity, round(expected, 2)::DOUBLE AS expected FROM v LEFT JOIN s USING (k) WHERE stop IS NULL OR row_index * 10 + seq <= stop""",
    moves=MOVES,
)
def running_balance(src, moves):
    return balances(moves)


@query("running_balance_narrow", ORACLES["running_balance"])
def running_balance_narrow(src):
    """The same over segments of eight, so that balances are carried between many of them."""
    return balances(src.sql(MOVES), width=8)


def balances(moves, **width):
    found = D.check_transactions(statement_lines(moves), ["k"], "row_index", **width)
    return found.select("k", "row_index", "rule_id", "severity", F.round(F.coalesce("expected", F.lit(-1.0)), 2).alias("expected"))


@query(
    "bank_header_vs_tx",
    f"""WITH {_TX}, h AS (SELECT k, sum(cents * direction) / 100.0 + CASE WHEN k % 7 = 0 THEN 900.0 ELSE 0.0 END AS closing, CASE WHEN k % 5 = 0 THEN 77.5 ELSE 0.0 END AS opening FROM moves GROUP BY k),
e AS (SELECT k, arg_max(bal, row_index) FILTER (bal IS NOT NULL) AS lastb, min(row_index) AS f FROM tx GROUP BY k),
o AS (SELECT e.k, lastb, bal - dep + wd AS implied FROM e JOIN tx ON tx.k = e.k AND tx.row_index = f)
SELECT k, 'cross.bank.closing_vs_last_tx' AS rule_id, 'hard' AS severity, round(lastb, 2)::DOUBLE AS actual FROM h JOIN o USING (k) WHERE NOT {eq("closing", "lastb")}
UNION ALL SELECT k, 'cross.bank.opening_vs_first_tx', 'soft', round(implied, 2)::DOUBLE FROM h JOIN o USING (k) WHERE NOT {eq("opening", "implied")}""",
    moves=MOVES,
)
def bank_header_vs_tx(src, moves):
    lines = statement_lines(moves)
    heads = moves.groupBy("k").agg(
        (F.sum(F.col("cents") * F.col("direction")) / 100.0 + F.when(F.col("k") % 7 == 0, 900.0).otherwise(0.0)).alias("closing_balance")
    ).select("k", F.lit(0).alias("row_index"), "closing_balance", F.when(F.col("k") % 5 == 0, 77.5).otherwise(0.0).alias("opening_balance"))
    found = D.bank_header_vs_transactions(heads, lines, ["k"])
    return found.select("k", "rule_id", "severity", F.round("actual", 2).alias("actual"))


# --- statements --------------------------------------------------------------

STATEMENTS = """
SELECT o_orderkey AS k, o_totalprice AS cash, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice - 100.0E0 END AS prior,
  o_totalprice - 150.0E0 AS cf_prior, CASE WHEN o_orderkey % 6 = 0 THEN 150.0E0 ELSE 100.0E0 END AS change,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + CASE WHEN o_orderkey % 9 = 0 THEN 0.01E0 * o_totalprice ELSE 0.0E0 END END AS ending,
  50.0E0 AS is_net, CASE WHEN o_orderkey % 5 = 0 THEN 49.0E0 WHEN o_orderkey % 7 = 0 THEN NULL ELSE 50.0E0 END AS cf_net
FROM {orders}"""


@query(
    "stmt_cross_checks",
    f"""SELECT k, 'cross.stmt.cf_ending_vs_bs_cash' AS rule_id, round(cash, 2) AS expected FROM st WHERE NOT {eq("ending", "cash")}
UNION ALL SELECT k, 'cross.stmt.cf_change_vs_bs_delta', round(cash - coalesce(prior, cf_prior), 2) FROM st WHERE NOT {eq("change", "cash - coalesce(prior, cf_prior)")}
UNION ALL SELECT k, 'cross.stmt.is_vs_cf_net_income', is_net FROM st WHERE NOT {eq("is_net", "cf_net")}""",
    st=STATEMENTS,
)
def stmt_cross_checks(src, st):
    zero = F.lit(0).alias("row_index")
    bs = st.select("k", zero, F.col("cash").alias("cash_and_equivalents"), F.col("prior").alias("beginning_cash"))
    cf = st.select("k", zero, F.col("change").alias("net_change_in_cash"), F.col("cf_prior").alias("cash_at_beginning"), F.col("ending").alias("cash_at_end"), F.col("cf_net").alias("profit_for_the_period"))
    inc = st.select("k", zero, F.col("is_net").alias("net_income"))
    found = D.statement_checks(bs, inc, cf, ["k"])
    return found.select("k", "rule_id", F.round("expected", 2).alias("expected"))


# Each order is a document with rows of all seven tables; the statements come nested or as rows of their own.
BUNDLE = """
SELECT l_orderkey AS k, l_linenumber AS n, c, o_custkey % 4 = 0 AS bad_invoice, o_custkey % 5 = 0 AS bad_bank,
  o_custkey % 6 = 0 AS bad_cash, o_custkey % 7 = 0 AS bad_income, o_custkey % 2 = 0 AS nested, o_custkey % 3 = 0 AS no_subtotal
FROM (SELECT l_orderkey, l_linenumber, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x
JOIN {orders} ON l_orderkey = o_orderkey"""


@query(
    "document_bundle",
    f"""WITH s AS (SELECT k, sum(c) / 100.0 AS t, any_value(bad_invoice) AS bi, any_value(bad_bank) AS bb, any_value(bad_cash) AS bc, any_value(bad_income) AS bn, any_value(no_subtotal) AS ns,
  arg_min(c, n) / 100.0 AS first FROM b GROUP BY k),
v AS (SELECT k, 'cross.inv.header_vs_lines' AS rule_id, CASE WHEN ns THEN 'soft' ELSE 'hard' END AS severity, NOT {eq("t * 2", "t")} AS fails, bi AS bad FROM s
 UNION ALL SELECT k, 'cross.bank.closing_vs_last_tx', 'hard', NOT {eq("t * 3", "t")}, bb FROM s
 UNION ALL SELECT k, 'cross.bank.opening_vs_first_tx', 'soft', NOT {eq("t", "0")}, bb FROM s
 UNION ALL SELECT k, 'cross.stmt.cf_ending_vs_bs_cash', 'soft', NOT {eq("t * 2", "t")}, bc FROM s
 UNION ALL SELECT k, 'cross.stmt.cf_change_vs_bs_delta', 'soft', NOT {eq("t", "t * 4 / 10")}, bc FROM s
 UNION ALL SELECT k, 'cross.stmt.is_vs_cf_net_income', 'soft', NOT {eq("t", "t * 5")}, bn FROM s)
SELECT k, rule_id, severity FROM v WHERE bad AND fails""",
    b=BUNDLE,
)
def document_bundle(src, b):
    """Rows of all tables of a document, half of the statements nested in its first header."""
    text = lambda c: F.format_string("%.2f", c / 100.0)
    row = lambda **cells: F.map_from_entries(F.array(*[F.struct(F.lit(n), text(v)) for n, v in cells.items()]))
    lines = running_total(b, ["k"], "n", F.col("c"), "balance")
    flags = ["bad_invoice", "bad_bank", "bad_cash", "bad_income", "nested", "no_subtotal"]
    totals = b.groupBy("k").agg(F.sum("c").alias("t"), *[F.first(f).alias(f) for f in flags])
    t, zero = F.col("t"), F.lit(0)
    statements = {
        "standardized_balance_sheet": row(cash_and_equivalents=t, beginning_cash=zero),
        "standardized_cash_flow": row(
            net_change_in_cash=F.when(F.col("bad_cash"), F.floor(t * 4 / 10)).otherwise(t), cash_at_end=F.when(F.col("bad_cash"), 2 * t).otherwise(t),
            net_income=F.when(F.col("bad_income"), 5 * t).otherwise(t),
        ),
        "standardized_income_statement": row(net_income=t),
    }
    held = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":['), F.to_json(r), F.lit("]")) for n, r in statements.items()]), F.lit("}"))
    invoice = F.when(F.col("no_subtotal"), row(total_amount=F.when(F.col("bad_invoice"), 2 * t).otherwise(t))).otherwise(
        row(subtotal_amount=F.when(F.col("bad_invoice"), 2 * t).otherwise(t))
    )
    invoice = F.when(F.col("nested"), F.map_concat(invoice, F.create_map(F.lit("_related"), held))).otherwise(invoice)
    bank = row(opening_balance=F.when(F.col("bad_bank"), t).otherwise(zero), closing_balance=F.when(F.col("bad_bank"), 3 * t).otherwise(t))
    of = lambda table, df, data, index=F.lit(0): df.select(
        F.col("k").cast("string").alias("document_id"), F.lit(table).alias("target_table"), index.cast("long").alias("row_index"), data.alias("data")
    )
    parts = [of("vendor_invoice_headers", totals, invoice), of("bank_statement_headers", totals, bank)]
    parts += [of(n, totals.where("NOT nested"), r) for n, r in statements.items()]
    parts += [of("invoice_line_items", lines, row(amount=F.col("c")), F.col("n")),
              of("bank_statement_transactions", lines, row(deposit_amount=F.col("c"), balance=F.col("balance")), F.col("n"))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    found = K.document_violations(rows, checks=("between",))
    return found.select(F.col("document_id").cast("long").alias("k"), "rule_id", "severity")


@query(
    "document_line_rules",
    f"""WITH v AS (SELECT o, n, CASE WHEN {_LINE_STOP} THEN 'inv.line.completeness' ELSE 'inv.line.identity' END AS rule_id FROM dl
  WHERE {_LINE_STOP} OR NOT {eq("total_amount", "quantity * unit_price")})
SELECT o, n, rule_id FROM v WHERE n = (SELECT min(n) FROM v w WHERE w.o = v.o)""",
    dl="""SELECT l_orderkey AS o, min(l_linenumber) * 1000000 + l_partkey AS n, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 2.0E0 END AS quantity, 10.0E0 AS unit_price,
  CASE WHEN l_partkey % 13 = 0 THEN 25.0E0 ELSE 20.0E0 END AS total_amount FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
)
def document_line_rules(src, dl):
    """Row lists stop at a document's first hard violation."""
    found = D.check_document_rows(dl, "invoice_line_items", ["o"], "n")
    return found.select("o", "n", "rule_id")


# --- confidence and status ---------------------------------------------------

SCORED = """
SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS hard, l_linenumber % 4 AS soft,
  CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey % 2 = 0 END AS structure_ok, l_discount * 8 AS empty_ratio, l_tax * 9 AS drift_ratio,
  CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS misses, CAST(l_quantity AS INT) % 4 AS checked FROM {lineitem}"""


@query(
    "confidence_bands",
    """WITH s AS (SELECT *, CASE WHEN hard > 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - 0.12 * soft
   - CASE WHEN structure_ok IS NULL THEN 0 WHEN NOT structure_ok THEN 0.35 WHEN empty_ratio > 0.4 THEN 0.1 ELSE 0 END
   - CASE WHEN drift_ratio > 0.3 THEN least(0.25, drift_ratio * 0.5) ELSE 0 END
   - CASE WHEN checked > 0 THEN least(0.3, misses / checked * 0.4) ELSE 0 END)) END AS sc FROM t),
b AS (SELECT *, round(sc, 4) AS score FROM s), d AS (SELECT *, CASE WHEN hard > 0 THEN 'reject' WHEN score >= 0.85 AND soft = 0 THEN 'auto_promote' WHEN score >= 0.55 THEN 'review' ELSE 'reject' END AS band FROM b)
SELECT k, score::DOUBLE AS score, band, CASE band WHEN 'auto_promote' THEN 'MAPPED' WHEN 'review' THEN 'NEEDS_REVIEW' ELSE 'FAILED_VERIFICATION' END AS status FROM d""",
    t=SCORED,
)
def confidence_bands(src, t):
    c = {n: F.col(n) for n in t.columns}
    scored = t.withColumn("score", F.round(C.score(c["hard"], c["soft"], c["structure_ok"], c["empty_ratio"], c["drift_ratio"], c["misses"], c["checked"]), 4))
    banded = scored.withColumn("band", C.band(F.col("score"), c["hard"], c["soft"]))
    return banded.select("k", "score", "band", C.status_of_band(F.col("band")).alias("status"))


@query(
    "confidence_reasons",
    f"""WITH v AS (SELECT *, CASE WHEN {_LINE_STOP} THEN 'inv.line.completeness' WHEN NOT {eq("total_amount", "quantity * unit_price - coalesce(discount_amount, 0) + coalesce(tax_amount, 0)")} THEN 'inv.line.identity' END AS r, (k % 7) / 7.0 AS d FROM t)
SELECT k, CASE WHEN r IS NOT NULL THEN 'hard_critic:' || r WHEN d > 0.3 THEN concat_ws(',', printf('drift_ratio:%.2f', d),
   CASE WHEN 1 - least(0.25, d * 0.5) < 0.55 THEN 'below_review_threshold' END) ELSE '' END AS reasons,
  CASE WHEN r IS NOT NULL THEN 'reject' WHEN d <= 0.3 THEN 'auto_promote' WHEN round(1 - least(0.25, d * 0.5), 4) >= 0.85 THEN 'auto_promote' ELSE 'review' END AS band FROM v""",
    t=LINES,
)
def confidence_reasons(src, t):
    checked = R.check_rows(t, "invoice_line_items", packs={}).withColumn("drift_ratio", (F.col("k") % 7) / 7.0)
    out = C.with_confidence(checked)
    return out.select("k", F.array_join("confidence_reasons", ",").alias("reasons"), F.col("promotion_band").alias("band"))


STATUSED = """
SELECT l_orderkey AS k, l_partkey * 10 + l_linenumber AS row_index,
  CASE WHEN l_partkey % 29 = 0 THEN 'FAILED_VERIFICATION' WHEN l_partkey % 7 = 0 THEN 'NEEDS_REVIEW' WHEN l_partkey % 5 = 0 THEN NULL ELSE 'MAPPED' END AS row_status,
  CASE WHEN l_partkey % 29 = 0 THEN '[e' || CAST(l_linenumber AS STRING) || '] bad' END AS critic_error,
  CASE WHEN l_orderkey % 6 = 0 THEN 'FAILED_VERIFICATION' WHEN l_orderkey % 4 = 0 THEN 'NEEDS_REVIEW' ELSE 'MAPPED' END AS table_status
FROM {lineitem}"""


@query(
    "row_status_rollup",
    """SELECT o_orderkey AS k, count(t.k) AS row_count, CASE WHEN bool_or(row_status = 'FAILED_VERIFICATION') THEN 'FAILED_VERIFICATION'
  WHEN bool_or(row_status = 'NEEDS_REVIEW') OR count(t.k) = 0 THEN 'NEEDS_REVIEW' ELSE 'MAPPED' END AS mapping_status
FROM orders LEFT JOIN t ON t.k = o_orderkey GROUP BY o_orderkey""",
    t=STATUSED,
)
def row_status_rollup(src, t):
    tables = src.table("orders").select(F.col("o_orderkey").alias("k"))
    return C.table_status(t, ["k"], tables=tables)


@query(
    "row_routing",
    """WITH r AS (SELECT *, CASE WHEN row_status = 'FAILED_VERIFICATION' OR (table_status = 'FAILED_VERIFICATION' AND row_status IS NULL) THEN 'fail'
  WHEN row_status = 'NEEDS_REVIEW' OR (table_status = 'NEEDS_REVIEW' AND row_status IS DISTINCT FROM 'MAPPED') THEN 'review' ELSE 'pass' END AS r0 FROM t)
SELECT k, row_index, CASE WHEN table_status = 'FAILED_VERIFICATION' AND count(*) FILTER (r0 = 'fail') OVER (PARTITION BY k) = 0 THEN 'fail' ELSE r0 END AS route FROM r""",
    t=STATUSED,
)
def row_routing(src, t):
    return A.route_rows(t, ["k"]).select("k", "row_index", "route")


@query(
    "merged_errors",
    """WITH e AS (SELECT k, critic_error, min(row_index) AS f FROM t WHERE critic_error IS NOT NULL GROUP BY ALL)
SELECT k, string_agg(critic_error, '; ' ORDER BY f, critic_error) AS critic_error FROM e GROUP BY k""",
    t=STATUSED,
)
def merged_errors(src, t):
    return A.merged_errors(t, ["k"])
