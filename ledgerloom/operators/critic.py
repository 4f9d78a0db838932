"""Document-level critic: every check that a document's tables call for, dispatched by ``target_table``.

Rows are ``document_id, target_table, row_index, data map<string,string>`` and,
where a document nests rows of other tables, a JSON object under ``_related``
in the data of its first row.  All numbers of a row are parsed once.  Row
rules of all schemas are one ``CASE`` over the table name; the checks between
tables come from one aggregate per document, so there is one shuffle for all
of them and a long document costs one reduced row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FINANCIAL_SCHEMAS, GROUNDING_FIELDS
from ..functions.numerics import nearly_equal, parse_number, scale_multiplier
from .documents import STOP_AT_FIRST_HARD, check_transactions
from .rules import (
    DEFAULT_PACKS, HARD, ROW_RULES, SOFT, VIOLATIONS, Fields, compile_rules, grounding, line_items_total, long_form, nested_items,
    rule_fields, violation,
)

RELATED = "_related"
TRANSACTIONS = "bank_statement_transactions"
_NESTED = "map<string,string>"
_NESTED_ROWS = "array<map<string,string>>"


def with_parsed(rows: DataFrame) -> DataFrame:
    """Adds ``numbers`` (every cell parsed but the nested rows) and ``scale``."""
    return rows.withColumns({
        "numbers": F.transform_values("data", lambda k, v: F.when(k != RELATED, parse_number(v))),
        "scale": scale_multiplier(F.col("data")["context_scale"]),
    })


def nested_rows(rows: DataFrame) -> DataFrame:
    """Rows under ``_related`` of first rows: lists as they are, a single object as a list of one."""
    held = rows.where((F.col("row_index") == 0) & F.col("data")[RELATED].isNotNull()).select(
        "document_id", F.explode(F.from_json(F.col("data")[RELATED], _NESTED)).alias("target_table", "text")
    )
    as_list = F.when(F.col("text").startswith("{"), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    return held.select("document_id", "target_table", F.posexplode(F.from_json(as_list, _NESTED_ROWS)).alias("row_index", "data")).withColumn(
        "row_index", F.col("row_index").cast("long")
    )


def row_violations(parsed: DataFrame, rules=ROW_RULES, financial=tuple(FINANCIAL_SCHEMAS), packs=DEFAULT_PACKS) -> DataFrame:
    """Long-form violations of the built-in row rules, all schemas in one pass; financial schemas without any rule fail."""
    found = None
    for group in {id(r): r for r in rules.values()}.values():
        tables = [t for t, r in rules.items() if r is group]
        names = rule_fields(group)
        numbers = {n: F.col("numbers")[n] for n in names}
        if "line_items_total" in numbers:
            numbers["line_items_total"] = F.coalesce(numbers["line_items_total"], line_items_total(nested_items(F.col("data")["line_items"])))
        fields = Fields(numbers, {n: F.col("data")[n] for n in names}, F.col("scale"))
        entries, _ = compile_rules(group, fields)
        mine = F.array_compact(F.array(*entries)).cast(VIOLATIONS)
        found = F.when(F.col("target_table").isin(tables), mine) if found is None else found.when(F.col("target_table").isin(tables), mine)
    unchecked = [t for t in financial if t not in rules and t not in packs and t != TRANSACTIONS]
    if unchecked:
        message = F.concat(F.lit("No document critic for financial schema "), "target_table")
        missing = violation(0, "critic.missing_doc_registration", HARD, message, [])
        found = found.when(F.col("target_table").isin(unchecked) & (F.col("row_index") == 0), F.array(missing).cast(VIOLATIONS))
    listed = long_form(parsed.withColumn("violations", found), ["document_id", "target_table", "row_index"])
    listed = listed.withColumn("message", F.concat(F.format_string("row %d: ", F.col("row_index")), F.col("message")))
    # row lists are read up to their first hard violation
    at, keys = F.struct("row_index", "seq"), ["document_id", "target_table"]
    hard = listed.where(F.col("target_table").isin(list(STOP_AT_FIRST_HARD)) & (F.col("severity") == HARD))
    stops = hard.groupBy(*keys).agg(F.min(at).alias("_stop"))
    return listed.join(stops, keys, "left").where(F.col("_stop").isNull() | (at <= F.col("_stop"))).drop("_stop")


class Bundle:
    """Aggregates over a document's rows of one table; own rows count before nested ones."""

    def __init__(self):
        self.parts: dict[str, Column] = {}

    def _where(self, table: str, own: bool) -> Column:
        return (F.col("target_table") == table) & (F.col("own") == own)

    def _both(self, name: str, make) -> None:
        for own in (True, False):
            self.parts[f"{name}_{own}"] = make(own)

    def count(self, table: str) -> None:
        self._both(f"{table}_n", lambda own: F.count_if(self._where(table, own)))

    def first(self, name: str, table: str, term: str) -> None:
        """A number of the first row; ``term`` lists alternatives, ``?`` makes a missing one zero."""
        value = self._number(term)
        self._both(f"{table}.{name}", lambda own: F.min_by(value, F.when(self._where(table, own), F.col("row_index"))))

    def last(self, name: str, table: str, term: str) -> None:
        """The last number that is present."""
        value = self._number(term)
        self._both(f"{table}.{name}", lambda own: F.max_by(value, F.when(self._where(table, own) & value.isNotNull(), F.col("row_index"))))

    def total(self, name: str, table: str, term: str) -> None:
        """Exact sum, whatever the order of rows."""
        value = self._number(term).cast("decimal(30,6)")
        self._both(f"{table}.{name}", lambda own: F.sum(F.when(self._where(table, own), value)).cast("double"))

    def scale(self, table: str) -> None:
        self._both(f"{table}.scale", lambda own: F.min_by("scale", F.when(self._where(table, own), F.col("row_index"))))

    @staticmethod
    def _number(term: str) -> Column:
        names = term.rstrip("?").split("|")
        value = F.coalesce(*[F.col("numbers")[n] for n in names])
        return F.coalesce(value, F.lit(0.0)) if term.endswith("?") else value

    def get(self, table: str, name: str) -> Column:
        own = F.col(f"`{table}_n_True`") > 0
        return F.when(own, F.col(f"`{table}.{name}_True`")).otherwise(F.col(f"`{table}.{name}_False`"))

    def has(self, table: str) -> Column:
        return (F.col(f"`{table}_n_True`") + F.col(f"`{table}_n_False`")) > 0


INVOICE, LINES = "vendor_invoice_headers", "invoice_line_items"
BANK = "bank_statement_headers"
BALANCE, INCOME, CASH = "standardized_balance_sheet", "standardized_income_statement", "standardized_cash_flow"


def cross_violations(parsed: DataFrame) -> DataFrame:
    """Checks between the tables of a document; ``parsed`` has a flag ``own`` for rows that are not nested."""
    b = Bundle()
    for table in (INVOICE, LINES, BANK, TRANSACTIONS, BALANCE, INCOME, CASH):
        b.count(table)
    for table in (INVOICE, BANK, BALANCE, INCOME):
        b.scale(table)
    for table, fields in {
        INVOICE: {"total": "total_amount", "subtotal": "subtotal_amount|subtotal"},
        BANK: {"opening": "opening_balance|beginning_balance", "closing": "closing_balance|ending_balance"},
        TRANSACTIONS: {"balance": "balance", "deposit": "deposit_amount?", "withdrawal": "withdrawal_amount?"},
        BALANCE: {"cash": "cash_and_equivalents", "prior": "prior_cash_and_equivalents|beginning_cash"},
        INCOME: {"net": "net_income"},
        CASH: {"change": "net_change_in_cash", "begin": "beginning_cash|cash_at_beginning", "ending": "cash_at_end|ending_cash",
               "net": "net_income|profit_for_the_period"},
    }.items():
        for name, term in fields.items():
            b.first(name, table, term)
    b.last("last", TRANSACTIONS, "balance")
    b.total("sum", LINES, "total_amount|total_price|amount")
    facts = parsed.groupBy("document_id").agg(*[c.alias(n) for n, c in b.parts.items()])

    line_sum, subtotal = b.get(LINES, "sum"), b.get(INVOICE, "subtotal")
    header = F.coalesce(subtotal, b.get(INVOICE, "total"))
    implied = b.get(TRANSACTIONS, "balance") - b.get(TRANSACTIONS, "deposit") + b.get(TRANSACTIONS, "withdrawal")
    delta = b.get(BALANCE, "cash") - F.coalesce(b.get(BALANCE, "prior"), b.get(CASH, "begin"))
    # (tables, expected, actual, scale of, rule, severity, message, fields)
    checks = [
        ((INVOICE, LINES), header, line_sum, INVOICE, "cross.inv.header_vs_lines", F.when(subtotal.isNotNull(), HARD).otherwise(SOFT),
         "Logic Error: Σ line items ≠ header", ["total_amount", "subtotal_amount", "invoice_line_items"]),
        ((BANK, TRANSACTIONS), b.get(BANK, "closing"), b.get(TRANSACTIONS, "last"), BANK, "cross.bank.closing_vs_last_tx", HARD,
         "Logic Error: closing balance ≠ last transaction balance", ["closing_balance", "balance"]),
        ((BANK, TRANSACTIONS), b.get(BANK, "opening"), implied, BANK, "cross.bank.opening_vs_first_tx", SOFT,
         "Logic Error: opening balance inconsistent with first transaction", ["opening_balance", "balance"]),
        ((BALANCE, CASH), b.get(BALANCE, "cash"), b.get(CASH, "ending"), BALANCE, "cross.stmt.cf_ending_vs_bs_cash", SOFT,
         "Logic Error: cash flow ending cash ≠ balance sheet cash", ["cash_and_equivalents", "cash_at_end"]),
        ((BALANCE, CASH), delta, b.get(CASH, "change"), BALANCE, "cross.stmt.cf_change_vs_bs_delta", SOFT,
         "Logic Error: net change ≠ change of balance sheet cash", ["net_change_in_cash", "cash_and_equivalents"]),
        ((INCOME, CASH), b.get(INCOME, "net"), b.get(CASH, "net"), INCOME, "cross.stmt.is_vs_cf_net_income", SOFT,
         "Logic Error: net income differs between income statement and cash flow", ["net_income"]),
    ]
    entries = [
        F.when(
            b.has(tables[0]) & b.has(tables[1]) & ~nearly_equal(expected, actual, b.get(scale, "scale")),
            violation(i, rule, severity, F.lit(message), fields, expected, actual),
        )
        for i, (tables, expected, actual, scale, rule, severity, message, fields) in enumerate(checks)
    ]
    return long_form(facts.withColumn("violations", F.array_compact(F.array(*entries))), ["document_id"])


def source_violations(parsed: DataFrame, sources: DataFrame, fields: dict[str, list[str]] | None = None, severity: str = SOFT) -> DataFrame:
    """Numbers of each document's first rows that its source text does not hold.

    ``sources``: document_id, source_text; ``fields``: what to look for by
    schema (see ``rules.load_grounding``).  A source meets only the first row
    of each of its tables.
    """
    fields = GROUNDING_FIELDS if fields is None else fields
    listed = {t: names for t, names in fields.items() if names}
    first = parsed.where((F.col("row_index") == 0) & F.col("target_table").isin(list(listed)))
    met = first.join(sources.select("document_id", F.col("source_text").alias("_source")), "document_id")
    found = F.lit(None).cast(VIOLATIONS)
    for table, names in listed.items():
        numbers = Fields({n: F.col("numbers")[n] for n in names}, {n: F.col("data")[n] for n in names}, F.col("scale"))
        entries = F.array_compact(F.array(*grounding(table, numbers, F.col("_source"), 0, severity, names))).cast(VIOLATIONS)
        found = F.when(F.col("target_table") == table, entries).otherwise(found)
    return long_form(met.withColumn("violations", found), ["document_id", "row_index"])


CHECKS = ("rows", "transactions", "between", "grounding")


def document_violations(
    rows: DataFrame, financial=tuple(FINANCIAL_SCHEMAS), packs=DEFAULT_PACKS, sources: DataFrame | None = None,
    grounding_fields: dict[str, list[str]] | None = None, grounding_severity: str = SOFT, checks: tuple[str, ...] = CHECKS,
) -> DataFrame:
    """Everything wrong with each document: ``document_id, row_index`` (null between tables) and the violation.

    With ``sources`` (document_id, source_text) the first rows are also
    grounded in the text.  Who reads only some kinds of ``checks`` names them:
    the others are then not computed.
    """
    if set(checks) - set(CHECKS):
        raise ValueError(f"checks are {', '.join(CHECKS)}")
    own = with_parsed(rows.select("document_id", "target_table", F.col("row_index").cast("long").alias("row_index"), "data"))
    parts = []
    if "rows" in checks:
        parts.append(row_violations(own, financial=financial, packs=packs).drop("target_table"))
    if "transactions" in checks:
        parts.append(check_transactions(own.where(F.col("target_table") == TRANSACTIONS), ["document_id"], "row_index", bag="data"))
    if "between" in checks:
        nested = with_parsed(nested_rows(rows))
        between = cross_violations(own.withColumn("own", F.lit(True)).unionByName(nested.withColumn("own", F.lit(False))))
        parts.append(between.withColumn("row_index", F.lit(None).cast("long")))
    if "grounding" in checks and sources is not None:
        parts.append(source_violations(own, sources, grounding_fields, grounding_severity))
    if not parts:
        raise ValueError("grounding needs sources")
    return reduce(lambda a, c: a.unionByName(c), parts)
