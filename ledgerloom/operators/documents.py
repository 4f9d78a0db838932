"""Document-level rules: row lists, running balances, cross-table checks.

All inputs carry a document key and a row position.  Every cross-table check
reduces the rows of all its tables to one row per document in one aggregate
(partial aggregation before the shuffle), so a huge document costs one reduced
row, not a huge task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import nearly_equal, scale_multiplier
from .rules import HARD, ROW_RULES, SOFT, check_rows, long_form, violation, with_numbers
from .segmented import DEFAULT_WIDTH, carry_last

# Row lists of these schemas are read until the first hard violation.
STOP_AT_FIRST_HARD = (
    "invoice_line_items",
    "purchase_order_line_items",
    "receipt_line_items",
    "standardized_balance_sheet",
    "standardized_income_statement",
    "standardized_cash_flow",
)


def until_first_hard(found: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Violations of each document up to and including its first hard one."""
    at = F.struct(position, "seq")
    stops = found.groupBy(*keys).agg(F.min(F.when(F.col("severity") == HARD, at)).alias("_stop"))
    stops = stops.where("_stop IS NOT NULL")
    kept = found.join(stops, keys, "left").where(F.col("_stop").isNull() | (at <= F.col("_stop")))
    return kept.drop("_stop")


def check_document_rows(
    df: DataFrame, schema: str, keys: list[str], position: str, bag: str | None = None, scale: Column | None = None
) -> DataFrame:
    """Long-form violations of a schema's built-in rules over row lists.

    Messages carry the row number.  Pack rules do not apply to documents.
    """
    checked = check_rows(df, schema, bag=bag, rules=ROW_RULES.get(schema, ()), scale=scale)
    found = long_form(checked, [*keys, position]).withColumn(
        "message", F.concat(F.format_string("row %d: ", F.col(position)), F.col("message"))
    )
    return until_first_hard(found, keys, position) if schema in STOP_AT_FIRST_HARD else found


def check_transactions(
    df: DataFrame, keys: list[str], position: str, bag: str | None = None, scale: Column | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Running-balance check of bank statement lines, in long form.

    A balance must equal the last known earlier balance plus the row's
    deposit minus its withdrawal.  Reading stops at a document's first hard
    violation.
    """
    rows = with_numbers(df, ["balance", "deposit_amount", "withdrawal_amount"], bag)
    if scale is None:
        text = F.col(bag)["context_scale"] if bag else (F.col("context_scale") if "context_scale" in df.columns else None)
        scale = F.lit(1.0) if text is None else scale_multiplier(text)
    rows = rows.select(
        *keys, position,
        F.col("n_balance").alias("balance"),
        F.coalesce("n_deposit_amount", F.lit(0.0)).alias("deposit"),
        F.coalesce("n_withdrawal_amount", F.lit(0.0)).alias("withdrawal"),
        scale.alias("scale"),
        F.lit(True).alias("_row"),
    )
    rows = carry_last(rows, keys, position, {"balance": "previous", "_row": "_later"}, width=width)
    balance, deposit, withdrawal = F.col("balance"), F.col("deposit"), F.col("withdrawal")
    both = (deposit != 0) & (withdrawal != 0)
    idle = balance.isNotNull() & (deposit == 0) & (withdrawal == 0) & F.coalesce("_later", F.lit(False))
    expected = F.col("previous") + deposit - withdrawal
    broken = ~nearly_equal(balance, expected, F.col("scale"))
    row = F.format_string("row %d: ", F.col(position))
    entries = F.array_compact(
        F.array(
            F.when(both, violation(0, "bank.tx.mutex_deposit_withdrawal", HARD,
                                   F.concat(row, F.lit("Logic Error: both deposit and withdrawal")),
                                   ["deposit_amount", "withdrawal_amount"])),
            F.when(~both & idle, violation(1, "bank.tx.completeness.movement", SOFT,
                                           F.concat(row, F.lit("Logic Error: balance without deposit or withdrawal")),
                                           ["deposit_amount", "withdrawal_amount", "balance"])),
            F.when(~both & broken, violation(2, "bank.tx.running_balance", HARD,
                                             F.concat(row, F.lit("Logic Error: running balance break")),
                                             ["balance", "deposit_amount", "withdrawal_amount"], expected, balance)),
        )
    )
    found = long_form(rows.withColumn("violations", entries), [*keys, position])
    return until_first_hard(found, keys, position)


# --- cross-table -------------------------------------------------------------


class Side:
    """A table's rows with what is taken of them per document: aggregates over columns of its own.

    Columns are prefixed by ``name``, so that the rows of several tables can
    be reduced together.  Only numbers are carried, one ``min_by`` each, so
    the aggregate stays a hash aggregate.
    """

    def __init__(self, name: str, df: DataFrame, keys: list[str], position: str, fields: dict[str, Column]):
        self.name, self.at, self.parts = name, f"_{name}_at", {}
        self.rows = df.select(*keys, F.col(position).alias(self.at), *[v.alias(f"_{name}_{n}") for n, v in fields.items()])

    def col(self, field: str) -> Column:
        return F.col(f"_{self.name}_{field}")

    def first(self, out: str, field: str | None = None) -> Side:
        self.parts[out] = F.min_by(self.col(field or out), F.col(self.at))
        return self


def first_rows(df: DataFrame, keys: list[str], position: str, fields: dict[str, str], bag: str | None = None, name: str = "a", scale: str | None = None) -> Side:
    """First row of each document: ``fields`` maps output to ``a|b`` alternatives; its scale on request, under that name."""
    names = list(dict.fromkeys(n for t in fields.values() for n in t.split("|")))
    values = {out: F.coalesce(*[F.col(f"n_{n}") for n in t.split("|")]) for out, t in fields.items()}
    text = F.col(bag)["context_scale"] if bag else (F.col("context_scale") if "context_scale" in df.columns else None)
    if scale:
        values[scale] = F.lit(1.0) if text is None else scale_multiplier(text)
    side = Side(name, with_numbers(df, names, bag), keys, position, values)
    for out in values:
        side.first(out)
    return side


def reduced(keys: list[str], *sides: Side) -> DataFrame:
    """One row per document with the facts of all its tables; a table it lacks leaves nulls.

    The rows of the tables meet in one aggregate: a join of reduced tables
    would hold an aggregate and a sort of every side at once.
    """
    rows = reduce(lambda a, c: a.unionByName(c, allowMissingColumns=True), [s.rows for s in sides])
    known = reduce(lambda a, c: a & c, [F.col(k).isNotNull() for k in keys])
    return rows.where(known).groupBy(*keys).agg(*[c.alias(out) for s in sides for out, c in s.parts.items()])


def _cross(df: DataFrame, keys: list[str], entries: list[Column]) -> DataFrame:
    return long_form(df.withColumn("violations", F.array_compact(F.array(*entries))), keys)


def invoice_header_vs_lines(headers: DataFrame, lines: DataFrame, keys: list[str], position: str = "row_index", bag: str | None = None) -> DataFrame:
    """Σ line totals against the header's subtotal (hard), else its total (soft)."""
    head = first_rows(headers, keys, position, {"total": "total_amount", "subtotal": "subtotal_amount|subtotal"}, bag, "head", "scale")
    names = ["total_amount", "total_price", "amount"]
    value = F.coalesce(*[F.col(f"n_{n}") for n in names])
    line = Side("line", with_numbers(lines, names, bag), keys, position, {"value": value.cast("decimal(30,6)")})
    line.parts["line_sum"] = F.sum(line.col("value")).cast("double")
    target = F.coalesce("subtotal", "total")
    fails = target.isNotNull() & ~nearly_equal(F.col("line_sum"), target, F.col("scale"))
    severity = F.when(F.col("subtotal").isNotNull(), HARD).otherwise(SOFT)
    message = F.concat(F.lit("Logic Error: Σ line items "), F.col("line_sum").cast("string"), F.lit(" ≠ header "), target.cast("string"))
    return _cross(reduced(keys, head, line), keys, [F.when(fails, violation(0, "cross.inv.header_vs_lines", severity, message, ["total_amount", "subtotal_amount", "invoice_line_items"], target, F.col("line_sum")))])


def transaction_ends(df: DataFrame, keys: list[str], position: str, bag: str | None = None) -> Side:
    """First row's amounts and the last known balance of each statement."""
    rows = with_numbers(df, ["balance", "deposit_amount", "withdrawal_amount"], bag)
    zero = F.lit(0.0)
    side = Side("tx", rows, keys, position, {
        "balance": F.col("n_balance"), "deposit": F.coalesce("n_deposit_amount", zero), "withdrawal": F.coalesce("n_withdrawal_amount", zero),
    })
    for out, field in {"first_balance": "balance", "first_deposit": "deposit", "first_withdrawal": "withdrawal"}.items():
        side.first(out, field)
    balance = side.col("balance")
    side.parts["last_balance"] = F.max_by(balance, F.when(balance.isNotNull(), F.col(side.at)))
    return side


def bank_header_vs_transactions(headers: DataFrame, transactions: DataFrame, keys: list[str], position: str = "row_index", bag: str | None = None) -> DataFrame:
    head = first_rows(headers, keys, position, {"opening": "opening_balance|beginning_balance", "closing": "closing_balance|ending_balance"}, bag, "head", "scale")
    both = reduced(keys, head, transaction_ends(transactions, keys, position, bag))
    implied = F.col("first_balance") - F.col("first_deposit") + F.col("first_withdrawal")
    closing = ~nearly_equal(F.col("closing"), F.col("last_balance"), F.col("scale"))
    opening = ~nearly_equal(F.col("opening"), implied, F.col("scale"))
    return _cross(both, keys, [
        F.when(closing, violation(0, "cross.bank.closing_vs_last_tx", HARD, F.lit("Logic Error: closing balance ≠ last transaction balance"), ["closing_balance", "balance"], F.col("closing"), F.col("last_balance"))),
        F.when(opening, violation(1, "cross.bank.opening_vs_first_tx", SOFT, F.lit("Logic Error: opening balance inconsistent with first transaction"), ["opening_balance", "balance"], F.col("opening"), implied)),
    ])


def _balance_side(balance: DataFrame, keys: list[str], position: str, bag: str | None) -> Side:
    return first_rows(balance, keys, position, {"cash": "cash_and_equivalents", "prior": "prior_cash_and_equivalents|beginning_cash"}, bag, "bs", "bs_scale")


def _income_side(income: DataFrame, keys: list[str], position: str, bag: str | None) -> Side:
    return first_rows(income, keys, position, {"is_net": "net_income"}, bag, "is", "is_scale")


# what each check reads of the cash flow
_FOR_BALANCE = {"change": "net_change_in_cash", "begin": "beginning_cash|cash_at_beginning", "ending": "cash_at_end|ending_cash"}
_FOR_INCOME = {"cf_net": "net_income|profit_for_the_period"}


def _balance_checks() -> list[Column]:
    delta = F.col("cash") - F.coalesce("prior", "begin")
    ending = ~nearly_equal(F.col("ending"), F.col("cash"), F.col("bs_scale"))
    change = ~nearly_equal(F.col("change"), delta, F.col("bs_scale"))
    return [
        F.when(ending, violation(0, "cross.stmt.cf_ending_vs_bs_cash", SOFT, F.lit("Logic Error: cash flow ending cash ≠ balance sheet cash"), ["cash_and_equivalents", "cash_at_end"], F.col("cash"), F.col("ending"))),
        F.when(change, violation(1, "cross.stmt.cf_change_vs_bs_delta", SOFT, F.lit("Logic Error: net change ≠ change of balance sheet cash"), ["net_change_in_cash", "cash_and_equivalents"], delta, F.col("change"))),
    ]


def _income_checks(seq: int = 0) -> list[Column]:
    fails = ~nearly_equal(F.col("is_net"), F.col("cf_net"), F.col("is_scale"))
    return [F.when(fails, violation(seq, "cross.stmt.is_vs_cf_net_income", SOFT, F.lit("Logic Error: net income differs between income statement and cash flow"), ["net_income"], F.col("is_net"), F.col("cf_net")))]


def balance_vs_cash_flow(balance: DataFrame, cash: DataFrame, keys: list[str], position: str = "row_index", bag: str | None = None) -> DataFrame:
    cf = first_rows(cash, keys, position, _FOR_BALANCE, bag, "cf")
    return _cross(reduced(keys, _balance_side(balance, keys, position, bag), cf), keys, _balance_checks())


def income_vs_cash_flow(income: DataFrame, cash: DataFrame, keys: list[str], position: str = "row_index", bag: str | None = None) -> DataFrame:
    cf = first_rows(cash, keys, position, _FOR_INCOME, bag, "cf")
    return _cross(reduced(keys, _income_side(income, keys, position, bag), cf), keys, _income_checks())


def statement_checks(balance: DataFrame, income: DataFrame, cash: DataFrame, keys: list[str], position: str = "row_index", bag: str | None = None) -> DataFrame:
    """Both checks of the cash flow, against balance sheet and income statement, out of one aggregate."""
    cf = first_rows(cash, keys, position, _FOR_BALANCE | _FOR_INCOME, bag, "cf")
    facts = reduced(keys, _balance_side(balance, keys, position, bag), cf, _income_side(income, keys, position, bag))
    return _cross(facts, keys, [*_balance_checks(), *_income_checks(2)])
