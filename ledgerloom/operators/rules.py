"""Quality rules as declarations that compile to one ``Column`` each.

A rule names fields; compiling it over parsed number columns gives a
violation struct or null.  A row's violations are the non-null entries of one
array, so a whole rule set is a single projection: no UDF and no shuffle.

A field may list alternatives (``"subtotal_amount|subtotal"``: the first that
parses).  A trailing ``?`` makes a term optional: missing counts as zero.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import FINANCIAL_SCHEMAS, GROUNDING_FIELDS
from ..functions.hof import presence
from ..functions.numerics import grounded_in, minimum_tolerance, nearly_equal, parse_number, scale_multiplier

HARD, SOFT = "hard", "soft"

VIOLATION = (
    "struct<seq:int,rule_id:string,severity:string,message:string,fields:array<string>,"
    "expected:double,actual:double,delta:double,hint:string>"
)
VIOLATIONS = f"array<{VIOLATION}>"


@dataclass(frozen=True)
class Rule:
    """One declared check.

    kind: complete | equals | product | at_most | bounds | mutex | ratio_text
    """

    id: str
    kind: str
    left: str = ""
    plus: tuple[str, ...] = ()
    minus: tuple[str, ...] = ()
    factors: tuple[str, ...] = ()
    require: tuple[str, ...] = ()
    trigger: tuple[str, ...] = ()
    any_of: tuple[tuple[str, ...], ...] = ()
    low: float | None = None
    high: float | None = None
    strict: bool = False
    slack: str = "fixed"
    nonzero: bool = False
    or_plus: tuple[str, ...] = ()
    exactly_one_with: str = ""
    skip_if: tuple[str, ...] = ()
    severity: str = HARD
    stop: bool = False
    hint: str = ""
    fields: tuple[str, ...] = field(default=())

    def names(self) -> list[str]:
        """Every field the rule reads, alternatives included."""
        terms = [self.left, *self.plus, *self.minus, *self.factors, *self.require, *self.trigger]
        terms += [*self.or_plus, *self.skip_if, *self.fields, self.exactly_one_with]
        terms += [t for group in self.any_of for t in group]
        out: list[str] = []
        for term in terms:
            for name in term.rstrip("?").split("|"):
                if name and name not in out:
                    out.append(name)
        return out


def complete(id: str, require: list[str], trigger: list[str] | None = None, stop: bool = True, **kw) -> Rule:
    return Rule(id, "complete", require=tuple(require), trigger=tuple(trigger or require), stop=stop, **kw)


def equals(id: str, left: str, plus: list[str], minus: list[str] | None = None, **kw) -> Rule:
    return Rule(id, "equals", left=left, plus=tuple(plus), minus=tuple(minus or ()), **kw)


def product(id: str, left: str, factors: list[str], minus: list[str] | None = None, plus: list[str] | None = None, **kw) -> Rule:
    return Rule(id, "product", left=left, factors=tuple(factors), minus=tuple(minus or ()), plus=tuple(plus or ()), **kw)


def at_most(id: str, plus: list[str], left: str, slack: str = "fixed", **kw) -> Rule:
    return Rule(id, "at_most", left=left, plus=tuple(plus), slack=slack, **kw)


def bounds(id: str, fields: list[str], low=None, high=None, **kw) -> Rule:
    return Rule(id, "bounds", fields=tuple(fields), low=low, high=high, **kw)


def mutex(id: str, fields: list[str], **kw) -> Rule:
    return Rule(id, "mutex", fields=tuple(fields), **kw)


# --- the built-in rules ------------------------------------------------------

BALANCE_SHEET = (
    complete("bs.completeness.identity_fields", ["total_assets", "total_liabilities", "total_shareholders_equity"]),
    equals("bs.identity.assets_eq_l_plus_e", "total_assets", ["total_liabilities", "total_shareholders_equity"]),
    at_most("bs.bounds.current_assets_components", ["cash_and_equivalents", "accounts_receivable", "inventory"], "total_current_assets", slack="scaled"),
    at_most("bs.bounds.current_liabilities_components", ["accounts_payable", "short_term_debt"], "total_current_liabilities", slack="scaled"),
    bounds("bs.bounds.assets_non_negative", ["total_assets"], low=0),
)

INCOME_STATEMENT = (
    Rule("is.completeness.total_revenue", "complete", require=("total_revenue", "revenue_from_operations"), trigger=("total_revenue", "revenue_from_operations"), exactly_one_with="other_income"),
    complete("is.completeness.gross_profit", ["cost_of_goods_sold"], ["gross_profit"], any_of=(("total_revenue", "revenue_from_operations"),)),
    complete("is.completeness.net_income", ["net_income", "profit_before_tax", "tax_expense"], ["net_income"]),
    equals("is.identity.total_revenue", "total_revenue", ["revenue_from_operations", "other_income?"]),
    equals("is.identity.gross_profit", "gross_profit", ["total_revenue|revenue_from_operations"], ["cost_of_goods_sold"], or_plus=("revenue_from_operations",)),
    equals("is.identity.operating_expenses", "operating_expenses", ["sg_and_a_expenses", "r_and_d_expenses"]),
    equals("is.identity.ebit", "ebit", ["ebitda"], ["depreciation_and_amortization"]),
    equals("is.identity.pbt", "profit_before_tax", ["ebit"], ["interest_expense"]),
    equals("is.identity.net_income", "net_income", ["profit_before_tax"], ["tax_expense"]),
)

_FLOWS = ["net_cash_from_operating_activities", "net_cash_from_investing_activities", "net_cash_from_financing_activities"]
CASH_FLOW = (
    complete("cf.completeness.net_change", ["net_change_in_cash", *_FLOWS], ["net_change_in_cash"]),
    equals("cf.identity.net_change", "net_change_in_cash", _FLOWS),
)

_OPEN, _CLOSE = "opening_balance|beginning_balance", "closing_balance|ending_balance"
BANK_HEADER = (
    complete("bank.completeness.header_balances", [_OPEN, _CLOSE, "total_deposits", "total_withdrawals"], [_OPEN, _CLOSE]),
    equals("bank.identity.closing_balance", _CLOSE, [_OPEN, "total_deposits", "total_interest?"], ["total_withdrawals", "total_fees?"]),
)

_SUB = "subtotal_amount|subtotal"
INVOICE_HEADER = (
    complete("inv.completeness.subtotal", [f"{_SUB}|line_items_total"], ["total_amount"]),
    equals("inv.identity.line_sum", "line_items_total", ["total_amount"]),
    equals("inv.identity.total", "total_amount", [_SUB, "tax_amount?", "shipping_amount?"], ["discount_amount?"]),
    equals("inv.identity.amount_due", "amount_due", ["total_amount"], ["amount_paid?"]),
)

_LINE = "total_amount|total_price|amount"
LINE_ITEM = (
    complete("inv.line.completeness", ["quantity", "unit_price"], [_LINE]),
    product("inv.line.identity", _LINE, ["quantity", "unit_price"], minus=["discount_amount?"], plus=["tax_amount?"]),
)

_PO = "total_value|total_amount"
PURCHASE_ORDER = (
    complete("po.completeness.subtotal", ["subtotal_amount"], [_PO]),
    equals("po.identity.total", _PO, ["subtotal_amount", "tax_amount?"]),
)

RECEIPT = (equals("receipt.identity.total", "total_amount", ["subtotal|subtotal_amount?", "tax_amount?"]),)

TAX_FORM = (
    at_most("tax.bounds.ss_vs_medicare", ["social_security_wages"], "medicare_wages"),
    at_most("tax.bounds.state_tax", ["state_income_tax"], "state_wages"),
    at_most("tax.bounds.agi", ["adjusted_gross_income"], "total_income"),
    at_most("tax.bounds.taxable", ["taxable_income"], "adjusted_gross_income"),
    mutex("tax.mutex.owed_refund", ["amount_owed", "refund_amount"]),
)

UTILITY_BILL = (equals("utility.identity.amount_due", "total_amount_due", ["previous_balance?", "new_charges?"], ["payments_received?"]),)
PAY_STUB = (equals("paystub.identity.net", "net_pay", ["gross_pay?"], ["total_taxes?", "total_deductions?"]),)
CLINICAL = (bounds("clinical.bounds.heart_rate", ["heart_rate"], low=0, high=300, strict=True),)
LAB = (Rule("lab.bounds.blood_pressure", "ratio_text", left="blood_pressure"),)

ROW_RULES: dict[str, tuple[Rule, ...]] = {
    "standardized_balance_sheet": BALANCE_SHEET,
    "standardized_income_statement": INCOME_STATEMENT,
    "standardized_cash_flow": CASH_FLOW,
    "bank_statement_headers": BANK_HEADER,
    "vendor_invoice_headers": INVOICE_HEADER,
    "invoice_line_items": LINE_ITEM,
    "purchase_order_headers": PURCHASE_ORDER,
    "purchase_order_line_items": LINE_ITEM,
    "receipt_headers": RECEIPT,
    "receipt_line_items": LINE_ITEM,
    "tax_form_headers": TAX_FORM,
    "utility_bills": UTILITY_BILL,
}

# A schema outside the table above is matched by the first word it contains.
KEYWORD_RULES: dict[str, tuple[Rule, ...]] = {
    "invoice": INVOICE_HEADER,
    "bank": BANK_HEADER,
    "statement": BANK_HEADER,
    "receipt": RECEIPT,
    "w2": TAX_FORM,
    "tax": TAX_FORM,
    "paystub": PAY_STUB,
    "payroll": PAY_STUB,
    "clinical": CLINICAL,
    "lab": LAB,
    "result": LAB,
}

DEFAULT_PACKS: dict[str, tuple[Rule, ...]] = {
    "bank_statement_headers": (
        complete("pack.bank.completeness.header_balances", ["opening_balance", "closing_balance", "total_deposits", "total_withdrawals"], ["opening_balance", "closing_balance"]),
    ),
    "standardized_balance_sheet": (
        complete("pack.bs.completeness.identity_fields", ["total_assets", "total_liabilities", "total_shareholders_equity"]),
        equals("pack.bs.identity.assets_eq_l_plus_e", "total_assets", ["total_liabilities", "total_shareholders_equity"]),
        bounds("pack.bs.bounds.assets_non_negative", ["total_assets"], low=0),
    ),
    "standardized_income_statement": (
        equals("pack.is.identity.total_revenue", "total_revenue", ["revenue_from_operations", "other_income"]),
        equals("pack.is.identity.net_income", "net_income", ["profit_before_tax"], ["tax_expense"]),
    ),
    "standardized_cash_flow": (
        complete("pack.cf.completeness.net_change", ["net_change_in_cash", *_FLOWS], ["net_change_in_cash"]),
        equals("pack.cf.identity.net_change", "net_change_in_cash", _FLOWS),
    ),
    "sec_10k_footnote_schedule": (),
    "vendor_invoice_headers": (
        equals("pack.inv.identity.total_simple", "total_amount", ["subtotal_amount", "tax_amount"], skip_if=("discount_amount", "shipping_amount")),
    ),
    "invoice_line_items": (
        product("pack.inv.line.product", "total_amount", ["quantity", "unit_price"], skip_if=("discount_amount", "tax_amount")),
    ),
}


def pack_rule(raw: dict) -> Rule:
    """A rule from its JSON declaration."""
    kind = str(raw.get("type") or "sum_equals")
    right = raw.get("right") or []
    right = [right] if isinstance(right, str) else [str(x) for x in right]
    left, op = str(raw.get("left") or ""), str(raw.get("op") or "add")
    common = {
        "severity": str(raw.get("severity") or HARD).lower(),
        "skip_if": tuple(raw.get("skip_if_any_present") or ()),
        "hint": str(raw.get("hint") or ""),
    }
    name = str(raw.get("id") or "pack.unnamed")
    fields = list(raw.get("fields") or ([left] if left else []))
    if kind == "completeness":
        return complete(name, list(raw.get("require") or []), list(raw.get("trigger_any_of") or []) or None,
                        stop=common["severity"] == HARD, **common)
    if kind == "bounds":
        return bounds(name, fields, low=raw.get("min_value"), high=raw.get("max_value"), **common)
    if kind == "mutex_positive":
        return mutex(name, fields, **common)
    if kind == "product_equals" or (kind in ("sum_equals", "diff_equals") and op == "mul"):
        return product(name, left, right, **common)
    if kind == "diff_equals" or (kind == "sum_equals" and op == "sub"):
        return equals(name, left, right[:1], right[1:], **common)
    if kind == "sum_equals":
        return equals(name, left, right, **common)
    raise ValueError(f"unknown rule type {kind!r} in {name}")


def load_pack(spark: SparkSession, path: str) -> dict[str, tuple[Rule, ...]]:
    """``{"rules": {schema: [declaration]}}`` from one JSON file."""
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return {s: tuple(pack_rule(r) for r in rules) for s, rules in (raw.get("rules") or {}).items()}


def load_grounding(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Fields to be found in the source text, by schema: a pack's ``grounding_fields`` replace the built-in ones."""
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return {**GROUNDING_FIELDS, **{s: list(fields) for s, fields in (raw.get("grounding_fields") or {}).items()}}


def rules_for(schema: str, packs: dict[str, tuple[Rule, ...]] | None = None) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """(pack rules, built-in rules) of a schema."""
    pack = (DEFAULT_PACKS if packs is None else packs).get(schema, ())
    if schema in ROW_RULES:
        return pack, ROW_RULES[schema]
    lowered = schema.lower()
    for word, rules in KEYWORD_RULES.items():
        if word in lowered:
            return pack, rules
    return pack, ()


def rule_fields(rules) -> list[str]:
    out: list[str] = []
    for rule in rules:
        out += [n for n in rule.names() if n not in out]
    return out


# --- compiling ---------------------------------------------------------------


class Fields:
    """Parsed numbers of a row by field name, plus the raw cells and the scale."""

    def __init__(self, numbers: dict[str, Column], raw: dict[str, Column] | None = None, scale: Column | None = None):
        self.numbers, self.raw = numbers, raw or {}
        self.scale = F.lit(1.0) if scale is None else scale

    def get(self, term: str) -> Column:
        optional, names = term.endswith("?"), term.rstrip("?").split("|")
        cols = [self.numbers[n] for n in names if n in self.numbers]
        if not cols:
            return F.lit(0.0) if optional else F.lit(None).cast("double")
        value = cols[0] if len(cols) == 1 else F.coalesce(*cols)
        return F.coalesce(value, F.lit(0.0)) if optional else value

    def missing(self, term: str) -> Column:
        return self.get(term).isNull()


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _total(f: Fields, plus, minus=()) -> Column:
    terms = [f.get(t) for t in plus]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    for t in minus:
        out = out - f.get(t)
    return out


def _condition(rule: Rule, f: Fields) -> tuple[Column, Column | None, Column | None, Column]:
    """(fails, expected, actual, message) of one rule."""
    no = F.lit(None).cast("double")
    if rule.kind == "complete":
        present = [~f.missing(t) for t in rule.trigger]
        if rule.exactly_one_with:
            count = sum((p.cast("int") for p in present[1:]), present[0].cast("int"))
            fails = (count == 1) & ~f.missing(rule.exactly_one_with)
        else:
            lacking = [f.missing(t) for t in rule.require]
            lacking += [F.coalesce(*[f.get(t) for t in group]).isNull() for group in rule.any_of]
            fails = _any(present) & _any(lacking)
        names = [t for t in rule.require] + ["|".join(g) for g in rule.any_of]
        absent = F.array_join(F.array_compact(F.array(*[F.when(f.missing(t), F.lit(t)) for t in names])), ", ")
        return fails, no, no, F.concat(F.lit("Logic Error: incomplete extraction — missing "), absent)
    if rule.kind in ("equals", "product"):
        left = f.get(rule.left)
        if rule.kind == "product":
            expected = f.get(rule.factors[0])
            for t in rule.factors[1:]:
                expected = expected * f.get(t)
            for t in rule.minus:
                expected = expected - f.get(t)
            for t in rule.plus:
                expected = expected + f.get(t)
        else:
            expected = _total(f, rule.plus, rule.minus)
        fails = ~nearly_equal(left, expected, f.scale)
        if rule.or_plus:
            other = _total(f, rule.or_plus, rule.minus)
            fails = fails & (other.isNull() | ~nearly_equal(left, other, f.scale))
        text = F.concat(
            F.lit(f"Logic Error: {describe(rule)} — expected "), expected.cast("string"),
            F.lit(", got "), left.cast("string"),
        )
        return fails, expected, left, text
    if rule.kind == "at_most":
        actual, limit = _total(f, rule.plus), f.get(rule.left)
        if rule.slack == "scaled":
            slack = F.greatest(F.lit(0.5), 0.01 * F.abs(limit), minimum_tolerance(f.scale))
            fails = (actual - limit) > slack
        else:
            fails = actual > limit + F.lit(0.02)
        text = F.concat(
            F.lit(f"Logic Error: {' + '.join(rule.plus)} ("), actual.cast("string"),
            F.lit(f") exceeds {rule.left} ("), limit.cast("string"), F.lit(")"),
        )
        return F.coalesce(fails, F.lit(False)), limit, actual, text
    if rule.kind == "bounds":
        bad, value = [], None
        for name in rule.fields:
            v = f.get(name)
            outside = F.lit(False)
            if rule.low is not None:
                outside = outside | ((v <= rule.low) if rule.strict else (v < rule.low))
            if rule.high is not None:
                outside = outside | ((v >= rule.high) if rule.strict else (v > rule.high))
            outside = F.coalesce(outside, F.lit(False))
            bad.append(outside)
            value = F.when(outside, v) if value is None else value.when(outside, v)
        text = F.concat(F.lit(f"Logic Error: {', '.join(rule.fields)} out of bounds: "), value.cast("string"))
        return _any(bad), no, value, text
    if rule.kind == "mutex":
        hits = [F.coalesce((f.get(n) != 0) if rule.nonzero else (f.get(n) > 0), F.lit(False)).cast("int") for n in rule.fields]
        count = hits[0]
        for h in hits[1:]:
            count = count + h
        return count > 1, no, no, F.lit(f"Logic Error: mutually exclusive: {', '.join(rule.fields)}")
    raise ValueError(f"rule kind {rule.kind!r} of {rule.id}")


def describe(rule: Rule) -> str:
    """The identity in words."""
    right = " × ".join(rule.factors) if rule.kind == "product" else " + ".join(rule.plus)
    if rule.kind == "product" and rule.plus:
        right += " + " + " + ".join(rule.plus)
    if rule.minus:
        right += " − " + " − ".join(rule.minus)
    return f"{rule.left} = {right}".replace("?", "")


def violation(seq: int, rule_id, severity, message: Column, fields: list[str], expected=None, actual=None, hint: str = "") -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    expected = F.lit(None).cast("double") if expected is None else expected
    actual = F.lit(None).cast("double") if actual is None else actual
    return F.struct(
        F.lit(seq).alias("seq"),
        as_col(rule_id).alias("rule_id"),
        as_col(severity).alias("severity"),
        message.alias("message"),
        (F.array(*[F.lit(x) for x in fields]) if fields else F.array().cast("array<string>")).alias("fields"),
        expected.alias("expected"),
        actual.alias("actual"),
        F.abs(actual - expected).alias("delta"),
        F.lit(hint).alias("hint"),
    ).cast(VIOLATION)


def _pressure(seq: int, rule: Rule, f: Fields) -> Column:
    """Blood pressure text: format first, then range."""
    text = f.raw.get(rule.left, F.lit(None).cast("string"))
    parts = F.split(text, "/")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    two = F.size(parts) == 2
    bad_form = ~text.contains("/") | (two & F.exists(numbers, lambda n: n.isNull()))
    high, low = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    in_range = (high > 50) & (high < 250) & (low > 30) & (low < 150)
    fields = [rule.left]
    return F.when(
        bad_form,
        violation(seq, "lab.format.blood_pressure", rule.severity, F.concat(F.lit("Logic Error: blood pressure is not systolic/diastolic: "), text), fields),
    ).when(
        two & ~in_range,
        violation(seq, rule.id, rule.severity, F.concat(F.lit("Logic Error: blood pressure out of bounds: "), text), fields),
    )


def compile_rule(rule: Rule, f: Fields, seq: int = 0, blocked: Column | None = None) -> tuple[Column, Column]:
    """(violation or null, fails) of one rule; ``blocked`` rows pass."""
    if rule.kind == "ratio_text":
        entry = _pressure(seq, rule, f)
        return entry, entry.isNotNull()
    fails, expected, actual, message = _condition(rule, f)
    for name in rule.skip_if:
        fails = fails & f.missing(name)
    if blocked is not None:
        fails = fails & ~blocked
    hint = rule.hint or f"Check {', '.join(rule.names())} against the source table."
    return F.when(fails, violation(seq, rule.id, rule.severity, message, rule.names(), expected, actual, hint)), fails


def compile_rules(rules, f: Fields, first_seq: int = 0, blocked: Column | None = None) -> tuple[list[Column], Column | None]:
    """Violation columns in order; a failing ``stop`` rule silences the later ones."""
    out = []
    for i, rule in enumerate(rules):
        entry, fails = compile_rule(rule, f, first_seq + i, blocked)
        out.append(entry)
        if rule.stop:
            blocked = fails if blocked is None else (blocked | fails)
    return out, blocked


def nested_items(text: Column) -> Column:
    """``array<map>`` of a JSON list; entries that are no objects are null."""
    cells = F.from_json(text, "array<string>")
    return F.transform(cells, lambda item: F.from_json(item, "map<string,string>"))


def line_items_total(items: Column) -> Column:
    """Σ of nested line items (``array<map>``), null without any.

    An item counts with its ``amount``, else its ``total_amount``; unparseable
    amounts and entries that are no objects count as zero.
    """
    amount = lambda m: F.coalesce(parse_number(F.coalesce(F.nullif(m["amount"], F.lit("")), m["total_amount"]), None), F.lit(0.0))
    return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda acc, m: acc + amount(m)))


def with_numbers(df: DataFrame, fields: list[str], bag: str | None = None, prefix: str = "n_") -> DataFrame:
    """One double column ``n_<field>`` per field, parsed once.

    Cells come from the map column ``bag``, or from columns of that name;
    numeric columns are cast, text is parsed, absent fields are null.  Where
    ``line_items_total`` is absent, nested ``line_items`` (a JSON list, or a
    column of maps or structs) are summed.
    """
    types = dict(df.dtypes)
    cols = {}
    for name in fields:
        if name == "line_items_total" and bag is not None:
            total = line_items_total(nested_items(F.col(bag)["line_items"]))
            cols[prefix + name] = F.coalesce(parse_number(F.col(bag)[name], None), total)
        elif name == "line_items_total" and name not in types and "line_items" in types:
            items = F.col("line_items")
            if not types["line_items"].startswith("array<map"):
                items = nested_items(items if types["line_items"] == "string" else F.to_json(items))
            cols[prefix + name] = line_items_total(items)
        elif bag is not None:
            cols[prefix + name] = parse_number(F.col(bag)[name], None)
        elif name not in types:
            cols[prefix + name] = F.lit(None).cast("double")
        elif types[name] == "boolean":
            cols[prefix + name] = F.lit(None).cast("double")
        elif types[name] == "string":
            cols[prefix + name] = parse_number(F.col(name), None)
        else:
            cols[prefix + name] = F.col(name).cast("double")
    return df.withColumns(cols)


def missing_critic(schema: str) -> Column:
    """Finance schemas without any rule must not pass."""
    return violation(0, "critic.missing_registration", HARD, F.lit(f"No critic registered for financial schema '{schema}'"), [])


def grounding(schema: str, f: Fields, source: Column, first_seq: int, severity: str = SOFT, fields=None) -> list[Column]:
    """A violation per listed field whose number is not in the source text."""
    out = []
    for i, name in enumerate(GROUNDING_FIELDS.get(schema, []) if fields is None else fields):
        fails = ~grounded_in(f.get(name), source)
        message = F.concat(F.lit(f"Logic Error: value of {name} not found in source text: "), f.get(name).cast("string"))
        out.append(F.when(fails, violation(first_seq + i, f"grounding.value_not_in_source.{name}", severity, message, [name], hint=f"Read {name} again; do not invent totals.")))
    return out


def check_rows(
    df: DataFrame,
    schema: str,
    bag: str | None = None,
    scale: Column | None = None,
    source_text: str | None = None,
    packs: dict[str, tuple[Rule, ...]] | None = None,
    rules: tuple[Rule, ...] | None = None,
    grounding_severity: str = SOFT,
    extra: list[Column] | None = None,
    grounding_fields: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Adds ``violations`` (array, in rule order) to every row.

    A failing hard completeness rule of a pack silences the built-in rules.
    ``rules`` replaces both sets.  ``scale`` defaults to the multiplier named
    by ``context_scale``.
    """
    pack, built_in = ((), rules) if rules is not None else rules_for(schema, packs)
    needed = rule_fields([*pack, *built_in])
    grounded = (GROUNDING_FIELDS if grounding_fields is None else grounding_fields).get(schema, []) if source_text else []
    needed += [g for g in grounded if g not in needed]
    staged = with_numbers(df, needed, bag)
    if scale is None:
        if bag is not None:
            scale = scale_multiplier(F.col(bag)["context_scale"])
        else:
            scale = scale_multiplier(F.col("context_scale")) if "context_scale" in df.columns else F.lit(1.0)
    staged = staged.withColumn("_scale", scale)
    raw = {n: (F.col(bag)[n] if bag else F.col(n)) for n in needed if bag or n in df.columns}
    f = Fields({n: F.col(f"n_{n}") for n in needed}, raw, F.col("_scale"))
    entries, blocked = compile_rules(pack, f)
    more, _ = compile_rules(built_in, f, len(entries), blocked)
    entries += more
    if not entries and schema in FINANCIAL_SCHEMAS:
        entries = [missing_critic(schema)]
    entries += grounding(schema, f, F.col(source_text), len(entries), grounding_severity, grounded) if source_text else []
    entries += extra or []
    found = F.array_compact(F.array(*entries)) if entries else F.array()
    out = staged.withColumn("violations", found.cast(VIOLATIONS))
    return out.drop("_scale", *[f"n_{n}" for n in needed])


# --- verdicts ----------------------------------------------------------------


def first_of(violations: Column, severity: str) -> Column:
    return F.get(F.filter(violations, lambda v: v["severity"] == severity), F.lit(0))


def merged(violations: Column) -> Column:
    """First hard violation, else the first soft one, else null."""
    return F.coalesce(first_of(violations, HARD), first_of(violations, SOFT))


def error_text(v: Column) -> Column:
    """``[rule] message Hint: hint``; null when there is no violation."""
    return F.when(
        v.isNotNull(),
        F.concat_ws(
            " ",
            F.concat(F.lit("["), v["rule_id"], F.lit("]")),
            presence(v["message"]),
            F.when(presence(v["hint"]).isNotNull(), F.concat(F.lit("Hint: "), v["hint"])),
        ),
    )


def rule_ids(violations: Column, severity: str) -> Column:
    return F.transform(F.filter(violations, lambda v: v["severity"] == severity), lambda v: v["rule_id"])


def with_verdict(df: DataFrame) -> DataFrame:
    """Row status, error text and failure lists from ``violations``.

    Only a hard failure makes a row fail; a soft one sends it to review.
    """
    v = F.col("violations")
    return df.withColumns(
        {
            "hard_failures": rule_ids(v, HARD),
            "soft_failures": rule_ids(v, SOFT),
            "critic_error": error_text(merged(v)),
        }
    ).withColumn(
        "row_status",
        F.when(F.size("hard_failures") > 0, "FAILED_VERIFICATION")
        .when(F.size("soft_failures") > 0, "NEEDS_REVIEW")
        .otherwise("MAPPED"),
    )


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per violation: keys, then the violation's fields.

    The outer form keeps the optimizer from computing the array once more for
    a filter on its size.
    """
    return df.select(*keys, F.explode_outer("violations").alias("v")).where("v IS NOT NULL").select(*keys, "v.*")


def soften(rule: Rule) -> Rule:
    return replace(rule, severity=SOFT)
