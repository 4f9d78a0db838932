"""Financial numbers: parsing, scale, tolerance, grounding, currency.

Every function takes and returns a ``Column``; nothing here needs Python at
run time.  ``parse_number`` binds the text of each stage once, so it does not
blow up when composed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    ABS_TOLERANCE,
    NUMBER_SUFFIX,
    NUMBER_SUFFIX_PATTERN,
    REL_TOLERANCE,
    SCALE_WORDS,
    UNITS_PER_USD,
    UNSCALED_FIELDS,
)

from .hof import BLANK_CHARS, let

_PLAIN = r"^\$?(?:\d{1,15}|\d{1,3}(?:,\d{3}){1,4})(?:\.\d{1,15})?$"
_NOISE = "$€£¥₹" + BLANK_CHARS
_SUFFIX_ENDS = sorted({suffix[-1] for suffix in NUMBER_SUFFIX})
_DIGITS = r"^[+-]?(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?$"
_FLOAT = r"^[+-]?(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?$"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_number(value: Column, field: str | None = None) -> Column:
    """A number cell as double, or null.

    Parentheses and a leading or trailing minus are negative; currency signs,
    ``rs.``, blanks and a trailing ``%`` go; a scale suffix multiplies (not
    for unscaled fields); commas are read as European, US or Indian grouping.
    The words ``nan`` and ``inf`` are null here, as a blank cell is.
    """
    text = value.cast("string")
    plain = F.translate(text, "$,", "").try_cast("double")
    return F.when(text.rlike(_PLAIN), plain).otherwise(let(F.btrim(text, F.lit(BLANK_CHARS)), lambda s: _signed(s, field)))


def _signed(s: Column, field: str | None) -> Column:
    """A cell without blanks around it.  Each stage binds its text once; regular expressions run only where one can match."""
    enclosed = s.startswith("(") & s.endswith(")")
    inner = F.when(enclosed, F.btrim(s.substr(F.lit(2), F.length(s) - 2), F.lit(BLANK_CHARS))).otherwise(s)
    bare = F.rtrim(F.ltrim(inner, F.lit("-")), F.lit("-"))
    bare = let(bare, lambda u: F.when(F.lower(u).contains("rs"), F.regexp_replace(u, r"[rR][sS]\.?", "")).otherwise(u))
    body = F.rtrim(F.translate(bare, _NOISE, ""), F.lit("%"))
    if field is not None and field.strip().lower() in UNSCALED_FIELDS:
        magnitude = _magnitude(body)
    else:
        magnitude = let(body, lambda b: F.when(F.lower(F.right(b, F.lit(1))).isin(_SUFFIX_ENDS), _scaled(b)).otherwise(_magnitude(b)))
    return magnitude * F.when(enclosed | s.startswith("-") | s.endswith("-"), -1.0).otherwise(1.0)


def _scaled(body: Column) -> Column:
    """A text that may end in a scale suffix."""

    def times(suffix: Column) -> Column:
        digits = body.substr(F.lit(1), F.length(body) - F.length(suffix))
        return _magnitude(digits) * F.coalesce(literal_map(NUMBER_SUFFIX)[F.lower(suffix)], F.lit(1.0))

    return let(F.regexp_extract(body, NUMBER_SUFFIX_PATTERN, 1), times)


def _magnitude(digits: Column) -> Column:
    """Digits with commas and dots; null when they are no number."""

    def without_commas(d: Column) -> Column:
        behind = F.substring_index(d, ",", -1)
        single = F.length(F.substring_index(d, ",", 1)) + F.length(behind) + 1 == F.length(d)
        dotted = d.contains(".")
        return (
            # one comma, no dot, at most two digits after it: a decimal comma
            F.when(single & ~dotted & (F.length(behind) <= 2), F.replace(d, F.lit(","), F.lit(".")))
            .when(~dotted | behind.contains("."), F.replace(d, F.lit(","), F.lit("")))
            # one comma, after the last dot: a decimal comma with dots as grouping
            .when(single, F.replace(F.replace(d, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            # several commas, the last one after the last dot: not a number
        )

    number = let(digits, lambda d: F.when(d.contains(","), without_commas(d)).otherwise(d))
    grouped = lambda n: F.translate(F.regexp_extract(n, _FLOAT, 0), "_", "")
    return let(number, lambda n: F.when(n.rlike(_DIGITS), n).when(n.contains("_"), grouped(n))).try_cast("double")


def first_number(*values: Column) -> Column:
    """First parseable of several cells."""
    return F.coalesce(*[parse_number(v) for v in values])


def scale_multiplier(text: Column, field: str | None = None) -> Column:
    """Multiplier named by a scale footnote such as 'USD in thousands'."""
    if field is not None and field.strip().lower() in UNSCALED_FIELDS:
        return F.lit(1.0)
    s = F.lower(F.trim(text))
    out = None
    for pattern, multiplier in SCALE_WORDS:
        hit = s.rlike("(?U)" + pattern)
        out = F.when(hit, multiplier) if out is None else out.when(hit, multiplier)
    out = out.when(s.contains("crore") | s.contains(" cr"), 1e7)
    out = out.when(s.contains("lakh") | s.contains(" lac"), 1e5)
    out = out.when(s.contains("000") & ~s.contains("million") & ~s.contains("lakh"), 1e3)
    return out.otherwise(1.0)


def row_scale(explicit: Column | None, text: Column, field: str | None = None) -> Column:
    """Explicit multiplier when positive, else the one in the text."""
    from_text = scale_multiplier(text, field)
    if explicit is None or (field is not None and field.strip().lower() in UNSCALED_FIELDS):
        return from_text
    return F.coalesce(F.when(explicit > 0, explicit.cast("double")), from_text)


def tolerance(a: Column, b: Column, scale: Column, abs_tol=ABS_TOLERANCE, rel_tol=REL_TOLERANCE) -> Column:
    """Absolute tolerance widened by reporting scale and by magnitude."""
    abs_col = abs_tol if isinstance(abs_tol, Column) else F.lit(float(abs_tol))
    widened = F.when(scale >= 1000, abs_col * scale / 1000.0).otherwise(abs_col)
    return F.greatest(widened, F.lit(float(rel_tol)) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def nearly_equal(a: Column, b: Column, scale: Column | None = None, abs_tol=ABS_TOLERANCE, rel_tol=REL_TOLERANCE) -> Column:
    """True also when either side is missing."""
    scale = F.lit(1.0) if scale is None else scale
    return F.coalesce(F.abs(a - b) <= tolerance(a, b, scale, abs_tol, rel_tol), F.lit(True))


def minimum_tolerance(scale: Column) -> Column:
    return F.when(scale >= 1e6, 0.5).when(scale >= 1e3, 0.1).otherwise(0.02)


def number_token(number: Column) -> Column:
    """Canonical text of a number: no decimals when whole, else at most four."""
    whole = F.abs(number - F.rint(number)) < 1e-9
    decimals = F.regexp_replace(F.format_string("%.4f", number), r"\.?0+$", "")
    return F.when(whole, F.format_string("%.0f", F.rint(number) + F.lit(0.0))).when(number.isNotNull(), decimals)


def grounded_in(number: Column, source: Column) -> Column:
    """Does the number occur in the source text, in any usual notation?

    True also when there is no number or no text to look in.
    """
    compact = F.regexp_replace(source, r"[, \u00a0]", "")
    token = number_token(number)
    two = F.format_string("%,.2f", number)
    zero = F.format_string("%,.0f", F.rint(number))
    brackets = F.format_string("(%,.2f)", F.abs(number))
    found = source.contains(token) | compact.contains(token)
    for text in (two, zero):
        found = found | source.contains(text) | compact.contains(F.translate(text, ",", ""))
    found = found | (
        (number < 0) & (source.contains(brackets) | compact.contains(F.translate(brackets, ",", "")))
    )
    nothing = number.isNull() | source.isNull() | (F.trim(source) == "")
    return nothing | found


def cast_by_type(value: Column, kind: str, field: str | None = None) -> Column:
    """Numbers through ``parse_number``; everything else passes."""
    if kind == "float":
        return parse_number(value, field)
    if kind == "int":
        return F.round(parse_number(value, field)).try_cast("bigint")
    return value


def fx_rate(source: Column, target: Column) -> Column:
    """Cross rate; an unknown currency counts as one per dollar."""
    rates = literal_map(UNITS_PER_USD)
    src = F.coalesce(F.nullif(F.upper(F.trim(source)), F.lit("")), F.lit("USD"))
    dst = F.coalesce(F.nullif(F.upper(F.trim(target)), F.lit("")), F.lit("USD"))
    cross = F.coalesce(rates[dst], F.lit(1.0)) / F.coalesce(rates[src], F.lit(1.0))
    return F.when(src == dst, 1.0).otherwise(cross)


def convert_currency(amount: Column, source: Column, target: Column) -> Column:
    return F.round(amount * fx_rate(source, target), 2)
