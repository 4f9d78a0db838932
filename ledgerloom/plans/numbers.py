"""Numbers: parsing, scale, currency, tokens, grounding."""

from pyspark.sql import functions as F

from ..functions import numerics as N
from .base import grouped, query

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"

NUMBER_CELLS = f"""
SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber
  WHEN 1 THEN {grouped(_CENTS)}
  WHEN 2 THEN '$ ' || {grouped(_CENTS)}
  WHEN 3 THEN '(' || {grouped(_CENTS)} || ')'
  WHEN 4 THEN translate({grouped(_CENTS)}, ',.', '.,')
  WHEN 5 THEN {grouped(_CENTS)} || '-'
  WHEN 6 THEN '- ' || CAST({_CENTS} % 1000 AS STRING) || ',5 mm'
  ELSE CASE WHEN {_CENTS} % 3 = 0 THEN '₹ 12,34,' || CAST({_CENTS} AS STRING)
            WHEN {_CENTS} % 3 = 1 THEN 'Rs. ' || CAST({_CENTS} % 100 AS STRING) || ' crores'
            ELSE 'n/a' END END AS cell
FROM {{lineitem}}"""

# The same reading rules, one stage per step.
PARSE_STAGES = """
s1 AS (SELECT *, trim(cell) AS raw FROM cells),
s2 AS (SELECT *, starts_with(raw, '(') AND ends_with(raw, ')') AS par FROM s1),
s3 AS (SELECT *, CASE WHEN par THEN trim(raw[2:-2]) ELSE raw END AS body FROM s2),
s4 AS (SELECT *, par OR starts_with(body, '-') OR ends_with(body, '-') AS neg, trim(rtrim(ltrim(body, '-'), '-')) AS body4 FROM s3),
s5 AS (SELECT *, rtrim(regexp_replace(body4, '(?i)[$€£¥₹\\s]|rs\\.?', '', 'g'), '%') AS body5 FROM s4),
s6 AS (SELECT *, lower(regexp_extract(body5, '(?i)(bn|mm|billion|millions|million|crores?|cr\\.?|lakhs?|lacs?|thousand|k|b|m)$', 1)) AS suf FROM s5),
s7 AS (SELECT *, body5[1:length(body5) - length(suf)] AS body7, CASE
  WHEN suf IN ('k', 'thousand') THEN 1e3 WHEN suf IN ('m', 'mm', 'million', 'millions') THEN 1e6
  WHEN suf LIKE 'la%' THEN 1e5 WHEN suf LIKE 'cr%' THEN 1e7 WHEN suf IN ('b', 'bn', 'billion') THEN 1e9 ELSE 1.0 END AS scale FROM s6),
s8 AS (SELECT *, CASE
  WHEN contains(body7, ',') AND contains(body7, '.') THEN
    CASE WHEN instr(reverse(body7), ',') < instr(reverse(body7), '.') THEN replace(replace(body7, '.', ''), ',', '.') ELSE replace(body7, ',', '') END
  WHEN length(body7) - length(replace(body7, ',', '')) = 1 AND length(split_part(body7, ',', 2)) <= 2 THEN replace(body7, ',', '.')
  ELSE replace(body7, ',', '') END AS digits FROM s7)
"""


@query(
    "parse_numbers",
    f"WITH {PARSE_STAGES} SELECT k, n, cell, round((CASE WHEN neg THEN -1 ELSE 1 END) * TRY_CAST(digits AS DOUBLE) * scale, 2) AS number FROM s8",
    cells=NUMBER_CELLS,
)
def parse_numbers(src, cells):
    return cells.withColumn("number", F.round(N.parse_number(F.col("cell")), 2))


SCALE_TEXTS = """
SELECT o_orderkey AS k, CASE o_orderkey % 12
  WHEN 0 THEN 'in millions' WHEN 1 THEN 'USD thousands' WHEN 2 THEN '₹ in Lakhs' WHEN 3 THEN '(in Cr.)'
  WHEN 4 THEN 'Amounts in $ billions' WHEN 5 THEN 'all figures in 000s' WHEN 6 THEN '$ in mm'
  WHEN 7 THEN 'in k' WHEN 8 THEN 'Rs Crores' WHEN 9 THEN 'lakhsX' WHEN 10 THEN 'unscaled' ELSE '' END
  || CASE WHEN o_orderkey % 5 = 0 THEN ' (unaudited)' ELSE '' END AS note,
  CASE WHEN o_orderkey % 7 = 0 THEN 100.0E0 WHEN o_orderkey % 7 = 1 THEN -1.0E0 END AS explicit
FROM {orders}"""


@query(
    "scale_multiplier",
    r"""SELECT k, note, m AS scale, CASE WHEN explicit > 0 THEN explicit ELSE m END AS row_scale FROM (
  SELECT *, CASE
    WHEN regexp_matches(lower(note), '\b(k|thousands?)\b') THEN 1e3
    WHEN regexp_matches(lower(note), '\b(lakhs?|lacs?)\b') THEN 1e5
    WHEN regexp_matches(lower(note), '\b(m|mm|millions?)\b') THEN 1e6
    WHEN regexp_matches(lower(note), '\b(crores?|cr)\b') THEN 1e7
    WHEN regexp_matches(lower(note), '\b(b|bn|billions?)\b') THEN 1e9
    WHEN lower(note) LIKE '%crore%' OR lower(note) LIKE '% cr%' THEN 1e7
    WHEN lower(note) LIKE '%lakh%' OR lower(note) LIKE '% lac%' THEN 1e5
    WHEN note LIKE '%000%' THEN 1e3 ELSE 1.0::DOUBLE END AS m FROM notes)""",
    notes=SCALE_TEXTS,
)
def scale(src, notes):
    note = F.col("note")
    return notes.select("k", "note", N.scale_multiplier(note).alias("scale"), N.row_scale(F.col("explicit"), note).alias("row_scale"))


AMOUNTS = """
SELECT c_custkey AS k, c_acctbal AS amount,
  CASE c_nationkey % 9 WHEN 0 THEN 'usd' WHEN 1 THEN 'INR' WHEN 2 THEN ' eur ' WHEN 3 THEN 'GBP' WHEN 4 THEN 'JPY'
    WHEN 5 THEN 'CAD' WHEN 6 THEN 'AUD' WHEN 7 THEN 'XYZ' ELSE '' END AS src,
  CASE c_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' ELSE 'INR' END AS dst
FROM {customer}"""


@query(
    "fx_convert",
    """WITH r(c, v) AS (VALUES ('USD', 1.0::DOUBLE), ('INR', 83.5), ('EUR', 0.92), ('GBP', 0.78), ('JPY', 155.0), ('CAD', 1.36), ('AUD', 1.5)),
n AS (SELECT *, CASE WHEN trim(src) = '' THEN 'USD' ELSE upper(trim(src)) END AS s FROM amounts)
SELECT k, round(amount * CASE WHEN s = dst THEN 1.0 ELSE coalesce(d.v, 1.0) / coalesce(f.v, 1.0) END, 1) AS converted
FROM n LEFT JOIN r f ON f.c = n.s LEFT JOIN r d ON d.c = n.dst""",
    amounts=AMOUNTS,
)
def fx(src, amounts):
    return amounts.select("k", F.round(F.col("amount") * N.fx_rate(F.col("src"), F.col("dst")), 1).alias("converted"))


PRICES = """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS DOUBLE)
  WHEN o_orderkey % 7 = 0 THEN -o_totalprice ELSE o_totalprice END AS price,
  'Total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN
    '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') ELSE ' only' END AS body
FROM {orders}"""


@query(
    "number_grounding",
    r"""WITH t AS (SELECT *, CASE WHEN abs(price - round(price)) < 1e-9 THEN printf('%.0f', price)
   ELSE regexp_replace(printf('%.4f', price), '\.?0+$', '') END AS token FROM prices)
SELECT k, token, contains(body, token) OR contains(replace(replace(body, ',', ''), ' ', ''), token)
  OR contains(body, format('{:,.2f}', price)) OR contains(replace(replace(body, ',', ''), ' ', ''), printf('%.2f', price))
  OR contains(body, format('{:,.0f}', price)) OR contains(replace(replace(body, ',', ''), ' ', ''), printf('%.0f', price)) AS grounded
FROM t""",
    prices=PRICES,
)
def grounding(src, prices):
    return prices.select("k", N.number_token(F.col("price")).alias("token"), N.grounded_in(F.col("price"), F.col("body")).alias("grounded"))


PAIRS = """
SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS a,
  l_extendedprice + CASE WHEN l_partkey % 4 = 0 THEN 0.0E0 WHEN l_partkey % 4 = 1 THEN 25.5E0 WHEN l_partkey % 4 = 2 THEN 260.25E0 ELSE 4000.75E0 END AS b,
  CASE WHEN l_suppkey % 3 = 0 THEN 1.0E0 WHEN l_suppkey % 3 = 1 THEN 1000.0E0 ELSE 1000000.0E0 END AS scale
FROM {lineitem}"""


@query(
    "tolerance",
    """SELECT k, n, abs(a - b) <= greatest(CASE WHEN scale >= 1000 THEN 0.02 * greatest(1.0, scale / 1000.0) ELSE 0.02 END,
  0.002 * greatest(abs(a), abs(b), 1.0)) AS equal,
  CASE WHEN scale >= 1000000 THEN 0.5 WHEN scale >= 1000 THEN 0.1 ELSE 0.02 END::DOUBLE AS least_tolerance FROM pairs""",
    pairs=PAIRS,
)
def tolerance(src, pairs):
    return pairs.select(
        "k", "n", N.nearly_equal(F.col("a"), F.col("b"), F.col("scale")).alias("equal"),
        N.minimum_tolerance(F.col("scale")).alias("least_tolerance"),
    )
