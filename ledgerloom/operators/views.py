"""Typed, tenant-scoped views over stored rows, and exact-row queries.

Stored rows: id, tenant_id, user_id, document_id, node_id, row_index,
source_page, source_bbox, target_table, mapping_status, strict and unmapped
``map<string,string>``.  Written partitioned by ``target_table``, a view reads
one partition; tenant and document filters sit below the projection and reach
the scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import FALLBACK_TABLE_ORDER, METRIC_SYNONYMS
from ..functions.hof import let, merge_maps, presence
from ..functions.text import blob_numbers, column_name, page_number
from ..registry import Registry, enriched, lookup_keys, view_name

SYSTEM_COLUMNS = [
    "id", "tenant_id", "sys_document_id", "sys_node_id", "row_index", "sys_user_id",
    "source_page", "source_bbox", "mapping_status",
]
_NULL_WORDS = ["", "na", "n/a", "none", "null", "nan", "unknown", "-"]


def bag_value(column: str, strict: str = "strict", unmapped: str = "unmapped") -> Column:
    """First non-null of the column's keys: strict before unmapped, key by key."""
    return F.coalesce(*[F.col(bag)[key] for key in lookup_keys(column) for bag in (strict, unmapped)])


def clean_number(text: Column, kind: str = "double") -> Column:
    """Digits and dots of a cell; brackets or any minus make it negative."""
    digits = F.regexp_replace(text, "[^0-9.]", "")
    sign = F.when(text.rlike(r"(?s)\(.*\)|-"), "-").otherwise("")
    return F.when(text.rlike("[0-9]"), F.concat(sign, digits)).try_cast(kind)


def clean_cast(text: Column, kind: str) -> Column:
    """Null words are null, then cast."""
    return F.when(~F.lower(F.trim(text)).isin(_NULL_WORDS), text).try_cast(kind)


def typed(column: str, kind: str) -> Column:
    value = bag_value(column)
    if kind == "float":
        return clean_number(value)
    if kind == "int":
        return F.round(clean_number(value, "decimal(38,6)")).cast("bigint")  # 1,234.50 is a number too
    if kind == "datetime":
        return clean_cast(value, "timestamp")
    if kind in ("bool", "boolean"):
        return clean_cast(value, "boolean")
    if kind == "dict":
        return F.coalesce(F.col("strict")[column], F.col("unmapped")[column])
    return presence(value)


def system_columns() -> list[Column]:
    renamed = {"sys_document_id": "document_id", "sys_node_id": "node_id", "sys_user_id": "user_id"}
    return [F.col(renamed.get(c, c)).alias(c) for c in SYSTEM_COLUMNS]


def registry_view(rows: DataFrame, table: str, registry: Registry, tenant: str | None = None) -> DataFrame:
    """System columns, context columns and typed columns of one schema."""
    chosen = rows.where(F.col("target_table") == table)
    if tenant is not None:
        chosen = chosen.where(F.col("tenant_id") == tenant)
    columns = [typed(c, t).alias(c) for c, t in enriched(registry[table]).items() if isinstance(t, str)]
    return chosen.select(*system_columns(), *columns)


def register_views(spark: SparkSession, rows: DataFrame, registry: Registry, tenant: str) -> list[str]:
    """Temp views of one tenant only, so any SQL over them is scoped."""
    names = []
    for table in registry:
        registry_view(rows, table, registry, tenant).createOrReplaceTempView(view_name(table))
        names.append(view_name(table))
    return names


def parse_filters(text: str | dict, allowed: list[str]) -> dict:
    """Equality filters on listed columns; anything else is an error."""
    raw = text if isinstance(text, dict) else json.loads(text or "{}")
    if not isinstance(raw, dict):
        raise ValueError("filters must be a JSON object of equality filters")
    for key, value in raw.items():
        if key not in allowed:
            raise ValueError(f"filter column {key!r} is not allowed on this view")
        if isinstance(value, (dict, list)):
            raise ValueError(f"filter value of {key!r} must be a scalar")
    return {k: v for k, v in raw.items() if k != "tenant_id"}


def filtered(df: DataFrame, filters: dict) -> DataFrame:
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def at_most(df: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or exactly as many as asked for; a service clamps what its callers may ask."""
    if limit is not None and limit < 1:
        raise ValueError(f"a limit of {limit} rows")
    return df if limit is None else df.limit(limit)


def status_order(status: str = "mapping_status") -> Column:
    return F.when(F.col(status) == "MAPPED", 0).when(F.col(status) == "NEEDS_REVIEW", 1).otherwise(2)


def by_status(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mapped, then review, then other rows; row index with nulls last."""
    return at_most(df.orderBy(status_order(), F.col("row_index").asc_nulls_last(), F.col("id")), limit)


def exact_rows(
    rows: DataFrame, table: str, registry: Registry, tenant: str, document: str | None = None,
    filters: str | dict | None = None, limit: int | None = None,
) -> DataFrame:
    """Exact rows of one view: tenant, optional document, equality filters, top rows."""
    view = registry_view(rows, table, registry, tenant)
    chosen = parse_filters(filters or {}, view.columns)
    if document:
        view = view.where(F.col("sys_document_id") == document)
    return by_status(filtered(view, chosen), limit)


def fallback_order(table: Column) -> Column:
    """Core tables first in their fixed order, all others 99."""
    at = F.array_position(F.array(*[F.lit(t) for t in FALLBACK_TABLE_ORDER]), table)
    return F.when(at > 0, at - 1).otherwise(99)


def fallback_rows(rows: DataFrame, table: str, tenant: str, document: str, limit: int | None = None) -> DataFrame:
    """Stored rows for a document: the asked table, else the document's other
    tables in fixed order, else the tenant's rows of the asked table.

    Every row gets the rank of its branch; only the best rank present stays.
    One pass over the tenant's rows, one small aggregate.
    """
    scoped = rows.where(F.col("tenant_id") == tenant)
    mine, asked = F.col("document_id") == document, F.col("target_table") == table
    branch = (
        F.when(mine & asked, F.struct(F.lit(0).alias("rank"), F.lit("").alias("name")))
        .when(mine, F.struct((F.lit(1) + fallback_order(F.col("target_table"))).cast("int").alias("rank"), F.col("target_table").alias("name")))
        .when(asked, F.struct(F.lit(1000).alias("rank"), F.lit("").alias("name")))
    )
    ranked = scoped.where(mine | asked).withColumn("_branch", branch)
    best = ranked.groupBy("tenant_id").agg(F.min("_branch").alias("_best"))
    chosen = ranked.join(F.broadcast(best), "tenant_id").where(F.col("_branch") == F.col("_best"))  # one row: the one tenant
    return by_status(chosen.drop("_branch", "_best"), limit)


def bag_rows(rows: DataFrame, tenant: str, document: str | None = None, table: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored rows with one ``fields`` map: strict values, then non-empty unmapped
    ones, then finance numbers found in the raw text of the unmapped bag."""
    chosen = rows.where(F.col("tenant_id") == tenant)
    if document:
        chosen = chosen.where(F.col("document_id") == document)
    if table:
        chosen = chosen.where(F.col("target_table") == table)
    kept = by_status(chosen, limit)
    strict = F.map_filter("strict", lambda _, v: v.isNotNull())
    unmapped = F.map_filter("unmapped", lambda _, v: presence(v).isNotNull())
    numbers = F.transform_values(blob_numbers(F.to_json("unmapped")), lambda _, v: v.cast("string"))
    return kept.withColumn("fields", merge_maps(merge_maps(numbers, unmapped), strict))


def target_tables(rows: DataFrame, limit: int | None = None) -> DataFrame:
    named = rows.where(presence(F.col("target_table")).isNotNull())
    return named.select("target_table").distinct().orderBy("target_table").transform(lambda d: at_most(d, limit))


def with_donors(df: DataFrame, columns: list[str], group: str = "tenant_id", order: str = "id") -> DataFrame:
    """Accepted rows with nulls filled from rows that are neither mapped nor in review.

    Per column the first non-empty donor value in row order counts.  When no
    row is accepted all rows are.  Filled columns are listed in
    ``proxy_columns``; ``trust_level`` is always 'verified'.
    """
    accepted = F.col("mapping_status").isin("MAPPED", "NEEDS_REVIEW")
    accepted = F.coalesce(accepted, F.lit(False))
    usable = lambda c: F.when(~accepted & presence(F.col(c).cast("string")).isNotNull(), F.col(order))
    donors = df.groupBy(group).agg(
        F.max(accepted).alias("_any"), *[F.min_by(c, usable(c)).alias(f"_d_{c}") for c in columns]
    )
    joined = df.join(donors, group).where(accepted | ~F.col("_any"))
    filled = [F.when(F.col(c).isNull() & F.col(f"_d_{c}").isNotNull(), F.lit(c)) for c in columns]
    out = joined.withColumn("proxy_columns", F.array_compact(F.array(*filled)))
    out = out.withColumns({c: F.coalesce(c, f"_d_{c}") for c in columns})
    return out.withColumn("trust_level", F.lit("verified")).drop("_any", *[f"_d_{c}" for c in columns])


def lifted_fields(strict: Column, unmapped: Column) -> Column:
    """Both bags as one map that also holds normalised key names."""
    keep = lambda m: F.map_filter(m, lambda _, v: presence(v).isNotNull())

    def named(plain: Column) -> Column:
        entries = F.transform(
            F.map_entries(plain), lambda e: F.struct(column_name(e["key"]).alias("key"), e["value"].alias("value"))
        )
        fresh = let(
            F.filter(entries, lambda e: (e["key"] != "") & ~F.map_contains_key(plain, e["key"])),
            lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda p: p["key"] == e["key"])),
        )
        return F.map_concat(plain, F.map_from_entries(fresh))

    return let(merge_maps(keep(unmapped), keep(strict)), named)


def metric(fields: Column, name: str) -> Column:
    """A metric by the first non-empty of its names."""
    return F.coalesce(*[presence(fields[n]) for n in [name, *[s for s in METRIC_SYNONYMS.get(name, []) if s != name]]])


def result_page(page: Column, *texts: Column) -> Column:
    return page_number(page, F.concat_ws(" ", *texts))


def derive_metrics(df: DataFrame) -> DataFrame:
    """Fill missing statement metrics from others (double columns; absent ones are null).

    All fall-backs look at the values as given, not at derived ones.
    """
    n = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    either = lambda *names: F.coalesce(*[F.nullif(n(x), F.lit(0.0)) for x in names[:-1]], n(names[-1]))
    ebit, operating, gross = n("ebit"), n("operating_income"), n("gross_profit")
    revenue = either("total_revenue", "revenue_from_operations")
    opex = either("operating_expenses", "sg_and_a_expenses")
    cogs, pbt, tax, interest = n("cost_of_goods_sold"), n("profit_before_tax"), n("tax_expense"), n("interest_expense")
    options = [
        (operating, "Operating Income"),
        (gross - opex, "Gross Profit minus Operating Expenses"),
        (revenue - cogs - opex, "Revenue minus COGS minus Opex"),
        (pbt + interest, "Profit Before Tax plus Interest Expense"),
    ]
    label = F.when(ebit.isNotNull(), None)
    for value, name in options:
        label = label.when(value.isNotNull(), name)
    new = {
        "ebit": F.coalesce(ebit, *[v for v, _ in options]),
        "ebit_proxy_source": label,
        "operating_income": F.coalesce(operating, ebit, gross - opex),
        "gross_profit": F.coalesce(gross, revenue - cogs),
        "net_income": F.coalesce(n("net_income"), pbt - tax, operating - F.coalesce(interest, F.lit(0.0)) - tax),
        "cash_and_equivalents": F.coalesce(
            n("cash_and_equivalents"), either("cash_beginning_of_period", "cash_end_of_period", "total_current_assets")
        ),
        "short_term_debt": F.coalesce(n("short_term_debt"), either("operating_lease_liabilities_current", "accounts_payable")),
    }
    return df.withColumns(new)


