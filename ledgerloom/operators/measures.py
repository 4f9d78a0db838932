"""Measures generated from the registry: count, sum and average by any dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(28,4)"
NO_TENANT = "INVALID_TENANT_ID"


@dataclass(frozen=True)
class Cube:
    """Measures and dimensions over one view."""

    name: str
    dimensions: tuple[str, ...]
    sums: tuple[str, ...]
    averages: tuple[str, ...] = ()
    count_name: str = "count"


def cube_of(table: str, columns: dict[str, str]) -> Cube:
    """The cube of a registry table: every column a dimension, every number two measures."""
    numbers = tuple(c for c, t in columns.items() if t in ("int", "float"))
    return Cube(table, ("id", "tenant_id", "sys_document_id", *columns), numbers, numbers)


VENDOR_INVOICES = Cube(
    "vendor_invoices",
    ("id", "vendor_name", "region", "service_type", "billing_period", "tenant_id"),
    ("line_amount",),
    count_name="invoice_count",
)


def exact_sum(column: str | Column) -> Column:
    """Decimal sum: the same in any order of addition."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(MONEY))


def measures(
    view: DataFrame, cube: Cube, dimensions: list[str], wanted: list[str] | None = None, tenant: str | None = NO_TENANT
) -> DataFrame:
    """Group a tenant's rows by dimensions.

    ``wanted`` names measures (``count``, ``total_x``, ``avg_x``); default all.
    Without a tenant nothing matches; ``tenant=None`` is for views that are
    scoped already.
    """
    unknown = [d for d in dimensions if d not in cube.dimensions]
    if unknown:
        raise ValueError(f"not dimensions of {cube.name}: {unknown}")
    known = {cube.count_name: F.count(F.lit(1))}
    for c in cube.sums:
        known[f"total_{c}"] = exact_sum(c).cast("double")
    for c in cube.averages:
        known[f"avg_{c}"] = F.round(exact_sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)), 4)
    names = list(known) if wanted is None else wanted
    missing = [m for m in names if m not in known]
    if missing:
        raise ValueError(f"not measures of {cube.name}: {missing}")
    scoped = view if tenant is None else view.where(F.col("tenant_id") == tenant)
    return scoped.groupBy(*dimensions).agg(*[known[m].alias(m) for m in names])
