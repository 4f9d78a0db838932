"""Confidence score, promotion band and row status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import AUTO_PROMOTE_MIN, REVIEW_MIN

STATUS_OF_BAND = {"auto_promote": "MAPPED", "review": "NEEDS_REVIEW", "reject": "FAILED_VERIFICATION"}


def score(
    hard: Column,
    soft: Column,
    structure_ok: Column | None = None,
    empty_ratio: Column | None = None,
    drift_ratio: Column | None = None,
    misses: Column | None = None,
    checked: Column | None = None,
) -> Column:
    """0 on a hard failure, else 1 minus the penalties, within 0..1."""
    out = F.lit(1.0) - 0.12 * soft
    if structure_ok is not None:
        sparse = F.when(F.coalesce(empty_ratio, F.lit(0.0)) > 0.4, 0.1).otherwise(0.0) if empty_ratio is not None else F.lit(0.0)
        out = out - F.when(structure_ok.isNull(), 0.0).when(~structure_ok, 0.35).otherwise(sparse)
    if drift_ratio is not None:
        out = out - F.when(drift_ratio > 0.3, F.least(F.lit(0.25), drift_ratio * 0.5)).otherwise(0.0)
    if misses is not None and checked is not None:
        rate = misses / F.nullif(checked, F.lit(0))
        out = out - F.when(rate > 0, F.least(F.lit(0.3), rate * 0.4)).otherwise(0.0)
    return F.when(hard > 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)))


def band(score: Column, hard: Column, soft: Column, auto: float = AUTO_PROMOTE_MIN, review: float = REVIEW_MIN) -> Column:
    return (
        F.when(hard > 0, "reject")
        .when((score >= auto) & (soft == 0), "auto_promote")
        .when(score >= review, "review")
        .otherwise("reject")
    )


def status_of_band(band: Column) -> Column:
    out = None
    for name, status in STATUS_OF_BAND.items():
        out = F.when(band == name, status) if out is None else out.when(band == name, status)
    return out


def with_confidence(df: DataFrame, auto: float = AUTO_PROMOTE_MIN, review: float = REVIEW_MIN) -> DataFrame:
    """Adds score, band and reasons to checked rows.

    Reads ``violations`` and, where present, ``structure_ok``,
    ``empty_cell_ratio``, ``drift_ratio`` and ``grounding_checked``.
    """
    v = F.col("violations")
    has = lambda c: F.col(c) if c in df.columns else None
    count = lambda cond: F.size(F.filter(v, cond))
    counted = df.withColumns(
        {
            "_hard": count(lambda x: x["severity"] == "hard"),
            "_soft": count(lambda x: x["severity"] == "soft"),
            "_miss": count(lambda x: x["rule_id"].startswith("grounding.")),
        }
    )
    checked = has("grounding_checked")
    scored = counted.withColumn(
        "confidence_score",
        F.round(
            score(F.col("_hard"), F.col("_soft"), has("structure_ok"), has("empty_cell_ratio"), has("drift_ratio"), F.col("_miss"), checked), 4
        ),
    )
    banded = scored.withColumn("promotion_band", band(F.col("confidence_score"), F.col("_hard"), F.col("_soft"), auto, review))
    hard_rule = F.get(F.filter(v, lambda x: x["severity"] == "hard"), F.lit(0))["rule_id"]
    soft_rules = F.transform(F.filter(v, lambda x: x["severity"] == "soft"), lambda x: F.concat(F.lit("soft_critic:"), x["rule_id"]))
    none = F.array().cast("array<string>")
    one = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.array(text)).otherwise(none)
    reasons = [soft_rules]
    if has("structure_ok") is not None:
        reasons.append(one(~F.col("structure_ok"), F.lit("structure_fail")))
        if has("empty_cell_ratio") is not None:
            reasons.append(one(F.col("structure_ok") & (F.col("empty_cell_ratio") > 0.4), F.lit("sparse_table")))
    if has("drift_ratio") is not None:
        reasons.append(one(F.col("drift_ratio") > 0.3, F.format_string("drift_ratio:%.2f", F.col("drift_ratio"))))
    if checked is not None:
        rate = F.col("_miss") / F.nullif(checked, F.lit(0))
        reasons.append(one(rate > 0, F.format_string("grounding_miss_rate:%.2f", rate)))
    listed = banded.withColumn("_reasons", F.concat(*reasons))
    final = F.when(F.col("_hard") > 0, F.array(F.concat(F.lit("hard_critic:"), hard_rule))).otherwise(
        F.concat(
            F.col("_reasons"),
            one((F.col("promotion_band") == "review") & (F.size("_reasons") == 0), F.lit("below_auto_promote_threshold")),
            one(F.col("promotion_band") == "reject", F.lit("below_review_threshold")),
        )
    )
    return listed.withColumn("confidence_reasons", final).drop("_hard", "_soft", "_miss", "_reasons")


def row_status(band: Column, hard: Column, soft: Column, drift: Column, ratio: Column) -> Column:
    """Failed on reject; review on soft failures or any drift; else mapped."""
    return (
        F.when((band == "reject") | (hard > 0), "FAILED_VERIFICATION")
        .when((band == "review") | (soft > 0) | (drift > 0) | (ratio > 0.3), "NEEDS_REVIEW")
        .otherwise("MAPPED")
    )


def table_status(
    rows: DataFrame, keys: list[str], status: str = "row_status",
    document_failures: DataFrame | None = None, tables: DataFrame | None = None,
) -> DataFrame:
    """Worst row status per table; a hard document failure fails the table.

    With ``tables`` (all table keys) a table without rows is listed too and
    needs review.
    """
    rank = F.when(F.col(status) == "FAILED_VERIFICATION", 2).when(F.col(status) == "NEEDS_REVIEW", 1).otherwise(0)
    worst = rows.groupBy(*keys).agg(F.max(rank).alias("_r"), F.count(F.lit(1)).alias("row_count"))
    if document_failures is not None:
        hard = document_failures.where("severity = 'hard'").select(*keys).distinct().withColumn("_d", F.lit(2))
        worst = worst.join(hard, keys, "left").withColumn("_r", F.greatest("_r", F.coalesce("_d", F.lit(0)))).drop("_d")
    if tables is not None:
        worst = tables.select(*keys).join(worst, keys, "left").fillna({"_r": 1, "row_count": 0})
    return worst.select(
        *keys, "row_count",
        F.when(F.col("_r") == 2, "FAILED_VERIFICATION").when(F.col("_r") == 1, "NEEDS_REVIEW").otherwise("MAPPED").alias("mapping_status"),
    )
