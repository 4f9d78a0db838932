"""Golden documents: cell matches, rule outcome, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hof import strip
from ..functions.numerics import nearly_equal, parse_number
from .critic import document_violations


def cell_match(expected: Column, predicted: Column, allowed: Column | float = 0.01) -> Column:
    """Numbers within tolerance, else equal trimmed lower-case text; no gold passes."""
    e, p = parse_number(expected), parse_number(predicted)
    text = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    numeric = e.isNotNull() | p.isNotNull()
    close = nearly_equal(e, p, abs_tol=allowed)
    return F.when(expected.isNull(), True).when(numeric, close).otherwise(text(expected) == text(predicted))


def golden_rows(goldens: DataFrame) -> DataFrame:
    """(document_id, target_table, row_index, data) of golden documents."""
    return goldens.select("document_id", "target_table", F.posexplode("extracted_rows").alias("row_index", "data"))


def scored(goldens: DataFrame) -> Column:
    """Documents that expect a failure are judged by their rules alone."""
    return ~F.coalesce("expect_fail", F.lit(False)) & ~F.coalesce("expect_soft", F.lit(False))


def _matches(cells: Column, rows: Column) -> Column:
    """Gold cells with their prediction, looked up inside the record."""
    def one(c: Column) -> Column:
        row = F.get(rows, c["row_index"])
        predicted = F.when(c["row_index"] >= 0, row[c["column"]])
        allowed = F.coalesce(c["tolerance"], F.lit(0.01))
        return F.struct(
            c["row_index"].alias("row_index"), c["column"].alias("column"), c["value"].alias("value"), predicted.alias("predicted"),
            cell_match(c["value"], predicted, allowed).alias("match"),
        )

    return F.transform(cells, one)


def match_cells(goldens: DataFrame) -> DataFrame:
    """One row per gold cell with its prediction and whether it matches."""
    matched = goldens.where(scored(goldens)).select("document_id", _matches(F.col("cells"), F.col("extracted_rows")).alias("m"))
    return matched.select("document_id", F.inline("m"))


def count_cells(goldens: DataFrame) -> DataFrame:
    """``cells_total, cells_matched`` of each golden, counted in its own row."""
    matched = F.when(scored(goldens), F.filter(_matches(F.col("cells"), F.col("extracted_rows")), lambda m: m["match"]))
    counted = F.when(scored(goldens), F.size("cells"))
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    return goldens.withColumns({"cells_total": zero(counted), "cells_matched": zero(F.size(matched))})


def rule_outcome(goldens: DataFrame, violations: DataFrame, keep: list[str] | None = None, identities: Column | None = None) -> DataFrame:
    """Per document: did the rules behave as the golden expects?"""
    if identities is not None:
        goldens = goldens.withColumn("identities", identities)
    counts = violations.groupBy("document_id").agg(
        F.count_if(F.col("severity") == "hard").alias("hard"), F.count_if(F.col("severity") == "soft").alias("soft")
    )
    joined = goldens.join(counts, "document_id", "left").fillna(0, ["hard", "soft"])
    ok = (
        F.when(F.coalesce("expect_fail", F.lit(False)), F.col("hard") > 0)
        .when(F.coalesce("expect_soft", F.lit(False)), (F.col("soft") > 0) & (F.col("hard") == 0))
        .otherwise(F.col("hard") == 0)
    )
    return joined.select(
        "document_id", "target_table", (F.col("predicted_table") == F.col("target_table")).alias("schema_ok"),
        ok.alias("critic_ok"), "hard", "soft", *(keep or []),
    )


def golden_violations(goldens: DataFrame) -> DataFrame:
    """The document critic over goldens of every schema: row rules, running balances, related tables, missing critics."""
    return document_violations(golden_rows(goldens))


def evaluated(goldens: DataFrame) -> DataFrame:
    """One row per golden: schema, rules and cells as expected, declared identities counted as cells."""
    outcome = rule_outcome(count_cells(goldens), golden_violations(goldens), ["cells_total", "cells_matched", "identities"], _identities(goldens))
    added = lambda c: F.when(c, F.col("identities")).otherwise(0)
    return outcome.withColumns({
        "cells_total": F.col("cells_total") + F.col("identities"),
        "cells_matched": F.col("cells_matched") + added(F.col("critic_ok")),
    }).drop("identities")


def _identities(goldens: DataFrame) -> Column:
    if "relations" not in goldens.columns:
        return F.lit(0)
    declared = F.size(F.filter("relations", lambda r: r["type"] == "sum_equals"))
    return F.when(scored(goldens), F.greatest(F.coalesce(declared, F.lit(0)), F.lit(0))).otherwise(0)


def summary(documents: DataFrame) -> DataFrame:
    """One row: accuracies and pass rates."""
    rate = lambda n, d: F.round(F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(1.0)), 6)
    flags = documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("cells_matched"), F.lit(0)).alias("cells_matched"),
        F.coalesce(F.sum("cells_total"), F.lit(0)).alias("cells_total"),
        F.count_if("critic_ok").alias("_c"),
        F.count_if("schema_ok").alias("_s"),
    )
    return flags.select(
        "documents", "cells_matched", "cells_total",
        rate(F.col("cells_matched"), F.col("cells_total")).alias("cell_accuracy"),
        rate(F.col("_c"), F.col("documents")).alias("critic_pass_rate"),
        rate(F.col("_s"), F.col("documents")).alias("schema_accuracy"),
    )


def failed_documents(documents: DataFrame) -> DataFrame:
    return documents.where((F.col("cells_matched") < F.col("cells_total")) | ~F.col("critic_ok") | ~F.col("schema_ok"))


def validate_goldens(goldens: DataFrame) -> DataFrame:
    """Exported goldens with the expectation their own rules give.

    A hard violation makes a negative golden; documents without rows are
    dropped.
    """
    kept = goldens.where(F.size("extracted_rows") > 0)
    hard = golden_violations(kept).where("severity = 'hard'").groupBy("document_id").agg(
        F.min_by("rule_id", F.struct(F.col("row_index").isNull(), "row_index", "seq")).alias("export_note")
    )
    return kept.drop("expect_fail").join(hard, "document_id", "left").withColumn("expect_fail", F.col("export_note").isNotNull())
