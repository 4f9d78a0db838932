"""Human corrections: field patches, synonyms, few-shot choice, golden export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import PATCH_SKIP_KEYS
from ..functions.hof import presence, strip
from ..functions.text import file_slug

PATCHES = "array<struct<column:string,before:string,after:string>>"


def field_patches(before: Column, after: Column) -> Column:
    """Fields whose trimmed text differs, sorted by name, from two maps.

    The full outer join of the two rows' fields is inside the row: the union
    of the keys, looked up on both sides.
    """
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    keys = F.filter(keys, lambda k: ~k.isin(PATCH_SKIP_KEYS) & ~k.startswith("_"))
    text = lambda v: strip(F.coalesce(v, F.lit("")))
    entries = F.transform(
        keys, lambda k: F.struct(k.alias("column"), before[k].alias("before"), after[k].alias("after"))
    )
    return F.filter(entries, lambda e: text(e["before"]) != text(e["after"])).cast(PATCHES)


def patch_rows_long(corrections: DataFrame, keys: list[str]) -> DataFrame:
    """One row per patched field: keys, column, before, after."""
    empty = F.create_map().cast("map<string,string>")
    patches = field_patches(F.coalesce("before", empty), F.coalesce("after", empty))
    return corrections.select(*keys, F.explode(patches).alias("p")).select(*keys, "p.*")


def synonym_mappings(corrections: DataFrame, key: str, drift: str = "drift", after: str = "after") -> DataFrame:
    """(key, raw_label, mapped_column): drifted labels whose value ended up in a column.

    Equi-join on (correction, trimmed value); of labels that differ only in
    case the first per column stays.
    """
    value = F.nullif(strip(F.col("value")), F.lit(""))
    left = corrections.select(key, F.posexplode(F.map_entries(drift)).alias("pos", "e")).select(
        key, "pos", F.col("e.key").alias("raw_label"), F.col("e.value").alias("value")
    ).withColumn("value", value).where("value IS NOT NULL")
    right = corrections.select(key, F.explode(after).alias("mapped_column", "value")).withColumn("value", value).where(
        F.col("value").isNotNull() & ~F.col("mapped_column").isin(PATCH_SKIP_KEYS)
    )
    pairs = left.join(right, [key, "value"]).where("raw_label <> mapped_column")
    label = F.lower(strip(F.col("raw_label")))
    return pairs.groupBy(key, label.alias("_label"), "mapped_column").agg(F.min_by("raw_label", "pos").alias("raw_label")).drop("_label")


def dictionary_events(mappings: DataFrame) -> DataFrame:
    """New synonyms as create events of the dictionary feed."""
    after = F.struct("tenant_id", "target_table", "raw_label", "mapped_column")
    return mappings.select(F.struct(F.lit("c").alias("op"), after.alias("after")).alias("payload"))


def critic_needle(error: Column, rule_id: Column | None = None) -> Column:
    """What to look for in earlier errors: the rule id, else the whole error."""
    named = presence(F.regexp_extract(error, r"(?i)\[([a-z0-9_.]+)\]", 1))
    found = F.coalesce(named, error)
    return found if rule_id is None else F.coalesce(presence(rule_id), found)


def few_shot(
    corrections: DataFrame, needles: DataFrame, limit: int = 3, tie: str = "id", considered: int | None = None
) -> DataFrame:
    """Best corrections per (tenant_id, target_table).

    Those whose error contains the needle come first, then the newest.
    ``considered`` restricts the choice to so many of the newest.
    ``needles``: tenant_id, target_table, needle.  Row-number filters are
    pushed below the shuffle as group limits.
    """
    keys = ["tenant_id", "target_table"]
    recent = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col(tie))
    newest = corrections
    if considered is not None:
        newest = corrections.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= considered).drop("_r")
    joined = newest.join(needles, keys)
    hit = F.lower(F.coalesce("critic_error", F.lit(""))).contains(F.lower("needle")) & presence(F.col("needle")).isNotNull()
    scored = joined.withColumn("match_score", F.when(hit, 10).otherwise(0))
    best = Window.partitionBy(*keys).orderBy(F.col("match_score").desc(), F.col("created_at").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("needle")


def few_shot_text(patches: Column, error: Column, limit: int | None = None) -> Column:
    """One example as prompt text; all patches, or the first ``limit``."""
    lines = F.transform(
        patches if limit is None else F.slice(patches, 1, limit),
        lambda p: F.concat(p["column"], F.lit(": "), F.coalesce(p["before"], F.lit("null")), F.lit(" → "), F.coalesce(p["after"], F.lit("null"))),
    )
    return F.concat_ws("\n", F.concat(F.lit("critic was "), F.coalesce(error, F.lit(""))), F.array_join(lines, "\n"))


def to_golden(corrections: DataFrame) -> DataFrame:
    """Corrections in golden-document shape: cells from the patches, else from the row."""
    cell = lambda name, value: F.struct(
        F.lit(0).alias("row_index"), name.alias("column"), value.alias("value"), F.lit(0.01).alias("tolerance")
    )
    from_patches = F.transform("field_patches", lambda p: cell(p["column"], p["after"]))
    plain = F.map_filter("after", lambda k, _: ~k.isin(PATCH_SKIP_KEYS) & ~k.startswith("context_") & ~k.startswith("_"))
    from_row = F.transform(F.map_entries(plain), lambda e: cell(e["key"], e["value"]))
    table = F.coalesce(presence(F.col("target_table")), F.lit("UNKNOWN_TABLE"))
    return corrections.select(
        F.concat(F.lit("hitl_"), F.coalesce(presence(F.col("document_id")), F.lit("correction"))).alias("document_id"),
        table.alias("target_table"),
        table.alias("predicted_table"),
        F.col("after").alias("extracted_row"),
        F.when(F.size("field_patches") > 0, from_patches).otherwise(from_row).alias("cells"),
        F.lit("hitl_correction").alias("_source"),
        F.col("id").alias("_correction_id"),
        F.col("critic_error").alias("_critic_error"),
        F.concat_ws("_", F.lit("hitl"), file_slug(table), file_slug(F.col("id").cast("string"))).alias("file_name"),
    )


def mark_promoted(corrections: DataFrame, promoted: DataFrame) -> DataFrame:
    """Set the promoted flag of the listed ids."""
    ids = promoted.select(F.col("id"), F.lit(True).alias("_p")).distinct()
    joined = corrections.join(ids, "id", "left")
    return joined.withColumn("promoted", F.coalesce("_p", "promoted")).drop("_p")


def review_issues(
    tables: DataFrame, limit: int | None = None
) -> DataFrame:
    """Issues and summary for a reviewer, per table.

    Input per table: key columns plus target_table, metas ``array<map>`` (one
    per row), drifted ``array<string>``, errors ``array<string>``.  One issue
    per row error and per unmapped field, then per drifted column and error
    not covered yet; all are listed, or the first ``limit``, and all are counted.
    """
    issue = lambda row, column, current, text, question: F.struct(
        row.alias("row_index"), column.alias("column"), current.alias("current_value"),
        text.alias("issue"), question.alias("question"),
    )
    none = F.lit(None).cast("string")
    label = F.col("target_table")
    row_issues = F.flatten(
        F.transform(
            "metas",
            lambda m, i: F.transform(
                F.array_sort(F.map_entries(m), lambda a, b: (b["key"] == "critic_error").cast("int") - (a["key"] == "critic_error").cast("int")),
                lambda e: F.when(
                    e["key"] == "critic_error",
                    issue(i, F.lit("(row)"), none, e["value"], F.concat(F.lit("Row "), i.cast("string"), F.lit(": verification failed. Approve a corrected row?"))),
                ).otherwise(
                    issue(i, e["key"], e["value"], F.concat(F.lit("unmapped column on "), label), F.concat(F.lit("Row "), i.cast("string"), F.lit(": map '"), e["key"], F.lit("' or discard?")))
                ),
            ),
        )
    )
    staged = tables.withColumn("_rows", row_issues)
    zero = F.lit(0)
    drift_issues = F.transform(
        F.filter("drifted", lambda c: ~F.exists("_rows", lambda i: i["column"] == c)),
        lambda c: issue(zero, c, none, F.concat(F.lit("no registered column on "), label), F.concat(F.lit("Map '"), c, F.lit("' on "), label, F.lit("?"))),
    )
    error_issues = F.transform(
        F.filter("errors", lambda e: (e != "") & ~F.exists("_rows", lambda i: i["issue"].contains(e))),
        lambda e: issue(zero, F.lit("(verification)"), none, e, F.lit("Approve corrected data?")),
    )
    fallback = F.array(issue(zero, F.lit("(table)"), none, F.lit("needs human review"), F.concat(F.lit("Approve or reject the mapping of "), label, F.lit("?"))))
    listed = staged.withColumn("_all", F.concat("_rows", drift_issues, error_issues))
    listed = listed.withColumn("_all", F.when(F.size("_all") > 0, F.col("_all")).otherwise(fallback))
    summary = F.concat_ws(
        " ",
        F.concat(F.lit("Review of "), label, F.lit(" with "), F.size("_all").cast("string"), F.lit(" issue(s).")),
        F.when(F.size("drifted") > 0, F.concat(F.lit("Drifted columns: "), F.array_join("drifted", ", "), F.lit("."))),
        F.when(F.size("errors") > 0, F.concat(F.lit("Critic: "), F.get("errors", F.lit(0)))),
    )
    return listed.withColumns({"summary": summary, "issues": F.col("_all") if limit is None else F.slice("_all", 1, limit)}).drop("_rows", "_all")


def review_message(summary: Column, issues: Column, target_table: Column, drifted: Column, questions: int | None = None) -> Column:
    """Summary with its questions, or the first few; without a summary a line on the drift."""
    asked = F.filter(F.transform(issues if questions is None else F.slice(issues, 1, questions), lambda i: i["question"]), lambda q: presence(q).isNotNull())
    with_summary = F.concat_ws(" | ", summary, presence(F.array_join(asked, " · ")))
    table = F.coalesce(target_table, F.lit("unknown"))
    no_summary = F.when(
        F.size(drifted) > 0,
        F.concat(F.lit("Schema anomaly on "), table, F.lit(": drifted columns detected ("), F.array_join(drifted, ", "), F.lit(")")),
    ).otherwise(F.concat(F.lit("Schema anomaly on "), table, F.lit(": high unmapped ratio or missing expected columns")))
    return F.when(presence(summary).isNotNull(), with_summary).otherwise(no_summary)
