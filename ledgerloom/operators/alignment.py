"""Header alignment: synonyms, drift, batches, multi-period rows, routing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BATCH_LOOK_BACK, CONTEXT_COLUMNS, META_KEYS, ROWS_PER_BATCH
from ..functions.hof import let, merge_maps, presence, strip
from ..functions.numerics import literal_map
from ..registry import Registry, default_aliases

_NO_MAP = "map<string,string>"


def synonym_maps(synonyms: DataFrame) -> DataFrame:
    """(tenant_id, target_table, synonyms map) from label rows.

    Rows: tenant_id, target_table, raw_label, mapped_column and a sequence
    ``seq``; the newest row of a label wins.  Labels are kept as written and
    also trimmed in lower case.
    """
    both = synonyms.select(
        "tenant_id", "target_table", "mapped_column", "seq",
        F.explode(F.array_distinct(F.array("raw_label", F.lower(strip(F.col("raw_label")))))).alias("label"),
    )
    newest = both.groupBy("tenant_id", "target_table", "label").agg(F.max_by("mapped_column", "seq").alias("mapped"))
    return newest.groupBy("tenant_id", "target_table").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "mapped"))).alias("synonyms")
    )


def add_synonym(synonyms: DataFrame, tenant: str, table: str, label: str, column: str) -> DataFrame:
    """The label table with one newer row."""
    newest = synonyms.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    row = newest.select(
        F.lit(tenant).alias("tenant_id"), F.lit(table).alias("target_table"),
        F.lit(label).alias("raw_label"), F.lit(column).alias("mapped_column"), "seq",
    )
    return synonyms.unionByName(row)


def synonym_versions(changes: DataFrame) -> DataFrame:
    """(tenant_id, target_table, synonyms) from a change feed of labels, with all versions of each label.

    Changes: op, tenant_id, target_table, raw_label, mapped_column, and the
    time ``at`` from which they hold (of equal times the larger ``seq``
    counts).  ``synonyms`` maps a label, as written and trimmed in lower case,
    to its versions, newest first; a deletion is a version without a column.
    """
    mapped = F.when(F.col("op").isin("c", "u"), F.col("mapped_column"))
    both = changes.where(F.col("op").isin("c", "u", "d")).select(
        "tenant_id", "target_table", "at", "seq", mapped.alias("mapped"),
        F.explode(F.array_distinct(F.array("raw_label", F.lower(strip(F.col("raw_label")))))).alias("label"),
    )
    one = both.groupBy("tenant_id", "target_table", "label", "at").agg(F.max_by("mapped", "seq").alias("mapped"))
    versions = one.groupBy("tenant_id", "target_table", "label").agg(
        F.sort_array(F.collect_list(F.struct("at", "mapped")), asc=False).alias("versions")
    )
    return versions.groupBy("tenant_id", "target_table").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "versions"))).alias("synonyms")
    )


def remap_drift(rows: DataFrame, synonyms: DataFrame, registry: Registry, aliases: dict[str, str] | None = None,
                at: str | None = None) -> DataFrame:
    """Move drifted labels into empty registry columns of the same row.

    With ``at``, a time column of the rows, ``synonyms`` is a change feed (see
    ``synonym_versions``) and each row meets the dictionary of its own time,
    so a late row is mapped as it would have been then.

    Rows: tenant_id, target_table, strict map, drift map.  A label is looked
    up as written, then trimmed in lower case (per tenant and table), then
    among the global aliases.  Only an empty registry column is filled, and
    only once; everything else stays in the drift bag.  The look-up happens
    inside the row, so rows are joined once to a map per (tenant, table) and
    never exploded.
    """
    alias = literal_map(aliases or default_aliases())
    columns = F.create_map(
        *[x for t, cols in registry.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in [*CONTEXT_COLUMNS, *cols]]))]
    )
    known = synonym_maps(synonyms) if at is None else synonym_versions(synonyms)

    def look(label: Column) -> Column:
        found = F.col("synonyms")[label]
        return found if at is None else F.get(F.filter(found, lambda v: v["at"] <= F.col(at)), F.lit(0))["mapped"]

    joined = rows.join(known, ["tenant_id", "target_table"], "left").withColumn(
        "_columns", columns[F.col("target_table")]
    )
    key = lambda k: F.lower(strip(k))
    labelled = F.transform(
        F.map_entries("drift"),
        lambda e: F.struct(
            e["key"].alias("key"),
            e["value"].alias("value"),
            F.coalesce(look(e["key"]), look(key(e["key"])), alias[key(e["key"])]).alias("target"),
        ),
    )
    open_column = lambda e: (
        F.coalesce(F.array_contains("_columns", e["target"]), F.lit(False))
        & presence(strip(F.coalesce(F.col("strict")[e["target"]], F.lit("")))).isNull()
    )
    fits = lambda all_: F.filter(all_, open_column)
    winners = let(
        labelled,
        lambda all_: let(
            fits(all_),
            lambda ok: F.filter(ok, lambda e, i: ~F.exists(F.slice(ok, F.lit(1), i), lambda p: p["target"] == e["target"])),
        ),
    )
    staged = joined.withColumn("_won", F.coalesce(winners, F.expr("cast(array() as array<struct<key:string,value:string,target:string>>)")))
    filled = F.map_from_entries(F.transform("_won", lambda e: F.struct(e["target"], e["value"])))
    taken = F.transform("_won", lambda e: e["key"])
    return staged.withColumn("strict", merge_maps(F.col("strict"), filled)).withColumn(
        "drift", F.map_filter("drift", lambda k, _: ~F.array_contains(taken, k))
    ).drop("_won", "_columns", "synonyms")


def drift_only(bag: Column) -> Column:
    """The bag without bookkeeping keys."""
    return F.map_filter(bag, lambda k, _: ~k.isin(META_KEYS))


def populated(strict: Column) -> Column:
    """Number of filled metric columns (context and underscore keys do not count)."""
    kept = F.map_filter(
        strict,
        lambda k, v: ~k.startswith("context_") & ~k.startswith("_") & presence(strip(F.coalesce(v, F.lit("")))).isNotNull(),
    )
    return F.size(kept)


def drift_ratio(strict: Column, bag: Column) -> Column:
    drift = F.size(drift_only(bag))
    total = drift + populated(strict)
    return F.coalesce(drift / F.nullif(total, F.lit(0)), F.lit(0.0))


def drifted_columns(rows: DataFrame, keys: list[str], position: str = "row_index") -> DataFrame:
    """(keys, column, first_row): each drift label once, with where it first occurs."""
    seen = rows.select(*keys, F.col(position).alias("_p"), F.posexplode(F.map_keys(drift_only(F.col("drift")))))
    return seen.groupBy(*keys, F.col("col").alias("column")).agg(
        F.min(F.struct(F.col("_p").alias("row"), F.col("pos"))).alias("first_seen")
    )


def drifted_column_list(rows: DataFrame, keys: list[str], position: str = "row_index") -> DataFrame:
    """Labels in the order they first occur, one array per key."""
    first = drifted_columns(rows, keys, position)
    ordered = F.array_sort(F.collect_list(F.struct("first_seen", "column")))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda s: s["column"]).alias("drifted_columns"))


def row_batches(
    rows: DataFrame, keys: list[str], position: str, payload: list[str],
    size: int = ROWS_PER_BATCH, look_back: int = BATCH_LOOK_BACK,
) -> DataFrame:
    """Batches of ``size`` rows with the ``look_back`` rows before them.

    Positions are dense from 0, so the batch number is arithmetic; the last
    rows of a batch are sent to the next one as its context.  A group never
    exceeds ``size + look_back`` rows.
    """
    batch = F.floor(F.col(position) / size)
    homes = F.array_compact(
        F.array(
            F.struct(batch.alias("batch"), F.lit(False).alias("context")),
            F.when(F.col(position) % size >= size - look_back, F.struct((batch + 1).alias("batch"), F.lit(True).alias("context"))),
        )
    )
    spread = rows.withColumn("_h", F.explode(homes))
    row = F.struct(F.col(position), *payload)
    pick = lambda ctx: F.array_sort(F.collect_list(F.when(F.col("_h.context") == ctx, row)))
    grouped = spread.groupBy(*keys, F.col("_h.batch").alias("batch")).agg(
        pick(False).alias("target_rows"), pick(True).alias("context_rows")
    )
    return grouped.where(F.size("target_rows") > 0)


YEAR_KEY = r"(?i)^\s*(?:fy)?((?:20|19)\d\d)\s*$"


def unpivot_years(rows: DataFrame, bag: str = "data") -> DataFrame:
    """Rows with two or more year columns become one row per year.

    Adds ``context_reporting_period``, ``amount`` and ``is_restatement`` to
    the bag; the other columns are kept.  Rows with fewer pass unchanged.
    """
    m = F.col(bag)
    years = F.map_filter(m, lambda k, _: k.rlike(YEAR_KEY))
    rest = F.map_filter(m, lambda k, _: ~k.rlike(YEAR_KEY))
    staged = rows.withColumns({"_years": years, "_rest": rest})
    entries = F.when(
        F.size("_years") > 1,
        F.transform(F.map_entries("_years"), lambda e: F.struct(F.regexp_extract(e["key"], YEAR_KEY, 1).alias("period"), e["value"].alias("amount"))),
    ).otherwise(F.array(F.expr("cast(null as struct<period:string,amount:string>)")))
    out = staged.withColumn("_e", F.explode(entries))
    added = F.create_map(
        F.lit("context_reporting_period"), F.col("_e.period"), F.lit("amount"), F.col("_e.amount"), F.lit("is_restatement"), F.lit("false")
    )
    new = F.when(F.col("_e").isNull(), m).otherwise(merge_maps(F.col("_rest"), added))
    return out.withColumn(bag, new).drop("_years", "_rest", "_e")


def unpivot_wide(df: DataFrame, ids: list[str], columns: list[str], period: str = "period", amount: str = "amount") -> DataFrame:
    """Year columns of a wide table to rows."""
    labelled = df.unpivot(ids, columns, "_column", amount)
    year = F.regexp_extract("_column", r"(?i)(?:fy)?_?((?:20|19)\d\d)$", 1)
    return labelled.select(*ids, year.alias(period), amount, F.lit(False).alias("is_restatement"))


def route_rows(rows: DataFrame, keys: list[str] | None = None, table_status: str = "table_status") -> DataFrame:
    """Adds ``route``: pass, review or fail, row by row.

    A row with a hard failure fails; a table failed as a whole fails its rows
    without a status of their own, and all its rows when ``keys`` names the
    table and none of them failed by itself; review rows go to review.
    """
    status, table = F.col("row_status"), F.col(table_status)
    no_status = presence(status).isNull()
    failed = (status == "FAILED_VERIFICATION") | ((table == "FAILED_VERIFICATION") & no_status)
    routed = rows.withColumn(
        "route",
        F.when(failed, "fail")
        .when((status == "NEEDS_REVIEW") | ((table == "NEEDS_REVIEW") & ~status.eqNullSafe("MAPPED")), "review")
        .otherwise("pass"),
    )
    if keys is None:
        return routed
    whole = (
        routed.where(table == "FAILED_VERIFICATION")
        .groupBy(*keys)
        .agg(F.count_if(F.col("route") == "fail").alias("_n"))
        .where("_n = 0")
    )
    return routed.join(whole, keys, "left").withColumn(
        "route", F.when(F.col("_n").isNotNull(), "fail").otherwise(F.col("route"))
    ).drop("_n")


def error_list(rows: DataFrame, keys: list[str], position: str = "row_index", error: str = "critic_error") -> DataFrame:
    """(keys, error, first_row, rows): distinct errors with where they first occur."""
    return rows.where(presence(F.col(error)).isNotNull()).groupBy(*keys, F.col(error).alias("error")).agg(
        F.min(position).alias("first_row"), F.count(F.lit(1)).alias("rows")
    )


def merged_errors(rows: DataFrame, keys: list[str], position: str = "row_index", error: str = "critic_error", distinct: bool = True) -> DataFrame:
    """All errors of a table in row order, joined by ``; ``."""
    if distinct:
        listed = error_list(rows, keys, position, error).select(*keys, F.struct(F.col("first_row"), F.col("error")).alias("e"))
    else:
        listed = rows.where(presence(F.col(error)).isNotNull()).select(*keys, F.struct(F.col(position).alias("first_row"), F.col(error).alias("error")).alias("e"))
    return listed.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["error"]), "; ").alias("critic_error")
    )


def review_errors(rows: DataFrame, keys: list[str], attempts: DataFrame | None = None) -> DataFrame:
    """Errors of failed rows; where none is recorded, those of the attempts."""
    failed = error_list(rows.where("route = 'fail'"), keys).select(*keys, "error", F.col("first_row").cast("long").alias("ord"))
    if attempts is None:
        return failed
    spare = attempts.join(failed.select(*keys).distinct(), keys, "left_anti").select(*keys, "error", F.col("attempt").cast("long").alias("ord"))
    return failed.unionByName(spare)


def structure_preflight(report: Column) -> Column:
    """Violations handed down by an upstream structure report (see ``structure_report``)."""
    hint = F.lit("Read the grid again; broken tables are not aligned.")
    as_violation = lambda i: F.struct(
        F.lit(0).alias("seq"), i["rule_id"].alias("rule_id"), i["severity"].alias("severity"), i["message"].alias("message"),
        F.array().cast("array<string>").alias("fields"), F.lit(None).cast("double").alias("expected"),
        F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("delta"), hint.alias("hint"),
    )
    blank = F.struct(
        F.lit("table.structure").alias("rule_id"), F.lit("hard").alias("severity"), F.lit("upstream structure check failed").alias("message")
    )
    bare = F.when(~report["ok"] & (F.size(report["issues"]) == 0), F.array(as_violation(blank)))
    return F.coalesce(bare, F.transform(report["issues"], as_violation))


def approve_generic(rows: DataFrame) -> DataFrame:
    """Unmapped rows stored as they are."""
    return rows.withColumns(
        {"mapping_status": F.lit("GENERIC_APPROVED"), "strict": F.create_map().cast(_NO_MAP)}
    )


def requeue(rows: DataFrame) -> DataFrame:
    """Stored rows as new raw payloads; the unmapped bag wins on shared keys."""
    return rows.select(
        F.col("id").alias("row_id"), "document_id", "tenant_id", "target_table",
        merge_maps(F.col("strict"), F.col("unmapped")).alias("extracted_data"),
    )


def patch_rows(rows: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge patch maps into the strict bag of the matching rows, which become mapped."""
    hit = rows.join(patches.select(*keys, F.col("updates").alias("_u")), keys, "left")
    return hit.withColumns(
        {
            "strict": F.when(F.col("_u").isNull(), F.col("strict")).otherwise(merge_maps(F.col("strict"), F.col("_u"))),
            "mapping_status": F.when(F.col("_u").isNull(), F.col("mapping_status")).otherwise("MAPPED"),
        }
    ).drop("_u")


def apply_correction(data: Column, value: Column, field: Column) -> Column:
    """A JSON object replaces the data; plain text sets one field; else null."""
    whole = F.when(value.rlike(r"(?U)^\s*\{"), F.from_json(value, _NO_MAP))
    one = F.when(presence(field).isNotNull() & data.isNotNull(), merge_maps(data, F.create_map(field, value)))
    return F.coalesce(whole, one)
