"""Documents, jobs, reviews and tasks: the listing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hof import presence
from .views import at_most

ACTIVE = ("PENDING", "IN_PROGRESS", "EXTRACTING")
TERMINAL = ("COMPLETED", "FAILED", "DUPLICATE")


def document_catalog(jobs: DataFrame, rows: DataFrame, tenant: str | None = None) -> DataFrame:
    """Jobs and stored rows side by side, whichever exists.

    Full outer on the document; a job of another tenant does not match, a job
    without tenant matches any.  Labels come from the job, then from the bags.
    """
    keyed = rows.where(presence(F.col("document_id")).isNotNull())
    label = lambda *keys: F.coalesce(*[F.col(b)[k] for k in keys for b in ("strict", "unmapped")])
    bags = keyed.select(
        F.col("document_id").alias("e_document"), F.col("tenant_id").alias("e_tenant"),
        label("company_name", "Company Name").alias("e_company"),
        label("ticker", "Ticker").alias("e_ticker"),
        label("fiscal_period", "Period").alias("e_period"),
    ).distinct()
    on = (F.col("j.document_id") == F.col("e.e_document")) & (
        (F.col("j.tenant_id") == F.col("e.e_tenant")) | F.col("j.tenant_id").isNull()
    )
    both = jobs.alias("j").join(bags.alias("e"), on, "full_outer")
    if tenant is not None and tenant != "default-tenant":
        both = both.where((F.col("j.tenant_id") == tenant) | (F.col("e.e_tenant") == tenant) | F.col("j.tenant_id").isNull())
    document = F.coalesce("j.document_id", "e.e_document")
    return both.select(
        document.alias("document_id"),
        F.coalesce("j.filename", F.concat(F.lit("Document "), document)).alias("filename"),
        F.coalesce("j.company_name", "e.e_company").alias("company_name"),
        F.coalesce("j.ticker", "e.e_ticker").alias("ticker"),
        F.coalesce("j.fiscal_period", "e.e_period").alias("fiscal_period"),
    )


def tables_per_document(rows: DataFrame, tenant: str | None = None) -> DataFrame:
    """Sorted distinct target tables of each document."""
    scoped = rows if tenant is None else rows.where(F.col("tenant_id") == tenant)
    named = scoped.where(presence(F.col("target_table")).isNotNull())
    return named.groupBy("document_id").agg(F.array_sort(F.collect_set("target_table")).alias("tables"))


def with_job_uri(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Review or dead-letter rows with the uri of their job, where there is one."""
    return entries.join(jobs.select("document_id", "s3_uri"), "document_id", "left")


def newest(df: DataFrame, by: str = "created_at", limit: int | None = None, tie: str | Column | None = None) -> DataFrame:
    """Newest first, equal times by ``tie``; the first ``limit`` if asked."""
    order = [F.col(by).desc_nulls_last()] + ([] if tie is None else [F.col(tie) if isinstance(tie, str) else tie])
    return at_most(df.orderBy(*order), limit)


def pending_reviews(reviews: DataFrame, jobs: DataFrame, tenant: str, limit: int | None = None) -> DataFrame:
    chosen = reviews.where((F.col("tenant_id") == tenant) & (F.col("status") == "PENDING"))
    return with_job_uri(newest(chosen, limit=limit, tie="id"), jobs)


def dead_letters(entries: DataFrame, jobs: DataFrame, tenant: str, limit: int | None = None) -> DataFrame:
    return with_job_uri(newest(entries.where(F.col("tenant_id") == tenant), limit=limit, tie="task_id"), jobs)


def recent_jobs(jobs: DataFrame, tenant: str, now: Column | None = None, limit: int | None = None) -> DataFrame:
    """Active jobs and those touched within 24 hours, newest first."""
    now = F.current_timestamp() if now is None else now
    chosen = jobs.where(F.col("tenant_id") == tenant).where(
        F.col("status").isin(*ACTIVE) | (F.col("updated_at") > now - F.expr("INTERVAL 24 HOURS"))
    )
    return newest(chosen, "updated_at", limit, "document_id")


def job_of(jobs: DataFrame, document: str, tenant: str) -> DataFrame:
    return jobs.where((F.col("document_id") == document) & (F.col("tenant_id") == tenant))


def retry_event(job: DataFrame) -> DataFrame:
    """A job row as a new ingest event."""
    return job.select(
        F.col("document_id").alias("event_id"), "tenant_id", "s3_uri",
        F.col("file_hash").alias("file_hash_sha256"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.create_map(F.lit("original_filename"), F.col("filename")).alias("metadata"),
    )


def active_count(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("tenant_id").agg(F.count_if(~F.col("status").isin(*TERMINAL)).alias("active"))


def latest_jobs(events: DataFrame, order: str = "updated_at") -> DataFrame:
    """Newest non-empty value of each field per document."""
    fields = [c for c in events.columns if c not in ("document_id", order)]
    newest_value = lambda c: F.max_by(c, F.when(presence(F.col(c).cast("string")).isNotNull(), F.col(order)))
    return events.groupBy("document_id").agg(*[newest_value(c).alias(c) for c in fields], F.max(order).alias(order))


def review_source(reviews: DataFrame, letters: DataFrame, tenant: str) -> DataFrame:
    """One entry per document: a review row before a dead letter, oldest first."""
    tagged = reviews.select("tenant_id", "document_id", "id", "payload", "created_at", F.lit(0).alias("source_rank")).unionByName(
        letters.select("tenant_id", "document_id", F.col("task_id").alias("id"), "payload", "created_at", F.lit(1).alias("source_rank"))
    )
    scoped = tagged.where(F.col("tenant_id") == tenant)
    first = F.min(F.struct("source_rank", "created_at", "id", "payload"))
    return scoped.groupBy("document_id").agg(first.alias("e")).select("document_id", "e.id", "e.source_rank", "e.payload")


def all_review_entries(reviews: DataFrame, letters: DataFrame) -> DataFrame:
    return reviews.unionByName(letters.withColumnRenamed("task_id", "id"), allowMissingColumns=True)


def resolve_reviews(reviews: DataFrame, decisions: DataFrame, discard: bool = False) -> DataFrame:
    """Apply decisions (tenant_id, document_id, new_status): drop the rows or set their status."""
    keys = ["tenant_id", "document_id"]
    if discard:
        return reviews.join(decisions.select(*keys), keys, "left_anti")
    joined = reviews.join(decisions.select(*keys, F.col("new_status").alias("_s")), keys, "left")
    return joined.withColumn("status", F.coalesce("_s", "status")).drop("_s")


def waiting_rows(rows: DataFrame, table: str) -> DataFrame:
    """Rows in review that a new schema could settle."""
    return rows.where((F.col("mapping_status") == "NEEDS_REVIEW") & F.col("target_table").isin(table, "UNKNOWN_TABLE"))


def promotable_rows(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Waiting rows of each changed schema, with the schema as their new table.

    ``changes`` holds (op, target_table).  A row of an unknown table is
    offered to every changed schema.  Rows are not shuffled.
    """
    tables = changes.where(F.col("op").isin("c", "u") & presence(F.col("target_table")).isNotNull())
    # one value: the names of the changed schemas, at most as many as the registry has
    names = tables.agg(F.sort_array(F.collect_set("target_table")).alias("names")).scalar()
    own = F.when(F.array_contains(names, F.col("target_table")), F.array("target_table"))
    offered = F.when(F.col("target_table") == "UNKNOWN_TABLE", names).otherwise(own)
    waiting = rows.where("mapping_status = 'NEEDS_REVIEW'")
    return waiting.withColumn("_schema", F.explode(offered)).drop("target_table").withColumnRenamed("_schema", "target_table")


def work_list(tasks: DataFrame, agents: DataFrame, tenant: str, limit: int | None = None) -> DataFrame:
    named = tasks.where(F.col("tenant_id") == tenant).join(
        agents.select(F.col("id").alias("agent_id"), F.col("name").alias("agent_name")), "agent_id"
    )
    return newest(named, "updated_at", limit, "id")


def with_prompt(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Tasks with the prompt of their agent, null when the agent is gone."""
    return tasks.join(agents.select(F.col("id").alias("agent_id"), "system_prompt"), "agent_id", "left")


def owned(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose owner exists."""
    return rows.join(owners.select(*keys), keys, "left_semi")


def claimable_tasks(tasks: DataFrame, now: Column, stale_seconds: int, limit: int = 1) -> DataFrame:
    """Queued tasks and running ones whose lock is stale, oldest first."""
    stale = F.col("locked_at") < now - F.make_dt_interval(secs=F.lit(stale_seconds))
    chosen = tasks.where((F.col("status") == "QUEUED") | ((F.col("status") == "RUNNING") & stale))
    return chosen.orderBy("created_at", "id").limit(limit)


def token_totals(turns: DataFrame) -> DataFrame:
    return turns.groupBy("thread_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("turns")
    )


def resolve_document(catalog: DataFrame, question: str, order: str = "document_id") -> DataFrame:
    """The document a question names by company, ticker (three letters or more) or file.

    Without a match the first document; one row.
    """
    text = F.lit(question.lower())
    names = lambda c, least=1: (F.length(c) >= least) & text.contains(F.lower(c))
    named = F.coalesce(names(F.col("company_name")), F.lit(False)) | F.coalesce(names(F.col("ticker"), 3), F.lit(False)) | F.coalesce(names(F.col("filename")), F.lit(False))
    return catalog.groupBy().agg(
        F.min(F.struct((~named).alias("miss"), F.col(order).alias("ord"), F.col("document_id").alias("document_id"))).alias("e")
    ).select("e.document_id")


def corrections_list(corrections: DataFrame, tenant: str, table: str | None = None, unpromoted: bool = False, limit: int | None = None) -> DataFrame:
    """Corrections of a tenant, newest first; of equal times the largest id first."""
    chosen = corrections.where(F.col("tenant_id") == tenant)
    if table:
        chosen = chosen.where(F.col("target_table") == table)
    if unpromoted:
        chosen = chosen.where(~F.col("promoted"))
    return newest(chosen, limit=limit, tie=F.col("id").desc())


def unpromoted_corrections(corrections: DataFrame, limit: int | None = None) -> DataFrame:
    """Waiting corrections, newest first; of equal times the largest id first."""
    return newest(corrections.where(~F.col("promoted")), limit=limit, tie=F.col("id").desc())
