"""Relational operators over the document store: DataFrame in, DataFrame out, all left to Catalyst."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Life cycles and their terminal parts.
DOCUMENT_STATUSES = ["uploaded", "queued", "processing", "needs_review", "completed", "rejected", "failed"]
TERMINAL, SUCCEEDED, IN_FLIGHT = ["completed", "needs_review", "rejected", "failed"], ["completed", "needs_review"], ["queued", "processing"]
STAGES = ["file_validation", "text_extraction", "ocr", "classification", "schema_selection", "structured_extraction", "business_validation", "confidence_scoring", "review_routing", "persistence"]
STALE_SECONDS, MAX_ATTEMPTS, MAX_FAILURES = 1800, 5, 20


def scoped(df: DataFrame, organization: str) -> DataFrame:
    """The rows of one tenant: the only way into tenant data."""
    return df.where(F.col("organization_id") == organization)


def list_page(docs: DataFrame, status: str | None = None, kind: str | None = None, needs_review: bool | None = None, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of documents, newest first, each row with the total of the filtered list."""
    if status is not None:
        docs = docs.where(F.col("status") == status)
    if kind is not None:
        docs = docs.where(F.col("document_type_key") == kind)
    if needs_review is not None:
        docs = docs.where(F.col("needs_review") == needs_review)
    if search:
        docs = docs.where(F.col("filename").ilike(f"%{search}%"))
    total = docs.agg(F.count("*").alias("total"))
    return docs.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit).join(F.broadcast(total), how="left")  # total is one row


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def latest_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def supersede(extractions: DataFrame) -> DataFrame:
    """is_current and status derived: only the greatest revision of a document is current."""
    last = F.max("revision").over(Window.partitionBy("document_id"))
    return extractions.withColumn("is_current", F.col("revision") == last).withColumn("status", F.when(F.col("is_current"), F.col("status")).otherwise("superseded"))


def next_revision(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    done = extractions.groupBy("document_id").agg(F.max("revision").alias("last"))
    return documents.join(done, documents.id == done.document_id, "left").select("id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("next_revision"))


def review_queue(extractions: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Current extractions that need a look, least sure first, unknown before all."""
    waiting = extractions.where(F.col("is_current") & F.col("needs_review") & (F.col("status") == "needs_review"))
    return waiting.orderBy(F.asc_nulls_first("overall_confidence"), "id").offset(offset).limit(limit)


def replace_issues(old: DataFrame, new: DataFrame) -> DataFrame:
    """New issues take the place of all old ones of the extractions that they belong to."""
    return old.join(new.select("extraction_id").distinct(), "extraction_id", "left_anti").unionByName(new)


def correction_stats(corrections: DataFrame, limit: int = 50) -> DataFrame:
    return corrections.groupBy("document_type_key", "field_path").agg(F.count("*").alias("corrections")).orderBy(F.desc("corrections"), "document_type_key", "field_path").limit(limit)


def period_totals(usage: DataFrame) -> DataFrame:
    """One row, zeros for an empty period."""
    dec = F.col("cost_usd").cast("decimal(18,6)")
    return usage.agg(F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum(dec), F.lit(0)).cast("decimal(28,6)").alias("cost_usd"))


def daily_series(usage: DataFrame, since: dt.datetime) -> DataFrame:
    """Days with usage only: gaps stay gaps."""
    day = F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd")
    return usage.where(F.col("created_at") >= F.lit(since)).groupBy(day.alias("day")).agg(F.count("*").alias("calls"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("cost_usd"))


def dashboard(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row of rates: two aggregates, each over one scan. A rate without a denominator is null."""
    among = lambda some: F.count_if(F.col("status").isin(*some))
    left = docs.agg(
        F.count("*").alias("total_documents"), F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.round(F.try_divide(among(SUCCEEDED), among(TERMINAL)), 4).alias("success_rate"), F.avg("processing_ms").alias("avg_processing_ms"),
    )
    right = extractions.where("is_current").agg(F.round(F.try_divide(F.count_if("needs_review"), F.count("*")), 4).alias("review_rate"))
    return left.join(F.broadcast(right), how="left")  # one row each


def active_keys(keys: DataFrame, now: Column) -> DataFrame:
    return keys.where(~F.col("is_revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def types_for(types: DataFrame, organization: str) -> DataFrame:
    """Own and global active types, the greatest version of each key, own before global."""
    mine = types.where(F.col("is_active") & (F.col("organization_id").isNull() | (F.col("organization_id") == organization)))
    return latest_by(mine, "key", F.col("organization_id").isNull(), F.desc("version"))


def webhooks_for(endpoints: DataFrame, event: str) -> DataFrame:
    return endpoints.where(F.col("is_active") & ((F.size("events") == 0) | F.array_contains("events", event)))


def stale(docs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Documents that have been processing for too long, over all tenants."""
    return docs.where((F.col("status") == "processing") & (F.col("processing_started_at") < now - F.expr(f"INTERVAL {seconds} SECONDS")))


def content_dedupe(docs: DataFrame) -> DataFrame:
    """duplicate_of: the first document of the same content in the tenant, null for that first one."""
    first = F.min("id").over(Window.partitionBy("organization_id", "checksum_sha256"))
    return docs.withColumn("duplicate_of", F.when(F.col("id") != first, first))


def idempotent(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """jobs with the incoming ones whose (organization, key) is new; of equal incoming ones the least id."""
    known = jobs.select(F.col("organization_id").alias("__o"), F.col("idempotency_key").alias("__k"))
    fresh = incoming.join(known, F.col("organization_id").eqNullSafe(F.col("__o")) & F.col("idempotency_key").eqNullSafe(F.col("__k")), "left_anti")
    first = Window.partitionBy("organization_id", "idempotency_key").orderBy("id")
    return jobs.unionByName(fresh.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth"))


def quota_check(organizations: DataFrame, docs: DataFrame, month_start: Column) -> DataFrame:
    """used and allowed: a quota of 0 or less is unmetered."""
    used = docs.where(F.col("created_at") >= month_start).groupBy("organization_id").agg(F.count("*").alias("used"))
    joined = organizations.join(used, "organization_id", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
    return joined.withColumn("allowed", (F.col("quota") <= 0) | (F.col("used") < F.col("quota")))


def review_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields after edits: new value, was_corrected only where it differs (null and empty are one), and who set it."""
    joined = fields.join(edits.withColumnRenamed("value", "edited").withColumn("__edit", F.lit(True)), ["extraction_id", "field_path"], "full_outer")
    changed = F.col("__edit").isNotNull() & (F.coalesce("value", F.lit("")) != F.coalesce("edited", F.lit("")))
    return joined.select(
        "extraction_id", "field_path", F.when(F.col("__edit").isNotNull(), F.col("edited")).otherwise(F.col("value")).alias("value"), changed.alias("was_corrected"),
        F.when(F.col("__edit").isNotNull(), "human").otherwise("llm").alias("source"), F.when(F.col("__edit").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def approvable(extractions: DataFrame, issues: DataFrame, force: bool = False) -> DataFrame:
    """Extractions without an unresolved error."""
    blocking = issues.where((F.col("severity") == "error") & ~F.col("resolved"))
    return extractions if force else extractions.join(blocking, extractions.id == blocking.extraction_id, "left_anti")


def deliver(attempts: DataFrame) -> DataFrame:
    """Delivery state after its ordered attempts: delivered at a first success, exhausted after MAX_ATTEMPTS failures."""
    row = F.struct("attempt", "ok")
    folded = attempts.groupBy("delivery_id").agg(F.array_sort(F.collect_list(row)).alias("tries"))
    n = F.expr("aggregate(tries, named_struct('n', 0, 'done', false), (a, t) -> IF(a.done, a, named_struct('n', a.n + 1, 'done', t.ok)))")
    state = F.when(n["done"], "delivered").when(n["n"] >= MAX_ATTEMPTS, "exhausted").when(n["n"] > 0, "failed").otherwise("pending")
    return folded.select("delivery_id", n["n"].alias("attempts"), state.alias("status"))


def rate_limited(requests: DataFrame, limit: int, window: str = "60 seconds") -> DataFrame:
    """Requests of each identity in fixed windows, and how many were over the limit."""
    counted = requests.groupBy(F.window("ts", window), "identity").agg(F.count("*").alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "identity", "n", F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("refused"))


def retry_decision(jobs: DataFrame, errors: DataFrame) -> DataFrame:
    """retry, dead_letter or fail: by the error class and the attempts left."""
    joined = jobs.join(F.broadcast(errors), "error_code", "left")  # the error table is fixed, 36 rows
    can = F.coalesce(F.col("retryable"), F.lit(True))
    return joined.withColumn("decision", F.when(~can, "fail").when(F.col("attempt") < F.col("max_attempts"), "retry").otherwise("dead_letter"))


def status_shares(counts: DataFrame) -> DataFrame:
    total = F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy(F.lit(1))))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def stage_latency(steps: DataFrame) -> DataFrame:
    return steps.groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("duration_ms").alias("max_ms"), F.sum("duration_ms").alias("total_ms"))


def timeline(steps: DataFrame) -> DataFrame:
    """Steps in the fixed order of stages; skipped ones are hidden."""
    place = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("stage")).cast("int")
    return steps.where(F.col("status") != "skipped").withColumn("place", place)
