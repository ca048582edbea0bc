"""Operators on the job table ``jobs(id, document_id, page_id, job_type, status, priority, created_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.operators import spread

# Job types that wait for a page's box review, and states per action.
BLOCKABLE = ("quality", "persistent_region_quality", "persistent_region_re_recognize")
TRANSITIONS = {
    "cancel": (("pending", "running", "paused"), "cancelled"),
    "restart": (("failed", "cancelled"), "pending"),
    "pause": (("pending",), "paused"),
    "resume": (("paused",), "pending"),
    "archive": (("completed", "failed", "cancelled"), "archived"),
    "delete": (("pending", "completed", "failed", "cancelled", "paused", "archived"), None),
}
JOB_STATES = ("pending", "running", "completed", "failed", "cancelled", "paused", "archived")
ACTIVE = ("pending", "running")
RESET = ("progress", "error_message", "started_at", "completed_at", "current_step")


def missing_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Page numbers 1..page_count of a document that have no page row."""
    wanted = documents.where(F.col("page_count") > 0).select(
        "document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))).alias("page_number")
    )
    return wanted.join(pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")


def pages_without_job(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages that no job of any type or status refers to."""
    return pages.join(jobs.select("page_id").where(F.col("page_id").isNotNull()), "page_id", "left_anti")


def pages_needing_job(pages: DataFrame, jobs: DataFrame, job_type: str) -> DataFrame:
    """Pages without a pending or running job of a type."""
    busy = jobs.where((F.col("job_type") == job_type) & F.col("status").isin(*ACTIVE))
    return pages.join(busy.select("page_id"), "page_id", "left_anti")


def pages_with_open_boxes(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """J8's condition for review jobs: at least one box whose state is not ``ignored``."""
    open_boxes = boxes.where(F.coalesce(F.col("review_status"), F.lit("")) != "ignored")
    return pages.join(open_boxes.select("page_id"), "page_id", "left_semi")


def pages_with_region(pages: DataFrame, boxes: DataFrame, refs: DataFrame) -> DataFrame:
    """J8's condition for re-recognition: ``refs(page_id, box_index)`` names a persistent region."""
    found = boxes.where(F.coalesce(F.col("persistent"), F.lit(False))).join(
        refs.select("page_id", "box_index").distinct(), ["page_id", "box_index"], "left_semi"
    )
    return pages.join(found.select("page_id"), "page_id", "left_semi")


def new_jobs(pages: DataFrame, job_type: str, priority: int = 0) -> DataFrame:
    """Pending jobs for pages; ids are left to the writer."""
    return pages.select(
        "document_id",
        "page_id",
        F.lit(job_type).alias("job_type"),
        F.lit("pending").alias("status"),
        F.lit(priority).cast("long").alias("priority"),
    )


def blocked_jobs(jobs: DataFrame) -> DataFrame:
    """Pending metric jobs whose page has another pending review job, with its least id."""
    pending = jobs.where(F.col("status") == "pending")
    blockers = (
        pending.where((F.col("job_type") == "bbox_review") & F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.min("id").alias("blocking_id"))
    )
    return pending.where(F.col("job_type").isin(*BLOCKABLE)).join(blockers, "page_id")


def runnable_jobs(jobs: DataFrame) -> DataFrame:
    """Pending jobs that nothing blocks."""
    blocked = blocked_jobs(jobs).select("id")
    return jobs.where(F.col("status") == "pending").join(blocked, "id", "left_anti")


def next_job(jobs: DataFrame) -> DataFrame:
    """The runnable job with the least priority number, the oldest first."""
    return runnable_jobs(jobs).orderBy("priority", "created_at", "id").limit(1)


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job per page and type."""
    return spread.latest(jobs, ["page_id", "job_type"], [F.col("created_at"), F.col("id")])


def min_pending_priority(jobs: DataFrame) -> DataFrame:
    """Least priority of the pending jobs, 0 without any."""
    least = F.min(F.when(F.col("status") == "pending", F.col("priority")))
    return jobs.agg(F.coalesce(least, F.lit(0)).cast("long").alias("min_priority"))


def prioritise(jobs: DataFrame, chosen: DataFrame) -> DataFrame:
    """M9: chosen pending jobs move in front of all pending ones."""
    least = min_pending_priority(jobs).scalar()
    marked = jobs.join(chosen.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    front = F.col("_hit") & (F.col("status") == "pending")
    return marked.withColumn(
        "priority", F.when(front, least - 1).otherwise(F.col("priority")).cast("long")
    ).drop("_hit")


def _may(action: str) -> Column:
    return F.col("status").isin(*TRANSITIONS[action][0])


def apply_job_action(jobs: DataFrame, chosen: DataFrame, action: str, now: Column) -> DataFrame:
    """M8: the job table after an action on the chosen ids; inadmissible jobs stay as they are."""
    if action not in TRANSITIONS:
        raise ValueError(f"unknown action: {action}")
    ids = chosen.select("id").distinct()
    if action == "delete":
        gone = jobs.where(_may(action)).join(ids, "id", "left_semi").select("id")
        return jobs.join(gone, "id", "left_anti")
    marked = jobs.join(ids.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & _may(action)
    out = {"status": F.when(hit, TRANSITIONS[action][1]).otherwise(F.col("status"))}
    if action == "cancel" and "completed_at" in jobs.columns:
        out["completed_at"] = F.when(hit, now).otherwise(F.col("completed_at"))
    if action == "restart":
        for c in RESET:
            if c in jobs.columns:
                empty = F.lit(0.0) if c == "progress" else F.lit(None)
                out[c] = F.when(hit, empty).otherwise(F.col(c))
    return marked.withColumns(out).drop("_hit")


def rejected_actions(jobs: DataFrame, chosen: DataFrame, action: str) -> DataFrame:
    """M8: chosen ids the action does not apply to, with the reason."""
    ids = chosen.select("id").distinct()
    return (
        ids.join(jobs.select("id", "status"), "id", "left")
        .where(F.col("status").isNull() | ~_may(action))
        .select(
            "id",
            F.when(F.col("status").isNull(), "job not found")
            .otherwise(F.concat(F.lit(f"cannot {action} a job in state "), F.col("status")))
            .alias("reason"),
        )
    )


def plan_metric_jobs(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """What to do for the metrics of each page: skip, reset the failed job, or create one."""
    newest = latest_job(jobs.where(F.col("job_type") == "quality")).select(
        "page_id", F.col("id").alias("job_id"), "status"
    )
    action = (
        F.when(F.col("status").isin(*ACTIVE), "skip").when(F.col("status") == "failed", "reset").otherwise("create")
    )
    return pages.select("page_id").join(newest, "page_id", "left").select("page_id", "job_id", action.alias("action"))


def metric_job_counts(plan: DataFrame) -> DataFrame:
    """Of a plan of metric jobs, how many are created, reset and skipped, and the jobs a batch answers with."""
    counts = [F.count_if(F.col("action") == a).alias(n) for a, n in (("create", "created"), ("reset", "reset"), ("skip", "skipped"))]
    return plan.agg(*counts).withColumn("jobs", F.col("created") + F.col("reset"))


def recent_failed_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest failed metric jobs."""
    return (
        jobs.where((F.col("job_type") == "quality") & (F.col("status") == "failed"))
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
    )


def list_jobs(jobs: DataFrame, status: str | None = None, document_id: int | None = None, limit: int = 100) -> DataFrame:
    """Jobs newest first, optionally of one status or document."""
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    if document_id is not None:
        jobs = jobs.where(F.col("document_id") == document_id)
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def pdf_documents(documents: DataFrame) -> DataFrame:
    """Documents on their way through recognition that are PDF files."""
    is_pdf = F.contains(F.lower(F.coalesce("file_type", F.lit(""))), F.lit("pdf")) | F.lower(
        F.coalesce("filename", F.lit(""))
    ).endswith(".pdf")
    return documents.where(F.col("status").isin("uploaded", "ocr_pending", "ocr_done") & is_pdf)


def queue_status(
    documents: DataFrame, jobs: DataFrame, pages: DataFrame, job_type: str | None = None
) -> DataFrame:
    """Unarchived jobs of the PDF documents, newest first within a document, with page numbers.

    One row per job, so a document with very many jobs stays spread out.
    ``review`` stands for box reviews and model reviews together.
    """
    j = jobs.where(F.col("status") != "archived")
    if job_type == "review":
        j = j.where(F.col("job_type").isin("bbox_review", "llm_sight"))
    elif job_type is not None:
        j = j.where(F.col("job_type") == job_type)
    d = pdf_documents(documents).select(F.col("id").alias("document_id"), "filename")
    p = pages.select(F.col("id").alias("page_id"), "page_number")
    return (
        j.join(d, "document_id")
        .join(p, "page_id", "left")
        .orderBy("document_id", F.desc("created_at"), F.desc("id"))
    )


def export_jobs(jobs: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Export jobs newest first with the number of pages each covers; unknown states do not filter."""
    j = jobs.where(F.col("job_type") == "pdf_export")
    if status in JOB_STATES:
        j = j.where(F.col("status") == status)
    j = j.withColumn("page_count", F.when(F.col("page_ids").isNull(), 0).otherwise(F.size("page_ids")).cast("long"))
    j = j.orderBy(F.desc("created_at"), F.desc("id"))
    return j if limit is None else j.limit(limit)


def throughput(jobs: DataFrame, width: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Jobs and queue wait per tumbling window, type and status; batch and stream alike."""
    return jobs.groupBy(F.window(time, width).alias("w"), "job_type", "status").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("wait_s").alias("wait_s"), F.max("wait_s").alias("max_wait_s")
    ).select(F.col("w.start").alias("window_start"), "job_type", "status", "jobs", "wait_s", "max_wait_s")
