"""Queries on the job table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.operators import jobs as J
from pagegrain.plans.registry import query



def _now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")



def page_ids(b):
    return b.a_page.select(F.col("id").alias("page_id"), "document_id", "page_number")


@query(
    "j5_missing_pages",
    """WITH d AS (SELECT document_id, max(page_number) + 5 AS n FROM a_page GROUP BY document_id),
    w AS (SELECT document_id, unnest(range(1, n + 1)) AS page_number FROM d)
    SELECT w.document_id, w.page_number FROM w LEFT JOIN (SELECT * FROM a_page WHERE is_extracted) p USING (document_id, page_number) WHERE p.id IS NULL""",
)
def _(b):
    pages = b.a_page
    docs = pages.groupBy("document_id").agg((F.max("page_number") + 5).alias("page_count"))
    return J.missing_pages(docs, pages.where("is_extracted"))


@query("j6_pages_without_job", "SELECT id AS page_id, document_id, page_number FROM a_page WHERE id NOT IN (SELECT page_id FROM a_job)")
def _(b):
    return J.pages_without_job(page_ids(b), b.a_job)


@query(
    "j8_pages_needing_job",
    """SELECT id AS page_id, document_id, page_number FROM a_page WHERE id NOT IN (SELECT page_id FROM a_job WHERE job_type = 'bbox_review' AND status IN ('pending', 'running'))
    AND id IN (SELECT page_id FROM a_box WHERE coalesce(review_status, '') <> 'ignored')""",
)
def _(b):
    return J.pages_with_open_boxes(J.pages_needing_job(page_ids(b), b.a_job, "bbox_review"), b.a_box)


@query(
    "j8_region_jobs",
    """SELECT DISTINCT p.id AS page_id, p.document_id, p.page_number FROM a_page p JOIN a_box x ON x.page_id = p.id AND x.persistent
    WHERE p.id NOT IN (SELECT page_id FROM a_job WHERE job_type = 'quality' AND status IN ('pending', 'running'))""",
)
def _(b):
    with_region = J.pages_with_region(page_ids(b), b.a_box, b.a_box.where("persistent"))
    return J.pages_needing_job(with_region, b.a_job, "quality")


BLOCKED = """
SELECT j.id, j.page_id, j.job_type, k.blocking_id FROM a_job j JOIN (SELECT page_id, min(id) AS blocking_id FROM a_job WHERE status = 'pending' AND job_type = 'bbox_review' GROUP BY page_id) k
  ON k.page_id = j.page_id WHERE j.status = 'pending' AND j.job_type = 'quality'
"""


@query("j9_blocked_jobs", BLOCKED)
def _(b):
    return J.blocked_jobs(b.a_job).select("id", "page_id", "job_type", "blocking_id")


@query(
    "t8_next_job",
    f"SELECT id, priority FROM a_job WHERE status = 'pending' AND id NOT IN (SELECT id FROM ({BLOCKED})) ORDER BY priority, created_at, id LIMIT 1",
)
def _(b):
    return J.next_job(b.a_job).select("id", "priority")


LATEST_JOB = """
SELECT page_id, job_type, id, status FROM (SELECT *, row_number() OVER (PARTITION BY page_id, job_type ORDER BY created_at DESC, id DESC) AS rn FROM a_job) WHERE rn = 1
"""


@query("w6_latest_job", LATEST_JOB)
def _(b):
    return J.latest_job(b.a_job).select("page_id", "job_type", "id", "status")


@query("a13_min_pending_priority", "SELECT coalesce(min(priority) FILTER (status = 'pending'), 0) AS min_priority FROM a_job")
def _(b):
    return J.min_pending_priority(b.a_job)


@query(
    "m9_prioritise",
    """SELECT id, CASE WHEN status = 'pending' AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN (SELECT min(priority) FROM a_job WHERE status = 'pending') - 1 ELSE priority END AS priority FROM a_job""",
)
def _(b):
    jobs = b.a_job
    bad = b.table("labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return J.prioritise(jobs, jobs.join(bad, "page_id", "left_semi")).select("id", "priority")


def _chosen(b):
    """Jobs whose wait was long."""
    return b.a_job.where(F.col("wait_s") > 20).select("id")


for _action, (_from, _to) in J.TRANSITIONS.items():
    _states = ", ".join(f"'{s}'" for s in _from)
    _hit = f"(coalesce(wait_s, 0) > 20 AND status IN ({_states}))"
    _sql = (
        f"SELECT id, status FROM a_job WHERE NOT {_hit}"
        if _to is None
        else f"SELECT id, CASE WHEN {_hit} THEN '{_to}' ELSE status END AS status FROM a_job"
    )

    @query(f"m8_apply_job_action_{_action}", _sql)
    def _(b, action=_action):
        return J.apply_job_action(b.a_job, _chosen(b), action, _now()).select("id", "status")


@query(
    "m8_rejected_actions",
    """SELECT id, concat('cannot cancel a job in state ', status) AS reason FROM a_job WHERE wait_s > 20 AND status NOT IN ('pending', 'running', 'paused')
    UNION ALL SELECT -1 - doc_id, 'job not found' FROM labels""",
)
def _(b):
    unknown = b.table("labels").select((-1 - F.col("doc_id")).alias("id"))
    return J.rejected_actions(b.a_job, _chosen(b).unionByName(unknown), "cancel")


@query(
    "m10_plan_metric_jobs",
    f"""SELECT u.page_id, j.id AS job_id, CASE WHEN j.status IN ('pending', 'running') THEN 'skip' WHEN j.status = 'failed' THEN 'reset' ELSE 'create' END AS action
    FROM (SELECT DISTINCT page_id FROM a_result WHERE has_boxes) u LEFT JOIN (SELECT * FROM ({LATEST_JOB}) WHERE job_type = 'quality') j ON j.page_id = u.page_id""",
)
def _(b):
    from pagegrain.operators.boxes import pages_with_boxes

    return J.plan_metric_jobs(pages_with_boxes(b.a_result), b.a_job)


@query(
    "m10_metric_job_counts",
    f"""SELECT count(*) FILTER (action = 'create') AS created, count(*) FILTER (action = 'reset') AS reset, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action <> 'skip') AS jobs
    FROM (SELECT CASE WHEN j.status IN ('pending', 'running') THEN 'skip' WHEN j.status = 'failed' THEN 'reset' ELSE 'create' END AS action
    FROM (SELECT DISTINCT page_id FROM a_result WHERE has_boxes) u LEFT JOIN (SELECT * FROM ({LATEST_JOB}) WHERE job_type = 'quality') j ON j.page_id = u.page_id)""",
)
def _(b):
    from pagegrain.operators.boxes import pages_with_boxes

    return J.metric_job_counts(J.plan_metric_jobs(pages_with_boxes(b.a_result), b.a_job))


@query(
    "t2_recent_failed_jobs",
    "SELECT id, page_id FROM a_job WHERE job_type = 'quality' AND status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 10",
)
def _(b):
    return J.recent_failed_jobs(b.a_job).select("id", "page_id")


@query("t9_list_jobs", "SELECT id, job_type FROM a_job WHERE status = 'completed' AND document_id = 3 ORDER BY created_at DESC, id DESC LIMIT 50")
def _(b):
    return J.list_jobs(b.a_job, "completed", 3, 50).select("id", "job_type")


# Documents of the job table, with names and states as an upload would give them.
JOB_DOCUMENTS = """
SELECT document_id AS id, concat('akte', document_id, CASE WHEN document_id % 3 = 0 THEN '.png' WHEN document_id % 3 = 1 THEN '.PDF' ELSE '' END) AS filename,
  CASE WHEN document_id % 3 = 2 THEN 'application/pdf' ELSE 'image' END AS file_type, CASE document_id % 4 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'ocr_pending' WHEN 2 THEN 'ocr_done' ELSE 'classified' END AS status
FROM (SELECT DISTINCT document_id FROM a_job)
"""


def job_documents(b):
    d = F.col("document_id")
    return b.a_job.select("document_id").distinct().select(
        d.alias("id"),
        F.concat(
            F.lit("akte"), d.cast("string"), F.when(d % 3 == 0, ".png").when(d % 3 == 1, ".PDF").otherwise("")
        ).alias("filename"),
        F.when(d % 3 == 2, "application/pdf").otherwise("image").alias("file_type"),
        F.when(d % 4 == 0, "uploaded").when(d % 4 == 1, "ocr_pending").when(d % 4 == 2, "ocr_done").otherwise("classified").alias("status"),
    )


PDF = f"""SELECT id, filename FROM ({JOB_DOCUMENTS}) WHERE status IN ('uploaded', 'ocr_pending', 'ocr_done') AND (lower(file_type) LIKE '%pdf%' OR lower(filename) LIKE '%.pdf')"""


@query("p13_pdf_documents", PDF)
def _(b):
    return J.pdf_documents(job_documents(b)).select("id", "filename")


@query(
    "a18_queue_status",
    f"""SELECT j.document_id, d.filename, j.id, j.job_type, j.status, p.page_number FROM a_job j JOIN ({PDF}) d ON d.id = j.document_id LEFT JOIN a_page p ON p.id = j.page_id
    WHERE j.status <> 'archived' AND j.job_type IN ('bbox_review', 'llm_sight')""",
)
def _(b):
    rows = J.queue_status(job_documents(b), b.a_job, b.a_page, "review")
    return rows.select("document_id", "filename", "id", "job_type", "status", "page_number")


@query(
    "a21_export_jobs",
    "SELECT id, status, 1 + id % 4 AS page_count FROM a_job WHERE job_type = 'pdf_export' AND status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 100",
)
def _(b):
    jobs = b.a_job.withColumn(
        "page_ids", F.sequence(F.col("page_id"), F.col("page_id") + F.col("id") % 4)
    )
    return J.export_jobs(jobs, "completed", 100).select("id", "status", "page_count")


@query(
    "r3_job_throughput_batch",
    """SELECT epoch(date_trunc('hour', created_at))::BIGINT AS window_start, job_type, status, count(*) AS jobs, round(sum(wait_s), 4) AS wait_s, max(wait_s) AS max_wait_s
    FROM a_job GROUP BY ALL""",
)
def _(b):
    return J.throughput(b.a_job).withColumns(
        {"window_start": F.unix_timestamp("window_start"), "wait_s": F.round("wait_s", 4)}
    )
