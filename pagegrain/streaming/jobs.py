"""Streaming jobs over changed boxes and job requests.

Each function takes a streaming DataFrame; state is bounded by the watermark.
Checkpoint folders are the caller's: on a cluster they belong in shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagegrain.operators import boxes as B
from pagegrain.operators import quality as Q
from pagegrain.operators.jobs import throughput


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Event times without a zone count in the session's zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def dedupe_job_requests(requests: DataFrame, time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """R2: at most one request per page and job type within the watermark; later copies are dropped."""
    return _timed(requests, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(["page_id", "job_type"])


def job_request_bursts(requests: DataFrame, time: str = "created_at", gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """R2 by event time: one row per page, job type and burst of requests that follow each other within ``gap``.

    ``requested_at`` is the burst's first request, ``requests`` their number. A burst appears once the watermark has
    passed its end, so how the requests are dealt into files and micro-batches doesn't matter; requests behind the
    watermark are dropped.
    """
    timed = _timed(requests, time).withWatermark(time, delay)
    bursts = timed.groupBy("page_id", "job_type", F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("requests"))
    return bursts.select("page_id", "job_type", F.col("_w.start").alias("requested_at"), "requests")


def job_throughput(jobs: DataFrame, width: str = "1 hour", delay: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Jobs and queue wait per tumbling window, type and status; rows behind the watermark are dropped."""
    return throughput(_timed(jobs, time).withWatermark(time, delay), width, time)


#: Parts into which the box table is dealt by page, so that a refresh reads those of its pages only.
PAGE_BUCKETS = 64


def page_bucket(page: str = "page_id") -> Column:
    return F.pmod(F.xxhash64(page), F.lit(PAGE_BUCKETS)).cast("int")


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Write the box table as ``metric_refresh`` reads it: one folder per page bucket."""
    boxes.withColumn("page_bucket", page_bucket()).repartition("page_bucket").write.partitionBy("page_bucket").mode("overwrite").parquet(path)


def replace_pages(boxes: DataFrame, pages: DataFrame, path: str, stage: str) -> None:
    """Give ``pages`` the boxes in ``boxes`` and no others; only the folders of their buckets are written anew.

    The new folders are written to ``stage`` first, as a folder can't be overwritten while it is read.
    """
    spark = boxes.sparkSession
    mine = pages.select("page_id").distinct()
    touched = _buckets_of(mine)
    old = spark.read.parquet(path).where(F.col("page_bucket").isin(touched)).join(mine, "page_id", "left_anti")
    fresh = boxes.join(mine, "page_id", "left_semi").withColumn("page_bucket", page_bucket())
    old.unionByName(fresh, allowMissingColumns=True).repartition("page_bucket").write.partitionBy("page_bucket").mode("overwrite").parquet(stage)
    fs = spark._jvm.org.apache.hadoop.fs
    for k in touched:  # PAGE_BUCKETS at most
        was, now = (fs.Path(f"{p}/page_bucket={k}") for p in (path, stage))
        store = was.getFileSystem(spark._jsc.hadoopConfiguration())
        store.delete(was, True)
        if store.exists(now):
            store.rename(now, was)


def _buckets_of(pages: DataFrame) -> list[int]:
    return sorted(r["b"] for r in pages.select(page_bucket().alias("b")).distinct().collect())


def page_metrics(boxes: DataFrame, image_width: int) -> DataFrame:
    """Density and review progress per page of recomputed boxes."""
    fresh = B.with_box_metrics(boxes, image_width)
    totals = fresh.groupBy("page_id").agg(F.sum("char_count").alias("char_count"))
    return Q.density_and_review(fresh).join(totals, "page_id")


def metric_refresh(
    changed: DataFrame, boxes_path: str, metrics_path: str, checkpoint: str, image_width: int
) -> DataStreamWriter:
    """Keep the page metrics of changed boxes fresh.

    ``changed`` is a stream of box keys with ``metrics_stale``.  Each
    micro-batch recomputes the pages it touches from the box table and writes
    them as one partition ``batch=<id>``; a repeated batch overwrites its own
    partition, so a restart after a lost executor leaves no doubles.  Of a
    table that ``write_boxes`` wrote, only the buckets of these pages are read.
    A page that has no boxes left gets a row that says so (``gone``).
    ``current_metrics`` reads the newest row of each page.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pages = batch.where("metrics_stale").select("page_id").distinct()
        table = spark.read.parquet(boxes_path)
        if "page_bucket" in table.columns:
            table = table.where(F.col("page_bucket").isin(_buckets_of(pages))).drop("page_bucket")
        found = page_metrics(table.join(pages, "page_id", "left_semi"), image_width).withColumn("gone", F.lit(False))
        rows = pages.join(found, "page_id", "left").withColumn("gone", F.coalesce("gone", F.lit(True)))
        rows.write.mode("overwrite").parquet(f"{metrics_path}/batch={batch_id}")

    return (
        changed.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
    )


def current_metrics(rows: DataFrame) -> DataFrame:
    """Newest metrics of each page out of the partitions that ``metric_refresh`` writes; pages without boxes have none."""
    from pagegrain.operators.spread import latest

    return latest(rows, ["page_id"], [F.col("batch")]).where(~F.col("gone")).drop("gone")
