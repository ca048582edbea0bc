"""Streaming jobs over file sources, run until nothing is left."""

from pyspark.sql import functions as F

from pagegrain.streaming import jobs as stream

JOBS = "page_id long, job_type string, status string, created_at timestamp, wait_s double"


def _write(spark, path, rows, n):
    df = spark.createDataFrame(rows, "page_id long, job_type string, status string, t string, wait_s double")
    df.withColumn("created_at", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(f"{path}/{n}")


def _drain(df, out, state):
    q = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).outputMode("append").start()
    )
    q.awaitTermination()


def test_duplicates_within_the_watermark_are_dropped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    read = lambda: spark.readStream.schema(JOBS).parquet(f"{src}/*")
    _write(spark, src, [(1, "ocr", "pending", "2024-01-01 00:00:00", 1.0), (1, "ocr", "pending", "2024-01-01 00:10:00", 1.0)], 0)
    _drain(stream.dedupe_job_requests(read()), out, state)
    _write(spark, src, [(1, "ocr", "pending", "2024-01-01 00:20:00", 1.0), (2, "ocr", "pending", "2024-01-01 05:00:00", 1.0)], 1)
    _drain(stream.dedupe_job_requests(read()), out, state)
    _write(spark, src, [(1, "ocr", "pending", "2024-01-01 05:10:00", 1.0)], 2)
    _drain(stream.dedupe_job_requests(read()), out, state)
    got = sorted(tuple(r) for r in spark.read.parquet(out).groupBy("page_id").count().collect())
    assert got == [(1, 2), (2, 1)]


def test_bursts_are_the_same_for_any_split_into_files(spark, tmp_path):
    times = [(1, "00:00"), (1, "00:40"), (1, "01:30"), (1, "04:00"), (2, "01:45"), (2, "02:30"), (1, "09:00")]
    data = [(p, "ocr", "pending", f"2024-01-01 {t}:00", 1.0) for p, t in times]
    want = [(1, "2024-01-01 00:00:00", 3), (1, "2024-01-01 04:00:00", 1), (2, "2024-01-01 01:45:00", 2)]
    for k, cuts in enumerate([[0, 7], [0, 2, 6, 7]]):
        src, out, state = (str(tmp_path / f"{n}{k}") for n in ("src", "out", "state"))
        for n, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            _write(spark, src, data[a:z], n)
            _drain(stream.job_request_bursts(spark.readStream.schema(JOBS).parquet(f"{src}/*")), out, state)
        got = sorted((r["page_id"], str(r["requested_at"]), r["requests"]) for r in spark.read.parquet(out).collect())
        assert got == want


def test_throughput_closes_windows_and_drops_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    read = lambda: spark.readStream.schema(JOBS).parquet(f"{src}/*")
    _write(spark, src, [(1, "ocr", "failed", "2024-01-01 00:05:00", 2.0), (2, "ocr", "failed", "2024-01-01 00:50:00", 3.0), (3, "ocr", "failed", "2024-01-01 03:00:00", 1.0)], 0)
    _drain(stream.job_throughput(read()), out, state)
    _write(spark, src, [(4, "ocr", "failed", "2024-01-01 00:10:00", 9.0), (5, "ocr", "failed", "2024-01-01 08:00:00", 1.0)], 1)
    _drain(stream.job_throughput(read()), out, state)
    got = sorted((str(r["window_start"]), r["jobs"], r["wait_s"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 00:00:00", 2, 5.0), ("2024-01-01 03:00:00", 1, 1.0)]


def test_metric_refresh_reads_buckets_and_marks_emptied_pages(spark, tmp_path):
    boxes, keys, out, state, stage = (str(tmp_path / n) for n in ("boxes", "keys", "out", "state", "stage"))
    schema = "page_id long, box_index long, x1 long, y1 long, x2 long, y2 long, text string, box_type string, review_status string"
    key = "page_id long, box_index long, metrics_stale boolean"
    data = [(p, k, 0, 0, 10, 10, "abc", "ocr", "new") for p in range(40) for k in range(2)]
    stream.write_boxes(spark.createDataFrame(data, schema), boxes)

    def refresh(stale):
        spark.createDataFrame([(p, 0, True) for p in stale], key).write.mode("append").parquet(keys)
        run = stream.metric_refresh(spark.readStream.schema(key).parquet(keys), boxes, out, state, 100)
        run.trigger(availableNow=True).start().awaitTermination()
        return {r["page_id"]: r["char_count"] for r in stream.current_metrics(spark.read.parquet(out)).collect()}

    assert refresh(range(40)) == {p: 6 for p in range(40)}
    before = {str(p.relative_to(tmp_path)) for p in (tmp_path / "boxes").rglob("*.parquet")}
    edited = spark.createDataFrame([(3, 0, 0, 0, 10, 10, "abcdefgh", "ocr", "new")], schema)
    stream.replace_pages(edited, spark.createDataFrame([(3,), (5,), (99,)], "page_id long"), boxes, stage)
    after = {str(p.relative_to(tmp_path)) for p in (tmp_path / "boxes").rglob("*.parquet")}
    touched = {r["b"] for r in spark.createDataFrame([(3,), (5,), (99,)], "page_id long").select(stream.page_bucket().alias("b")).collect()}
    assert {p.split("page_bucket=")[1].split("/")[0] for p in before ^ after} <= {str(b) for b in touched}
    assert refresh([3, 5]) == {p: 8 if p == 3 else 6 for p in range(40) if p != 5}


def test_metric_refresh_updates_only_touched_pages(spark, tmp_path):
    boxes, keys, out, state = (str(tmp_path / n) for n in ("boxes", "keys", "out", "state"))
    schema = "page_id long, box_index long, x1 long, y1 long, x2 long, y2 long, text string, box_type string, review_status string"
    spark.createDataFrame(
        [(1, 0, 0, 0, 10, 10, "abc", "ocr", "confirmed"), (1, 1, 0, 0, 10, 10, "a", "ocr", "new"), (2, 0, 0, 0, 10, 10, "x", "ocr", "new")], schema
    ).write.parquet(boxes)
    key = "page_id long, box_index long, metrics_stale boolean"
    spark.createDataFrame([(1, 1, True), (2, 0, False)], key).write.parquet(keys)
    run = stream.metric_refresh(spark.readStream.schema(key).parquet(keys), boxes, out, state, 100)
    run.trigger(availableNow=True).start().awaitTermination()
    got = stream.current_metrics(spark.read.parquet(out)).select("page_id", "median_density", "reviewed_pct", "char_count")
    assert [tuple(r) for r in got.collect()] == [(1, 20.0, 50.0, 4)]
