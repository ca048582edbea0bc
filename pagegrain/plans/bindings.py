"""Archive-shaped views over the driver tables, as Spark and as DuckDB SQL.

The driver tables hold no archive data; these deterministic SELECTs derive
page boxes, results, jobs, units, mentions and triples from them.  Both forms
of a view give identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

_BOX_COLUMNS = """
SELECT page_id, box_index, text, CAST(length(text) AS BIGINT) AS n,
  CASE WHEN box_index = 0 AND page_id % 5 = 0 THEN 0 ELSE (page_id * 37 + box_index * 101) % 400 END AS x1,
  CASE WHEN box_index = 0 AND page_id % 5 = 0 THEN 0 ELSE box_index * 22 + page_id % 7 END AS y1,
  CASE WHEN box_index = 0 AND page_id % 5 = 0 THEN 1000 ELSE (page_id * 37 + box_index * 101) % 400 + 40 + least(length(text) * 8, 560) END AS x2,
  CASE WHEN box_index = 0 AND page_id % 5 = 0 THEN 200 ELSE box_index * 22 + page_id % 7 + 12 + length(text) % 9 END AS y2,
  (box_index = 0 AND page_id % 5 = 0) AS persistent,
  CASE (page_id + box_index) % 17 WHEN 3 THEN 'note' WHEN 5 THEN 'ignore_region' ELSE 'ocr' END AS box_type,
  CASE (page_id * 3 + box_index) % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'auto_confirmed' WHEN 3 THEN 'pending' WHEN 4 THEN 'new' ELSE NULL END AS review_status
FROM l
"""

A_BOX_SPARK = r"""
WITH l AS (
  SELECT d.doc_id AS page_id, CAST(t.pos AS BIGINT) AS box_index, t.line AS text
  FROM documents d LATERAL VIEW posexplode(split(d.text, '\n', -1)) t AS pos, line)
""" + _BOX_COLUMNS

A_BOX_DUCKDB = """
WITH l AS (
  SELECT doc_id AS page_id, CAST(i - 1 AS BIGINT) AS box_index, a[i] AS text
  FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))
""" + _BOX_COLUMNS

_RESULT_COLUMNS = """
SELECT doc_id * 3 + s AS id, doc_id AS page_id, doc_id % 20 AS document_id,
  CASE s WHEN 0 THEN 'tesseract' WHEN 1 THEN 'pdf_native' ELSE 'ollama_vision' END AS source,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (doc_id * 7 + s * 5) % 11 END AS BIGINT) AS created_s,
  (doc_id + s) % 5 <> 0 AS has_boxes, (doc_id + s) % 3 <> 0 AS has_metrics
"""

A_RESULT_SPARK = _RESULT_COLUMNS + "FROM documents LATERAL VIEW explode(array(0L, 1L, 2L)) v AS s"
A_RESULT_DUCKDB = _RESULT_COLUMNS + (
    "FROM documents CROSS JOIN (SELECT CAST(0 AS BIGINT) AS s "
    "UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) v"
)

A_PAGE = """
SELECT doc_id AS id, doc_id % 20 AS document_id, CAST(floor(doc_id / 20) AS BIGINT) + 1 AS page_number, n_chars, doc_id % 3 <> 0 AS is_extracted,
  CASE WHEN doc_id % 4 = 1 THEN NULL ELSE CAST(doc_id % 9 - 4 AS DOUBLE) / 2 END AS deskew_angle
FROM documents
"""

A_DARK = """
SELECT DISTINCT l_orderkey % 50 AS page_id, (l_partkey * 7 + l_linenumber * 131) % 1000 AS x, (l_suppkey * 13 + l_orderkey * 29 + l_linenumber) % 600 AS y FROM lineitem
"""

A_SEGMENT = """
SELECT o_custkey % 40 AS page_id, o_orderkey AS id, 0 AS x1, 0 AS y1, 100 + o_orderkey % 300 AS x2, o_orderkey % 61 - 30 AS y2 FROM orders
"""

A_JOB = """
SELECT event_id AS id, user_id AS page_id, user_id % 7 AS document_id, ts AS created_at, event_id % 5 - 2 AS priority,
  CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'quality' WHEN 'purchase' THEN 'bbox_review' WHEN 'signup' THEN 'llm_sight' ELSE 'pdf_export' END AS job_type,
  CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'paused' ELSE 'archived' END AS status,
  value AS wait_s
FROM events
"""

A_UNIT_PAGE = """
SELECT conv_id AS unit_id, turn AS pos, conv_id * 1000 + turn AS page_id, text, role, concat('Person ', CAST((conv_id * 7 + turn) % 31 AS VARCHAR(20))) AS person_name,
  conv_id % 3 <> 0 AS is_public, CASE WHEN conv_id % 9 = 4 THEN NULL ELSE CAST(1920 + (conv_id * 11) % 95 AS BIGINT) END AS year, (conv_id + turn) % 3 <> 0 AS belongs_with_next
FROM conversations
"""

A_MENTION = """
SELECT o_orderkey AS id, o_custkey % 60 AS page_id, o_orderkey % 400 AS source_box,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('Place_', CAST(o_custkey % 25 AS VARCHAR(20))) ELSE concat('Person_', CAST(o_custkey AS VARCHAR(20))) END AS entity_uri,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'president' WHEN '2-HIGH' THEN 'board' WHEN '3-MEDIUM' THEN 'membership' WHEN '5-LOW' THEN 'gast' ELSE NULL END AS event_type,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS start_date, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate END AS end_date
FROM orders
"""

A_TRIPLE = """
SELECT concat('Person_', CAST(c_custkey AS VARCHAR(20))) AS subject, 'name' AS predicate, c_name AS object, 'literal' AS object_type FROM customer
UNION ALL SELECT concat('Place_', CAST(n_nationkey AS VARCHAR(20))), 'name', n_name, 'literal' FROM nation
UNION ALL SELECT concat('Place_', CAST(n_nationkey AS VARCHAR(20))), 'lat', CAST(n_nationkey * 3 - 40 AS VARCHAR(20)), 'literal' FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT concat('Place_', CAST(n_nationkey AS VARCHAR(20))), 'lon', CAST(n_nationkey * 7 - 90 AS VARCHAR(20)), 'literal' FROM nation WHERE n_nationkey % 6 <> 0
UNION ALL SELECT concat('Stmt_', CAST(c_custkey AS VARCHAR(20))), 'statementSubject', concat('Person_', CAST(c_custkey AS VARCHAR(20))), 'uri' FROM customer
UNION ALL SELECT concat('Stmt_', CAST(c_custkey AS VARCHAR(20))), 'statementPredicate', CASE c_custkey % 3 WHEN 0 THEN 'P551' WHEN 1 THEN 'P937' ELSE 'P276' END, 'uri' FROM customer
UNION ALL SELECT concat('Stmt_', CAST(c_custkey AS VARCHAR(20))), 'statementObject', concat('Place_', CAST(c_nationkey AS VARCHAR(20))), 'uri' FROM customer
UNION ALL SELECT concat('Stmt_', CAST(c_custkey AS VARCHAR(20))), 'belegtIn', concat('Box_', CAST(c_custkey % 40 AS VARCHAR(20))), 'uri' FROM customer WHERE c_custkey % 4 <> 0
"""

# name -> (Spark SQL, DuckDB SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "a_box": (A_BOX_SPARK, A_BOX_DUCKDB),
    "a_result": (A_RESULT_SPARK, A_RESULT_DUCKDB),
    "a_page": (A_PAGE, A_PAGE),
    "a_dark": (A_DARK, A_DARK),
    "a_segment": (A_SEGMENT, A_SEGMENT),
    "a_job": (A_JOB, A_JOB),
    "a_unit_page": (A_UNIT_PAGE, A_UNIT_PAGE),
    "a_mention": (A_MENTION, A_MENTION),
    "a_triple": (A_TRIPLE, A_TRIPLE),
}


class Bindings:
    """Lazy access to the driver tables (``b.table``) and the views (``b.a_box``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name][0]
        used = [t for t in TABLES if f" {t}" in sql]
        frames = {t: self.table(t) for t in used}
        for t in used:
            sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
        return self.spark.sql(sql, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """Put the DuckDB form of every view the query mentions in front as CTEs."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v][1].strip()})" for v in used)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
