"""Triple files, one triple per line (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*\.\s*$'
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_MARK = "\ue000"


def _escape(c: Column) -> Column:
    for plain, coded in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def _unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit(_MARK))
    for plain, coded in _ESCAPES[1:]:
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return F.replace(c, F.lit(_MARK), F.lit("\\"))


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of the lines; comments and malformed lines give none."""
    part = [F.regexp_extract(column, _LINE, i) for i in range(1, 5)]
    literal = F.rlike(column, F.lit(r'^\s*<[^>]*>\s+<[^>]*>\s+"'))
    return lines.where(F.rlike(column, F.lit(_LINE))).select(
        part[0].alias("subject"),
        part[1].alias("predicate"),
        F.when(literal, _unescape(part[3])).otherwise(part[2]).alias("object"),
        F.when(literal, "literal").otherwise("uri").alias("object_type"),
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """S3: the triple set of a file or folder."""
    return parse_ntriples(spark.read.text(path)).dropDuplicates()


def format_ntriples(triples: DataFrame) -> DataFrame:
    """One text line per triple."""
    target = F.when(
        F.col("object_type") == "uri", F.concat(F.lit("<"), F.col("object"), F.lit(">"))
    ).otherwise(F.concat(F.lit('"'), _escape(F.col("object")), F.lit('"')))
    return triples.select(
        F.concat(F.lit("<"), F.col("subject"), F.lit("> <"), F.col("predicate"), F.lit("> "), target, F.lit(" .")).alias("value")
    )


def write_triples(triples: DataFrame, path: str) -> None:
    """S3: store the triple set."""
    format_ntriples(triples).write.mode("overwrite").text(path)
