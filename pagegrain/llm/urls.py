"""Operator 2: URL filters by rules that are indexed by their rarest literal token, in DataFrame functions only.

Every rule is a regular expression with the literal tokens that any URL it matches must have. A rule is filed under
the one of its tokens that is rarest among the URLs; a URL's tokens fetch the rules filed under them, and only those
run their expressions. Host rules (``org/``, ``example.org/es/``) are turned into such rules as well.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import store

#: Host and path rules with their verdicts: fixed values.
HOST_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: Patterns of pages that carry no text of their own, with the tokens that every match has. Block only.
PATTERNS = [
    ("login", r"/login(?:[/?#.]|$)", ["login"]),
    ("signin", r"/signin(?:[/?#.]|$)", ["signin"]),
    ("cart", r"/cart(?:[/?#.]|$)", ["cart"]),
    ("search", r"/search[/?]", ["search"]),
    ("calendar", r"/calendar/\d{4}/\d{2}", ["calendar"]),
    ("session", r"[?&]sessionid=[0-9a-f]+", ["sessionid"]),
    ("replytocom", r"[?&]replytocom=\d+", ["replytocom"]),
    ("print", r"[?&]print=(?:1|true|yes)", ["print"]),
    ("page_ref", r"[?&]page=\d{2,}&ref=", ["page", "ref"]),
]
#: Rules are a parameter of the call, not data: at most so many are accepted, so their table may be sent everywhere.
MOST_RULES = 100_000
TOKEN = r"[0-9a-z]+"


def host_rule(rule: str) -> tuple[str, list[str]]:
    """The expression of a host and path rule over ``host + path``, and its tokens.

    A path that goes on after its last letter or digit may do so in a longer token, which is no token of the rule.
    """
    host, _, path = rule.partition("/")
    tokens = re.findall(TOKEN, host)
    inner = re.findall(TOKEN, path.lower())
    if inner and re.search(r"[0-9A-Za-z]$", path):
        inner = inner[:-1]
    return rf"^(?:[^/?#]*\.)?{re.escape(host)}/{re.escape(path)}", tokens + inner


def parsed(pages: DataFrame) -> DataFrame:
    """Distinct urls with ``host``, ``path`` and ``tokens``; null urls and urls without ``://`` have empty parts."""
    urls = pages.select(F.col("url").cast("string").alias("url")).groupBy("url").agg(F.count("*").alias("pages"))
    # all that follows the first ://, by position
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    urls = urls.withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    urls = urls.withColumn("host", host).withColumn("path", path)
    return urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all(F.lower("rest"), F.lit(f"({TOKEN})"), 1)))


def rules_table(spark: SparkSession, host_rules, patterns) -> DataFrame:
    rows = [(r, verdict, "host", *host_rule(r)) for r, verdict in host_rules]
    rows += [(name, "block", "pattern", pattern, tokens) for name, pattern, tokens in patterns]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return spark.createDataFrame(rows, "rule string, verdict string, kind string, pattern string, needs array<string>")


def filed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules under the rarest of their tokens (by the number of pages, ties by token), or under '' if they have none."""
    needs = rules.select("rule", "kind", F.explode("needs").alias("token"))
    seen = urls.select("pages", F.explode("tokens").alias("token"))
    seen = seen.join(F.broadcast(needs.select("token").distinct()), "token").groupBy("token").agg(F.sum("pages").alias("n"))
    rarest = needs.join(seen, "token", "left").groupBy("rule", "kind").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t")
    )
    out = rules.join(rarest, ["rule", "kind"], "left")
    return out.select("rule", "verdict", "kind", "pattern", F.coalesce("t.token", F.lit("")).alias("token"))


def judge(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """Per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the ``pattern`` that fitted.

    The longest host and path rule that fits gives rule and verdict. Where none fits, a url that any pattern matches
    is blocked (``pattern``: the first by name), all others are allowed. Null urls and urls without ``://`` have
    empty host and path and are allowed. Equal urls are judged once and joined back, so repeated rows each get one;
    other columns are not read; an empty table gives no rows.
    """
    urls = store.keep(parsed(pages), "urls")
    rules = filed(rules_table(pages.sparkSession, host_rules, patterns), urls)
    tokens = urls.select("url", "rest", "host", "path", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token"))
    found = tokens.join(F.broadcast(rules), "token")
    subject = F.when(F.col("kind") == "host", F.concat("host", "path")).otherwise(F.col("rest"))
    found = found.filter(F.regexp_like(subject, F.col("pattern")))
    by_host = F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    by_pattern = F.when(F.col("kind") == "pattern", F.col("rule"))
    best = found.groupBy("url").agg(F.max(by_host).alias("h"), F.min(by_pattern).alias("pattern"))
    best = urls.select("url", "host", "path").join(best, "url", "left")
    verdict = F.coalesce("h.verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    best = best.select(F.col("url").alias("u"), "host", "path", F.col("h.rule").alias("rule"), verdict.alias("verdict"), "pattern")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    out = rows.join(best, F.col("url") == F.col("u"), "left")
    return out.select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        "pattern",
    )


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the standard rules."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _op2_sql() -> str:
    parts = """WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, url, coalesce(rest, '') AS rest,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u)"""
    fits = []
    for rule, verdict in sorted(HOST_RULES, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        ok = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        fits.append((ok, rule, verdict))
    pattern = " ".join(
        f"WHEN regexp_matches(rest, '{p}') THEN '{name}'" for name, p, _ in sorted(PATTERNS)
    )
    rule = " ".join(f"WHEN {ok} THEN '{r}'" for ok, r, _ in fits)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for _, r, v in fits)
    return f"""{parts}, q AS (SELECT page_id, host, path, CASE {rule} END AS rule,
    CASE {pattern} END AS pattern FROM p)
SELECT page_id, host, path, rule, CASE {verdict} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  pattern FROM q"""


OP2_SQL = _op2_sql()
