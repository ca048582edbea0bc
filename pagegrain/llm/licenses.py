"""Operator 12: license scans by a positional index of rare license words, in DataFrame functions only.

Templates are short license notices and the phrases that name a license. The words of all templates are weighted by
their inverse document frequency over all documents. The index posts the rarest words of each template with their
positions: a file's words fetch postings, and a posting and the word's place give the place where the template would
begin. Places at which enough of a template's rare weight meets (within a slack, as notices are edited) are candidates;
a candidate counts once all key phrases of its template stand word for word where they belong.
A phrase is a template of its own, posted by its rarest word and verified whole, so no occurrence is missed.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import store
from pagegrain.llm.decontaminate import LOWER, UPPER

#: Phrases that name a license, and their labels: fixed values.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Public license notices by label, and the phrases that a copy must have: fixed values.
NOTICES = [
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "merge publish distribute sublicense"],
    ),
    (
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms", "the following conditions are met"],
    ),
    (
        "apache-notice",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ["required by applicable law or agreed", "warranties or conditions of any kind"],
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version",
        ["redistribute it and or modify it", "as published by the free software foundation"],
    ),
    (
        "mpl-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
        ["source code form is subject to the terms", "mozilla public license"],
    ),
    (
        "isc-notice",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee", "is hereby granted provided that"],
    ),
    (
        "unlicense-notice",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software",
        ["free and unencumbered software", "released into the public domain"],
    ),
    (
        "cc-notice",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ["is licensed under a creative commons", "attribution"],
    ),
]
#: Rare words that are posted per notice, how far a place may be off, and the share of rare weight that must meet, in %.
RARE, SLACK, SHARE = 8, 8, 60
#: Words around a posted word that are looked at for phrases; no phrase is longer.
REACH = 8
#: Postings that may be sent to all executors; templates are a parameter of the call, so this bounds the parameter.
MOST_POSTINGS = 100_000
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _cut(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


def with_words(df: DataFrame) -> DataFrame:
    """Adds ``words``, letters as they are: runs of digits, letters a-z, A-Z and all characters beyond ASCII."""
    cut = df.withColumn("words", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPLIT))
    # an empty part can only be the first or the last
    ends = "int(words[0] = ''), greatest(size(words) - int(words[0] = '') - int(element_at(words, -1) = ''), 0)"
    return cut.withColumn("words", F.expr(f"slice(words, 1 + {ends})"))


def _low(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _among(word: Column, words: list[str]) -> Column:
    """Whether a word is one of some ASCII words, A-Z counting as a-z."""
    # lower() maps a few other letters to ASCII ones; translate() judges those it lets through
    return F.lower(word).isin(words) & _low(word).isin(words)


def frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Documents with words, and how many hold each of the given words: as many rows as words reach the driver."""
    rows = with_words(docs.select("text"))
    found = F.array_distinct(F.transform(F.filter("words", lambda w: _among(w, words)), _low))
    some = F.when(F.size("words") > 0, F.array(F.lit("")))  # words of documents are never empty
    each = rows.select(F.explode_outer(F.concat(F.coalesce(some, F.array().cast("array<string>")), found)).alias("w"))
    each = each.filter("w is not null")
    df = {r["w"]: r["n"] for r in each.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return df.pop("", 0), df


def postings(
    n: int, df: dict[str, int], phrases: list[tuple[str, str]], notices: list[tuple[str, str, list[str]]]
) -> tuple[list[tuple], list[tuple]]:
    """The positional index and what it posts.

    Postings: word, template, position, bit (of a notice's rare words, or of its key phrases from bit RARE on), phrase
    (to be verified around the word) and the word's position in it. Templates: number, label, whether it is a phrase,
    the weights of its rare words, the bits of its key phrases, and its rare weight.
    """
    # whole numbers, so that sums don't depend on their order
    idf = {w: 1 + int(1000 * math.log((2 * n + 2) / (2 * df.get(w, 0) + 1))) for w in _vocabulary(phrases, notices)}

    def rarest(words: list[str]) -> int:
        return min(range(len(words)), key=lambda k: (-idf[words[k]], words[k], k))

    index, templates = [], []
    for number, (phrase, label) in enumerate(phrases):
        words = _cut(phrase)
        k = rarest(words)
        index.append((words[k], number, 0, 0, words, k))
        templates.append((number, label, True, [1], 0, 1))
    for number, (label, text, keys) in enumerate(notices, len(phrases)):
        words = _cut(text)
        once = {w: words.index(w) for w in words}
        rare = sorted(once, key=lambda w: (-idf[w], w))[:RARE]
        for bit, w in enumerate(rare):
            index.append((w, number, once[w], bit, None, 0))
        for bit, key in enumerate(keys, RARE):
            part = _cut(key)
            at = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
            k = rarest(part)
            index.append((part[k], number, at, bit, part, k))
        weights = [idf[w] for w in rare]
        bits = ((1 << len(keys)) - 1) << RARE
        templates.append((number, label, False, weights, bits, sum(weights)))
    return index, templates


def _vocabulary(phrases: list[tuple[str, str]], notices: list[tuple[str, str, list[str]]]) -> list[str]:
    texts = [p for p, _ in phrases] + [t for _, t, _ in notices]
    return sorted({w for t in texts for w in _cut(t)})


def scan(
    docs: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str, list[str]]] = NOTICES,
) -> DataFrame:
    """Per row of documents: ``doc_id``, ``n_words``, ``places`` (``begin`` and ``label`` of all licenses found, words
    from 0), ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` (lists) and ``score``.

    ``score`` is the greatest share of a template's rare weight that meets at one place: 1 for a phrase, else that of
    the notices whose key phrases are verified; 0 where no license is found. Null and empty texts have no words and no
    places. Repeated rows give a row each; a null ``doc_id`` stays null. Columns besides ``doc_id`` and ``text`` are
    not read; an empty table gives no rows. A notice is placed to within ``SLACK`` words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, df = frequencies(docs, _vocabulary(phrases, notices))
    index, templates = postings(n, df, phrases, notices)
    if len(index) > MOST_POSTINGS or max(len(x[4] or ()) for x in index) > REACH:
        raise ValueError("too many templates, or too long a phrase")
    posted = spark.createDataFrame(index, "w string, template int, at int, bit int, phrase array<string>, k int")
    known = spark.createDataFrame(
        templates, "template int, label string, is_phrase boolean, weights array<int>, keys int, total int"
    )
    rows = with_words(docs).withColumn("th", F.xxhash64("text"))
    # a hit: place of a posted word, and the words around it; the first entry stands for the document itself
    words = sorted({x[0] for x in index})
    at = F.filter(F.transform("words", lambda w, i: F.when(_among(w, words), i).otherwise(-1)), lambda i: i >= 0)
    hit = F.transform(
        at,
        lambda i: F.struct(
            i.alias("i"),
            F.least(i, F.lit(REACH)).alias("before"),
            F.transform(F.slice("words", F.greatest(i - REACH, F.lit(0)) + 1, F.lit(2 * REACH + 1)), _low).alias("around"),
        ),
    )
    own = F.expr("array(named_struct('i', -1, 'before', 0, 'around', array('')))")
    rows = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.concat(own, hit)).alias("h"))
    rows = rows.select("doc_id", "th", "n_words", "h", F.expr("element_at(h.around, h.before + 1)").alias("word"))
    met = rows.join(F.broadcast(posted), F.col("word") == F.col("w"), "left").filter("h.i < 0 or template is not null")
    # a phrase stands around the word, from k words before it on
    verified = F.expr("phrase is null or (h.before >= k and slice(h.around, h.before - k + 1, size(phrase)) = phrase)")
    met = met.filter(F.col("template").isNull() | verified)
    begin = F.expr("h.i - k - at")
    whole = F.col("template") < len(phrases)
    # a notice's begin may be off by SLACK: begins meet in overlapping boxes; a phrase has its exact begin
    boxes = F.when(whole, F.array(begin)).otherwise(
        F.array(F.floor(begin / SLACK).cast("int"), F.floor(begin / SLACK).cast("int") + 1)
    )
    met = met.select(
        "doc_id", "th", "n_words", "template", F.explode(F.when(F.col("template").isNull(), F.array(F.lit(0))).otherwise(boxes)).alias("box"),
        begin.alias("begin"), F.expr("shiftleft(1, coalesce(bit, 0))").alias("bit"),
    )
    found = met.groupBy("doc_id", "th", "template", "box").agg(
        F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.min("begin").alias("begin"), F.bit_or("bit").alias("bits")
    )
    found = found.join(F.broadcast(known), "template", "left")
    weight = F.expr("aggregate(transform(weights, (x, i) -> if((bits & shiftleft(1, i)) > 0, x, 0)), 0, (a, x) -> a + x)")
    found = found.withColumn("share", F.when(F.col("is_phrase"), F.lit(1.0)).otherwise(weight / F.col("total")))
    enough = F.col("is_phrase") | ((F.col("bits").bitwiseAND(F.col("keys")) == F.col("keys")) & (100 * F.col("share") >= SHARE))
    found = found.filter(F.col("template").isNull() | enough)
    base = F.col("is_phrase")
    place = F.struct("begin", "label")
    # repeated rows were counted together: each has its share of the places
    out = found.groupBy("doc_id", "th").agg(
        F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("begin"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.array_sort(F.collect_set(F.when(F.col("template").isNotNull(), place))).alias("places"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy", "copies", "th")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    found = scan(store.documents(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *lists, "score")


def _rows(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return f"[{', '.join(map(one, v))}]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


def _sql() -> str:
    """DuckDB form: phrases looked up at every word, notices by all places of their rare words."""
    p = len(PHRASES)
    phrases = [(k, _cut(x), label) for k, (x, label) in enumerate(PHRASES)]
    texts = [(k, label, _cut(x)) for k, (label, x, _) in enumerate(NOTICES, p)]
    keys = []
    for (k, _, words), (_, _, parts) in zip(texts, NOTICES, strict=True):
        for bit, part in enumerate(map(_cut, parts), RARE):
            keys.append((k, bit, next(i for i in range(len(words)) if words[i : i + len(part)] == part), part))
    vocabulary = [(w,) for w in _vocabulary(PHRASES, NOTICES)]
    return rf"""
WITH phrases(t, phrase, label) AS (VALUES {_rows(phrases)}),
notices(t, label, words) AS (VALUES {_rows(texts)}),
keys(t, bit, pos, phrase) AS (VALUES {_rows(keys)}),
vocabulary(w) AS (VALUES {_rows(vocabulary)}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
flat AS MATERIALIZED (SELECT r, unnest(words) AS w, CAST(unnest(range(len(words))) AS INTEGER) AS i FROM docs),
idf AS (SELECT w, 1 + CAST(floor(1000 * ln(CAST(2 * (SELECT count(*) FILTER (len(words) > 0) FROM docs) + 2 AS DOUBLE)
  / (2 * count(DISTINCT r) + 1))) AS BIGINT) AS weight FROM vocabulary LEFT JOIN flat USING (w) GROUP BY w),
distinct_words AS (SELECT t, w, min(i) AS pos FROM (SELECT t, unnest(words) AS w, unnest(range(len(words))) AS i FROM notices) GROUP BY t, w),
ranked AS (SELECT t, w, pos, weight, row_number() OVER (PARTITION BY t ORDER BY weight DESC, w) - 1 AS bit FROM distinct_words JOIN idf USING (w)),
rare AS (SELECT * FROM ranked WHERE bit < {RARE}),
base AS (SELECT r, i, label FROM flat JOIN phrases ON w = phrase[1] JOIN docs USING (r) WHERE words[i + 1 : i + len(phrase)] = phrase),
votes AS (SELECT r, t, i - pos AS b, bit, weight FROM flat JOIN rare USING (w)
  UNION ALL SELECT r, t, i - pos, bit, 0 FROM flat JOIN keys ON w = phrase[1] JOIN docs USING (r) WHERE words[i + 1 : i + len(phrase)] = phrase),
boxed AS (SELECT DISTINCT r, t, CAST(floor(b / {SLACK}.0) AS INTEGER) + unnest([0, 1]) AS box, bit, weight FROM votes),
places AS (SELECT r, t, count(*) FILTER (bit >= {RARE}) AS keys_found, CAST(sum(weight) AS DOUBLE) / any_value(total) AS share FROM boxed
  JOIN (SELECT t, sum(weight) AS total FROM rare GROUP BY t) USING (t) GROUP BY r, t, box),
found AS (SELECT r, label, share FROM places JOIN notices USING (t) WHERE 100 * share >= {SHARE}
  AND keys_found = (SELECT count(*) FROM keys WHERE keys.t = places.t)
  UNION ALL SELECT r, label, 1.0 FROM base)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN (SELECT r, count(*) AS n_base, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM base GROUP BY r) USING (r)
LEFT JOIN (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM found GROUP BY r) USING (r)"""


OP12_SQL = _sql()
