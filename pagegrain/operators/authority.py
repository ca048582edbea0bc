"""Matching entities against an authority file (X11).

Scores depend only on the texts, so equal entities are scored once and equal
candidates keep their ten least ids, which is all a top ten can use.  A pair
qualifies when one name occurs in the other, as a substring; it is found over
the rarest three letters of the contained name (all of it, if it is shorter),
so common letters join nothing, and no pair is lost.  Empty names occur in
every name; of those pairs only the ones that can be among the best are made.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.operators.graph import KEYWORDS, match_score

_E = ["name", "context", "kind"]
_C = ["label", "description"]


def grams(text: str, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given sizes."""
    parts = [
        F.expr(f"if(length({text}) >= {n}, transform(sequence(1, length({text}) - {n - 1}), i -> substring({text}, i, {n})), array())")
        for n in sizes
    ]
    return F.array_distinct(F.concat(*parts))


def contained(inner: DataFrame, outer: DataFrame, inner_key: list[str], inner_text: str, outer_text: str) -> DataFrame:
    """Pairs where the text of ``inner`` (not empty) occurs in that of ``outer``, joined over inner's rarest gram."""
    by_gram = outer.withColumn("_g", F.explode_outer(grams(outer_text, (1, 2, 3))))
    frequency = by_gram.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.length(inner_text), F.lit(3))
    own = F.filter(grams(inner_text, (1, 2, 3)), lambda g: F.length(g) == size)
    rarest = (
        inner.withColumn("_g", F.explode(own))
        .join(frequency, "_g")
        .groupBy(*inner_key)
        .agg(F.min(F.struct(F.col("_n").alias("n"), F.col("_g").alias("g"))).alias("_r"))
        .select(*inner_key, F.col("_r.g").alias("_g"))
    )
    pairs = inner.join(rarest, inner_key).join(by_gram, "_g")
    return pairs.where(F.contains(F.col(outer_text), F.col(inner_text))).drop("_g")


def _anyway(e: DataFrame, c: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Pairs of entities and candidates whose names fit anyway, as far as they can be among the ``most`` best.

    Without the context the order of candidates is the same for all entities of a kind; those whose description
    holds the context are added.
    """
    plain = ids.join(c.select(*_C).distinct(), _C)
    blank = F.lit("")
    scored = [
        plain.withColumn("kind", F.lit(k)).withColumn("_s", match_score(blank, blank, F.col("description"), blank, F.lit(k)))
        for k in (*KEYWORDS, "")
    ]
    ranked = reduce(DataFrame.unionByName, scored).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("_s"), "id"))
    )
    best = ranked.where(F.col("_rank") <= most).select("kind", *_C).distinct()
    known = F.when(F.col("kind").isin(list(KEYWORDS)), F.col("kind")).otherwise("")
    by_kind = e.withColumn("_k", known).join(best.withColumnRenamed("kind", "_k"), "_k").select(*_E, *_C)
    with_context = e.where(F.col("context") != "").withColumn("_t", F.lower("context"))
    described = c.withColumn("_d", F.lower("description"))
    by_context = contained(with_context, described, _E, "_t", "_d").select(*_E, *_C)
    return by_kind.unionByName(by_context)


def match_authority(entities: DataFrame, candidates: DataFrame, most: int = 10) -> DataFrame:
    """X11: the best candidates of each entity, by score, then candidate id.

    ``entities(entity_id, name, context, kind)``, ``candidates(id, label, description)``.
    """
    e_all = entities.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in _E})
    c_all = candidates.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in _C})
    ids = c_all.withColumn("_i", F.row_number().over(Window.partitionBy(*_C).orderBy("id"))).where(F.col("_i") <= most)
    e = e_all.select(*_E).distinct().withColumn("_ew", F.lower("name"))
    c = ids.select(*_C).distinct().withColumn("_cw", F.lower("label"))
    pairs = (
        contained(e, c, _E, "_ew", "_cw")
        .select(*_E, *_C)
        .unionByName(contained(c, e, _C, "_cw", "_ew").select(*_E, *_C))
        .unionByName(_anyway(e, c.where("label = ''"), ids, most))
        .unionByName(_anyway(e.where("name = ''"), c.where("label <> ''"), ids, most))
        .distinct()
        .withColumn(
            "score",
            match_score(*[F.col(x) for x in ("name", "label", "description", "context", "kind")]),
        )
    )
    w = Window.partitionBy(*_E).orderBy(F.desc("score"), "id")
    best = (
        pairs.join(ids.select("id", *_C), _C)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= most)
    )
    return e_all.select("entity_id", *_E).join(best, _E).select(
        "entity_id", "name", F.col("id").alias("candidate_id"), "label", "score", "rank"
    )
