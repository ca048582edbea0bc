"""Queries of this subpackage and their DuckDB forms, where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegrain.llm import (
    decontaminate,
    lexical,
    licenses,
    linedup,
    neardup,
    packing,
    passages,
    planes,
    rules,
    secrets,
    store,
    suffixes,
    urls,
    vectors,
)


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store.ready(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _query(f)
    for f in (
        rules.op1_isolation_rules,
        urls.op2_url_rules,
        planes.op3_bit_planes,
        suffixes.op4_suffix_dedup,
        decontaminate.op5_winnowing_decontamination,
        packing.op6_best_fit_packing,
        neardup.op7_minmax_near_duplicates,
        secrets.op8_markov_secrets,
        passages.op9_attention_quality,
        linedup.op10_fuzzy_line_dedup,
        vectors.op11_vector_codes,
        licenses.op12_license_scan,
        lexical.op13_treap_search,
    )
}
ORACLES: dict[str, str] = {
    "op2_url_rules": urls.OP2_SQL,
    "op11_vector_codes": vectors.OP11_SQL,
    "op12_license_scan": licenses.OP12_SQL,
    "op13_treap_search": lexical.OP13_SQL,
}
