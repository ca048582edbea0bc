"""Stages of the pipeline, each held against what its operator decides."""

import corpus_pipeline
from pagegrain.llm import decontaminate, neardup, rules, store


def test_stages(spark, sf_dir, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, store.keep(stage(spark, now, sf_dir), name)
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert now.columns == docs.columns
        if name == "quality_rules":
            want = {r["doc_id"] for r in rules.judge(before, labels).filter("kept").collect()}
        elif name == "line_dedup":
            want = kept[name]
            assert want <= kept["quality_rules"]
            assert now.filter("n_chars <> length(text)").count() == 0
        elif name == "near_dedup":
            want = {r["doc_id"] for r in neardup.near_duplicates(before, num=80).filter("kept").collect()}
        elif name == "decontamination":
            want = {r["doc_id"] for r in decontaminate.contamination(before, bench).filter("not contaminated").collect()}
        else:
            want = kept["decontamination"]
        assert kept[name] == want
