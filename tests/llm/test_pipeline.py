"""Each stage on the odd documents and the whole run on the small tables."""

from collections import Counter

import numpy as np

import corpus_pipeline as p
from sievemill.llm import decontaminate, ngram_join, quality_fm
from sievemill.llm.common import materialise
from test_documents import check_packing


def test_stages_keep_the_columns(spark, sf_dir, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        for name, stage in p.STAGES[:-1]:
            got = stage(spark, df, sf_dir)
            assert got.columns == df.columns and got.dtypes == df.dtypes, name
            assert got.count() <= df.count()


def test_decisions_take_effect(spark, sf_dir, docs):
    machine = quality_fm.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in quality_fm.score_quality(docs, machine).filter("score >= 0.3").collect()}
    kept = materialise(p.filter_quality(spark, docs, sf_dir), "t")
    assert {r["doc_id"] for r in kept.collect()} == good and 0 < len(good) < docs.count()
    lines = materialise(p.dedup_lines(spark, kept, sf_dir), "t")
    seen = Counter(k for r in lines.collect() for k in {x.strip().lower() for x in r["text"].split("\n")} if k)
    assert max(seen.values()) < 10 and lines.count() == kept.count()
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    one = materialise(p.dedup_documents(spark, lines, sf_dir), "t")
    assert one.count() == ngram_join.near_duplicates(lines).select("component_id").distinct().count()
    clean = materialise(p.decontaminate_documents(spark, one, sf_dir), "t")
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(one, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - leaks
    check_packing([(r["doc_id"], r["text"]) for r in clean.collect()], p.pack(spark, clean, sf_dir).collect())


def test_run_is_its_stages(spark, sf_dir):
    got = p.run(spark, sf_dir).collect()
    assert len(got) > 0 and np.sum([r["length"] for r in got]) > 0
    assert [k for k, _ in p.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
