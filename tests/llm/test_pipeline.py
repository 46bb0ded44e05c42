"""The pipeline: stages in turn, each kept decision checked on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from addrspark.llm import decontaminate, quality_rules, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    at = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        at[name] = docs
        if name != names[-1]:
            assert docs.columns == before.columns and docs.exceptAll(before).isEmpty()
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(at["quality_rules"]) == ids(quality_rules.ledger(at["start"]).where("fail_mask % 128 = 0"))
    groups = simhash.simhash_groups(at["toxicity"])
    assert ids(at["simhash_near_dedup"]) == ids(groups.select(F.col("component_id").alias("doc_id")))
    clean = decontaminate.decontaminate(at["simhash_near_dedup"], spark.read.parquet(f"{SMALL}/benchmark.parquet"), ["doc_id"]).where("not contaminated")
    assert ids(at["benchmark_decontamination"]) == ids(clean) == ids(at["byte_bpe"])
    assert at["byte_bpe"].where("size(token_ids) <> n_tokens").isEmpty()


def test_odd_input(spark):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables, in each stage."""
    clean = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 900").limit(5)
    odd = clean.unionByName(clean.selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE repeat(' \n', 300000) END AS text", "lang", "source", "n_chars"))
    odd = odd.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = corpus_pipeline.staged(odd.selectExpr("*", "1 AS `a.b`", "2 AS __id", "3 AS N_TOKENS", "4 AS fp", "5 AS words"), "odd")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
            assert got.columns == docs.columns and got.count() <= n and got.exceptAll(docs).isEmpty(), name
            if name == "simhash_near_dedup" and n:
                assert got.where("doc_id is not null").count() == got.where("doc_id is not null").distinct().count() < got.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == n
