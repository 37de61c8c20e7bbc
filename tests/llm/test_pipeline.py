"""The pipeline's stages one after the other on a small corpus."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from synergist.llm import decontaminate, neardup, quality


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 500, n))
    item = word(20)
    texts = [word(40) for _ in range(120)]
    texts += [t + " tail" for t in texts[:10]] + [f"{word(10)} {item} {word(10)}" for _ in range(5)]
    texts += [" ".join(f"{w.upper()}$$$!!" for w in word(40).split()) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("$$$" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs
        assert name == "tokens" or docs.columns == columns
    ids = {k: {r[0] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert len(ids["quality"] & set(range(135, 165))) <= 1 and len(ids["quality"] & set(range(135))) >= 130
    again = neardup.near_duplicates(seen["quality"]).where("kept").select("doc_id")
    assert ids["near_dedup"] == {r[0] for r in again.collect()}
    assert not ids["decontaminate"] & set(range(130, 135)) and len(ids["decontaminate"]) >= 110
    assert decontaminate.contamination(seen["decontaminate"], spark.read.parquet(f"{d}/benchmark.parquet")).where("contaminated").count() == 0
    assert seen["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert seen["tokens"].count() == seen["mixing"].count()
    assert quality.N_FEATURES and corpus_pipeline.run(spark, d).count() == seen["tokens"].count()
