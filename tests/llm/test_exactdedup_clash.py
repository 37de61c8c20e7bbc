from pyspark.sql import functions as F

from synergist.llm import common, exactdedup


def test_texts_of_one_digest_are_told_apart_by_their_bytes(spark, tmp_path, monkeypatch):
    """A digest of one hexadecimal character makes different texts meet."""
    monkeypatch.setattr(exactdedup, "digest_of", lambda body: F.substring(F.sha2(body.cast("binary"), 256), 1, 1))
    monkeypatch.setattr(common, "HOT", 4)  # some digests are hot, others not
    texts = [f"t{i % 37}" for i in range(120)] + ["", None, "t0"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.deduplicate(spark, f"{tmp_path}/docs").collect()}
    for i, t in enumerate(texts):
        same = [k for k, x in enumerate(texts) if (x or "") == (t or "")]
        assert got[i] == (max(same), len(same), i == max(same))


def test_pattern_paths(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    got = exactdedup.deduplicate(spark, f"{tmp_path}/doc*").collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 2, False), (2, 2, True)}
