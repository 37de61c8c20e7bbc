"""Rows that share ids, colliding hashes, hot classes, long texts."""

import numpy as np
from pyspark.sql import functions as F

from synergist.llm import common, neardup


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_texts_that_collide_modulo_a_power_of_two_stay_apart(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other), (3, one * 4), (4, other * 4)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (i, True) for i in (1, 2, 3, 4)}


def test_span_hashes_differ_wherever_bytes_do():
    rng = np.random.default_rng(0)
    spans = {bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in range(1, 140) for _ in range(30)}
    blob = b" ".join(spans) + b" " + b" ".join(spans)
    data = np.frombuffer(blob, np.uint8)
    w = common.Words(data, np.array([0, len(data)]), common.NONSPACE)
    for seed in (0, 1):
        h = w.hashes(seed).tolist()
        assert h[: len(spans)] == h[len(spans) :] and len(set(h)) == len(spans)
    assert not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())


def test_keep_one_drops_rows_not_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "x")], "doc_id long, text string, _id string")
    got = {(r.doc_id, r.text) for r in neardup.keep_one(docs).collect()}
    assert got == {(1, a), (2, b)} and neardup.keep_one(docs).columns == docs.columns
    rows = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert rows == {(1, 1, True), (2, 1, False), (2, 2, True)}
    # repeated rows leave one, the first by their columns; null ids all stay
    more = docs.unionByName(docs.withColumn("_id", F.lit("w"))).unionByName(spark.createDataFrame([(None, a, "x"), (None, None, "x"), (7, "", None), (8, None, "y")], docs.schema))
    got = sorted(((r.doc_id or 0, r.text or "") for r in neardup.keep_one(more).collect()))
    assert got == sorted([(1, a), (2, b), (0, a), (0, ""), (7, ""), (8, "")])


def test_sketch_filter_keeps_its_promise():
    from math import comb

    for num, den in ((85, 100), (80, 100)):
        t, s = neardup.least_equal(num, den), num / den
        below = lambda t: sum(comb(64, k) * s**k * (1 - s) ** (64 - k) for k in range(t))  # noqa: E731, B023
        assert below(t) <= neardup.MISS < below(t + 1)


def test_hot_class_and_other_order(spark, monkeypatch):
    """Copies above and below the share of a hot class."""
    monkeypatch.setattr(common, "HOT", 3)
    texts = ["same old text again"] * 40 + [f"t{i} u{i} v{i}" for i in range(20)] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: texts.index(t) for i, t in enumerate(texts)}
