import numpy as np

from synergist.llm import common, decontaminate, langid, mixing, neardup


def test_rows_that_share_an_id_take_their_own_copies(spark):
    rows = [(None, "a", f"t{i} x") for i in range(20)] + [("r", "a", f"u{i} x") for i in range(20)] + [("e", "a", "same text")] * 20 + [(f"b{i}", "b", "one two") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(3)
    want = {(r.source, r.doc_id): r.n for r in mixing.sample(docs, total=0.3).groupBy("source", "doc_id").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect() if r.n}
    got = {(r.source, r.doc_id): r["count"] for r in mixing.mix(docs, total=0.3).groupBy("source", "doc_id").count().collect()}
    assert got == want
    assert max(r["count"] for r in mixing.mix(docs, total=0.3).where("doc_id is null or doc_id = 'r'").groupBy("text").count().collect()) == 1
    assert mixing.mix(docs, total=0.3).columns == docs.columns


def test_repeated_rows_do_not_change_the_language_model(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 12)), "xx" if i % 2 else "ζζ") for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    again = docs.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(5000)).drop("id"))
    once, more = (langid.fit(d, max_docs=640) for d in (docs, again))
    assert once["languages"] == more["languages"] == ["xx", "ζζ"]
    for n, table in once["tables"].items():
        for k, v in table.items():
            assert np.array_equal(v, more["tables"][n][k]), (n, k)


def test_grams_are_of_code_points():
    raw = [t.encode() for t in ("привет мир", "日本語", "abc")]
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = common.Words(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))), langid.LETTERS)
    chars = langid.char_starts(w.data)
    words = ["привет", "мир", "日本語", "abc"]
    for n in (1, 2, 3, 5):
        owner, got = langid.grams_of(w, np.arange(len(w.starts)), n, chars)
        want = [(k, x[i : i + n]) for k, x in enumerate(words) for i in range(len(x) - n + 1)]
        assert owner.tolist() == [k for k, _ in want]
        assert len(set(got.tolist())) == len({x for _, x in want})


def test_the_language_model_keeps_its_bound(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} aa bb", f"l{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_entries=700, min_count=1)
    assert 0 < sum(len(t["lang"]) for t in model["tables"].values()) <= 700


def test_repeats_of_a_near_copy_are_compared_once(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " end")] + [(3, base + " other end")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(docs, 3, 85, 100)
    assert {tuple(r) for r in got.select("doc_id", "component_id", "kept").collect()} == {(1, 1, True), (2, 1, False), (3, 1, False)}
    assert got.count() == 3002
    assert [r.doc_id for r in neardup.keep_one(docs, 3, 85, 100).collect()] == [1]


def test_copies_of_a_leak_and_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    long_ = " ".join(f"w{i}" for i in range(1500)) + f" {passage} " + " ".join(f"v{i}" for i in range(700))
    docs = spark.createDataFrame([(i, f"x {passage}") for i in range(500)] + [(900, long_), (901, "none of it")], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {**{i: (15, 14) for i in range(500)}, 900: (2214, 14), 901: (3, 0)}
    assert [r.doc_id for r in decontaminate.remove(docs, bench).collect()] == [901]
