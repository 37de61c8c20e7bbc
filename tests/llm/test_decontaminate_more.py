from synergist.llm import common, decontaminate


def test_columns_of_clashing_names_and_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    passage = " ".join(f"w{i}" for i in range(10))
    short = "tiny item"
    docs = spark.createDataFrame(
        [(i, f"a{i} {passage} b", "x", 1, 2, 3) for i in range(30)] + [(50, "nothing of the kind", "x", 1, 2, 3), (51, None, "x", 1, 2, 3), (None, f"z {short}", "x", 1, 2, 3)],
        "doc_id long, text string, _hit string, _word long, _bits long, _key long",
    )
    bench = spark.createDataFrame([(f"q{k}", passage) for k in range(5)] + [("s", short)], "item_id string, text string")
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {50, 51}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect()}
    assert all(got[i] == (12, 10, 5) for i in range(30)) and got[None] == (3, 2, 1) and got[50] == (4, 0, 0) and got[51] == (0, 0, 0)


def test_folding_is_of_ascii_letters_only(spark):
    texts = ["ÉCOLE École", "İstanbul I", "ΑΒΓ ABC", "ẞ S"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(decontaminate.words().alias("w"))
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    assert [r.w for r in df.collect()] == [fold(t).split() for t in texts]
