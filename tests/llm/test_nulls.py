from synergist.llm import decontaminate


def test_benchmark_without_item_id_is_searched(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing of the kind"), (3, "tiny one here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "tiny one"), ("q", "something else " * 6)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (12, 0, True), 2: (0, 0, False), 3: (2, 0, True)}
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {2}
