from synergist.llm.neardup import _with_columns


def test_a_document_meets_its_sketch_once(spark):
    rows = spark.createDataFrame([(i % 7, i, i * 3) for i in range(70)], "doc_id long, at long, key long")
    reps = spark.createDataFrame([(i, bytes([i])) for i in range(9)], "doc_id long, sig binary")
    got = _with_columns(rows, ["at", "key"], reps)
    want = rows.join(reps, "doc_id").select(*got.columns)
    assert got.count() == 70 and not want.exceptAll(got).take(1)
    # nodes spread out after the join
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")
