from datetime import datetime

from synergist.plans import queries


def test_lines_six_and_seven_make_pairs(spark, tmp_path):
    tables = {
        "orders": ([(1, 1, datetime(2000, 1, 1), "F"), (2, 1, datetime(2000, 1, 1), "O")], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string"),
        "lineitem": ([(k, n, n, 1) for k in (1, 2) for n in range(1, 8)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"),
        "part": ([(n, f"b{n}") for n in range(1, 8)], "p_partkey long, p_brand string"),
        "customer": ([(1, 1)], "c_custkey long, c_nationkey long"),
        "nation": ([(1, 1)], "n_nationkey long, n_regionkey long"),
        "region": ([(1, "R")], "r_regionkey long, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.slot_a, r.slot_b, r.games) for r in queries.basket_synergy(spark, str(tmp_path)).collect()}
    assert got == {(a, b, 2) for a in range(1, 8) for b in range(a + 1, 8)}
