"""A delivery of a stream is one batch, however many files it has."""

from synergist.streaming import queries as streams

D = "/root/testdata/sf0.001"


def test_a_part_is_one_batch(spark, monkeypatch):
    before = {n: sorted(map(tuple, streams.QUERIES[n](spark, D).collect())) for n in ("stream_dedup", "stream_retention")}
    batches = []
    keep = streams.ingest.run_available

    def run(df, batch, checkpoint, mode="append"):
        def counted(rows, k):
            batches.append(k)
            batch(rows, k)

        return keep(df, counted, checkpoint, mode)

    monkeypatch.setattr(streams.ingest, "run_available", run)
    # many files in each part
    old = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    try:
        # a batch without data ends each run with a watermark
        for name, most in (("stream_dedup", 12), ("stream_retention", 6)):
            batches.clear()
            assert sorted(map(tuple, streams.QUERIES[name](spark, D).collect())) == before[name]
            assert len(batches) <= most, name
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", old)
