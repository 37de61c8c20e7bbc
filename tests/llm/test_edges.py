"""Nulls, empty tables, ties, repeated rows, long texts and clashing columns where the
other tests have none."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from synergist.llm import chat, decontaminate, exactdedup, langid, licenses, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"
BENCH = "item_id string, text string"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty, tmp_path):
    bench = spark.createDataFrame([("q", "one two three")], BENCH)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert licenses.scan(empty, ["doc_id"]).count() == 0
    assert langid.identify(empty).count() == 0
    assert toxicity.classify(empty, labels).count() == 0
    assert quality.classify(empty, labels.limit(0)).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.remove(empty, bench.limit(0)).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert exactdedup.deduplicate(spark, f"{tmp_path}/documents.parquet").count() == 0


def test_short_notices_and_identifiers(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0": "apache-short",
        "This file is under the MIT license.": "mit-notice",
        "// SPDX-License-Identifier: Apache-2.0": "spdx-apache-2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later": "spdx-gpl-2.0-or-later",
        "under the terms of the GNU Lesser General Public License as published": "lgpl-notice",
        "an apache met a lesser license identifier in public": "",
        None: "",
    }
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(docs, ["doc_id"]).collect()}
    for i, label in enumerate(texts.values()):
        assert label in got[i] if label else not got[i], (i, got[i])


def test_languages_of_repeated_and_odd_rows(spark):
    rows = [(i % 40, f"wort{i % 9} und so", "de", "s") for i in range(80)] + [(100 + i, f"word{i % 9} and so", "en", "s") for i in range(40)]
    rows += [(None, "and so", None, None), (7, None, "en", "s"), (8, "", None, "s"), (9, "word1 and " * 5000, None, "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"_raw": F.lit(1), "score": F.lit("x")})
    got = langid.identify(docs)
    assert got.count() == len(rows) and got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r.lang_pred for r in got.where("doc_id = 9").collect()} >= {"en"} and got.where("lang_pred = 'und'").count() == 2


def test_chat_with_null_ids_and_equal_turns(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "assistant", None), (1, 5, "user", "x"), (1, 5, "user", "x"), (2, None, None, "")]
    got = chat.format_and_read(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.n_turns for r in got.collect()} == {None: 2, 1: 2, 2: 1}


def test_pipeline_on_odd_rows(spark, tmp_path):
    good = [f"plain words about topic {i} that go on for a while and end here, number {i * i}" for i in range(60)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(good)]
    rows += [(3, good[3], "en", "s0"), (None, "no id but words of its own, quite a few of them", None, None), (200, None, "en", "s1"), (201, "", None, "s1"), (202, " ".join(f"w{k}" for k in range(30_000)), "en", "s2")]
    rows += [(300 + i, good[5], "en", "s2") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"_raw": F.lit(1), "_score": F.lit("x"), "_hit": F.lit(2), "_id": F.lit(3)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", good[7])], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    texts = [r.text for r in now.select("text").distinct().collect()]
    assert good[7] not in texts and set(texts) <= {r[1] for r in rows}
    got = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert got.count() == now.count() and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
