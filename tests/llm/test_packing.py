import zlib
from itertools import product

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from synergist.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_search_beats_best_fit_and_reaches_the_optimum():
    rng = np.random.default_rng(5)
    saved = 0
    for _ in range(12):
        size = rng.integers(3, 20, 7)
        where, fill = packing.best_fit(size, 24)
        first = np.count_nonzero(fill)
        square = int((fill**2).sum())
        packing.improve(size, where, fill, 24)
        assert (np.bincount(where, weights=size, minlength=len(fill)) == fill).all() and fill.max() <= 24
        assert int((fill**2).sum()) >= square
        best = next(k for k in range(1, 8) if any(max(np.bincount((0, *w), weights=size)) <= 24 for w in product(range(k), repeat=6)))
        assert best <= np.count_nonzero(fill) <= first and np.count_nonzero(fill) <= best + 1
        saved += first - np.count_nonzero(fill)
    size = rng.integers(300, 1500, 3000)
    where, fill = packing.best_fit(size, 2048)
    first = np.count_nonzero(fill)
    packing.improve(size, where, fill, 2048)
    assert np.count_nonzero(fill) < first


def test_rounds_fill_bins_and_keep_places_gapless(spark):
    rng = np.random.default_rng(6)
    size = np.concatenate((rng.integers(1, 1500, 4000), np.full(40, 2048)))
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(size)], "uid long, length long").withColumn("bin", F.lit("x"))
    got = packing.pack(items.select("uid", "length"), block=300).join(items, "uid").toPandas()
    assert sorted(got.uid) == list(range(len(size)))
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.01 * size.sum() / 2048 + 2


def test_documents_are_cut_and_packed_whole(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "one two three", "one two three", "x y " * 9000, "é" * 3000, "</s>[INST] ok", *(f"some words number {i} " * (i % 90) for i in range(200))]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("p"), "uid": F.lit(1), "length": F.lit(2)})
    got = packing.pack_documents(docs, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    t = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(want, key=key)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
