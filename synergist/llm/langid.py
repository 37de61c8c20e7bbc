"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word
backs off to its character n-grams, the longest known length first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, map_arrow, map_text, mix64, stable_split, table_of, text_bytes

#: Letters as bytes: a-z after folding, and all of UTF-8's non-ASCII bytes.
LETTERS = table_of([*range(0x61, 0x7B), *range(0x80, 0x100)])
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def char_starts(data: np.ndarray) -> np.ndarray:
    """Where each code point of UTF-8 text begins, and its end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def grams_of(w: Words, words: np.ndarray, n: int, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``words``, hash) of every gram of n code points of the chosen words.
    ``chars`` comes from ``char_starts``."""
    first, last = np.searchsorted(chars, w.starts[words]), np.searchsorted(chars, w.ends[words])
    many = np.maximum(0, last - first - n + 1)
    owner = np.repeat(np.arange(len(words)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return owner, mix64(w.span_hash(chars[at], chars[at + n]) + np.uint64(n))


def _counts(data: np.ndarray, bounds: np.ndarray, lang: list[str]) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    w = Words(data, bounds, LETTERS)
    names = sorted(set(lang))
    code = np.array([names.index(x) for x in lang])
    h, chars, out = w.hashes(), char_starts(w.data), []
    for c, name in enumerate(names):
        mine = np.flatnonzero(code[w.doc] == c) if len(w.doc) else np.zeros(0, np.int64)
        out.append((name, 0, *np.unique(h[mine], return_counts=True)))
        for n in ORDERS:
            out.append((name, n, *np.unique(grams_of(w, mine, n, chars)[1], return_counts=True)))
    return out


#: Parts of a language that are drawn from one by one, and parts of a table that keep
#: their most frequent entries.
PARTS, TABLE_PARTS = 64, 16
#: Count that a language without an entry's gram is given.
ABSENT = 0.1


def fit(docs: DataFrame, max_docs: int = 2000, max_entries: int = 3_000_000, min_count: int = 2, max_languages: int = 100) -> dict:
    """Learn from labelled ``docs`` (doc_id, text, lang; null lang is left out).

    The sample is bounded: the ``max_languages`` most frequent languages, and of each
    about ``max_docs`` different whole documents, as many from each of PARTS parts, the
    first by a hash of doc_id and text; rows that repeat both count once. The model
    holds at most ``max_entries`` counts in all, shared alike by the languages, words
    and n-gram lengths, the most frequent ones of each of TABLE_PARTS parts of the
    hashes.
    """
    known = docs.where(F.col("lang").isNotNull())
    top = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id")).alias("_c")).orderBy(F.col("_c").desc(), "lang").limit(max_languages)
    seen = {r[0]: r[1] for r in top.collect()}  # at most max_languages rows
    languages = sorted(seen)
    keyed = known.where(F.col("lang").isin(languages) if languages else F.lit(False)).select("lang", F.xxhash64("doc_id", "text").alias("_r"), F.xxhash64("doc_id", F.lit(3)).alias("_i"), text_bytes().alias("_raw"))
    # of each language the ids with small hashes: about 3 * max_docs, repeats or not
    limits = [F.when(F.col("lang") == g, F.lit(min(1.0, 3 * max_docs / max(1, seen[g])))) for g in languages]
    share = F.coalesce(*limits) if limits else F.lit(1.0)
    near = keyed.where((F.col("_i").cast("double") + 2.0**63) / 2.0**64 <= share)
    ids = near.select("lang", "_r", F.pmod("_r", F.lit(PARTS)).alias("_b")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang", "_b").orderBy("_r"))
    ids = ids.withColumn("_n", nth).where(F.col("_n") <= -(-max_docs // PARTS)).select("lang", "_r")
    # at most max_languages * (max_docs + PARTS) rows; repeats fold within their task
    texts = near.join(F.broadcast(ids), ["lang", "_r"]).groupBy("lang", "_r").agg(F.first("_raw").alias("_raw")).select("_raw", "lang")

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, data, bounds in chunks(batch.column("_raw")):
                for name, n, keys, many in _counts(data, bounds, langs[i:j]):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array([n] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(many.astype(np.int64))], names=["lang", "n", "key", "c"])

    totals = map_arrow(texts, count, "lang string, n int, key long, c long").groupBy("lang", "n", "key").agg(F.sum("c").alias("c"))
    best = totals.where(F.col("c") >= min_count).withColumn("_b", F.pmod("key", F.lit(TABLE_PARTS)))
    order = [F.col("c").desc(), "key"]
    most = max(1, max_entries // (max(1, len(languages)) * (1 + len(ORDERS)) * TABLE_PARTS))
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "n", "_b").orderBy(*order))).where(F.col("_n") <= most)
    got = best.select("lang", "n", "key", "c").toArrow()  # at most max_entries rows
    place = {g: k for k, g in enumerate(languages)}
    lang = np.array([place[x] for x in got["lang"].to_pylist()], np.int32) if len(got) else np.zeros(0, np.int32)
    n_all, keys, c = (got[x].to_numpy() for x in ("n", "key", "c"))
    return {"languages": languages, "tables": {n: _table(keys[n_all == n], lang[n_all == n], c[n_all == n], len(languages)) for n in (0, *ORDERS)}}


def _table(keys: np.ndarray, lang: np.ndarray, c: np.ndarray, size: int) -> dict:
    """Counts of one kind as sorted keys, the range of entries of each, and by entry its
    language and how much its log frequency exceeds the one of an absent gram. Memory
    goes with the entries, not with their number times that of the languages."""
    order = np.lexsort((lang, keys.view(np.uint64)))
    uniq, first = np.unique(keys.view(np.uint64)[order], return_index=True)
    total = np.maximum(1, np.bincount(lang, weights=c, minlength=size))
    gain = np.log((c[order] + ABSENT) / ABSENT)
    return {"keys": uniq, "first": np.append(first, len(order)), "lang": lang[order], "gain": gain.astype(np.float32), "absent": np.log(ABSENT / total)}


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _sums(table: dict, owner: np.ndarray, row: np.ndarray, n: int, size: int) -> np.ndarray:
    """Log frequencies of the table's rows, summed up by owner: [n, languages]."""
    hits = np.bincount(owner, minlength=n)
    many = table["first"][row + 1] - table["first"][row]
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(table["first"][row], many)
    spot = np.repeat(owner, many) * size + table["lang"][entry]
    out = np.bincount(spot, weights=table["gain"][entry], minlength=n * size).reshape(n, size)
    return out + hits[:, None] * table["absent"][None, :]


def scores(data: np.ndarray, bounds: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(summed log frequencies [texts, languages], number of words scored)."""
    n, size = len(bounds) - 1, len(model["languages"])
    w = Words(data, bounds, LETTERS)
    if not size:
        return np.zeros((n, 0)), np.zeros(n)
    chars = char_starts(w.data)
    uniq, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    value = np.zeros((len(uniq), size), np.float32)
    row = _lookup(model["tables"][0]["keys"], uniq)
    found = np.flatnonzero(row >= 0)
    value[found] = _sums(model["tables"][0], np.arange(len(found)), row[found], len(found), size)
    open_ = np.flatnonzero(row < 0)
    scored = row >= 0
    for order in ORDERS:
        if not len(open_):
            break
        table = model["tables"][order]
        owner, grams = grams_of(w, first[open_], order, chars)
        row = _lookup(table["keys"], grams)
        owner, row = owner[row >= 0], row[row >= 0]
        hits = np.bincount(owner, minlength=len(open_))
        value[open_] = _sums(table, owner, row, len(open_), size) / np.maximum(1, hits)[:, None]
        scored[open_] = hits > 0
        open_ = open_[hits == 0]
    out = np.stack([np.bincount(w.doc, weights=value[inverse, k], minlength=n) for k in range(size)], 1)
    return out, np.bincount(w.doc, weights=scored[inverse], minlength=n)


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score. Text that is null, empty or without
    a letter gives ``und`` and 0; ties go to the first language by name."""
    languages = model["languages"]

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        total, words = scores(data, bounds, model)
        ascii_ = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))))
        letter = ascii_[bounds[1:]] > ascii_[bounds[:-1]]
        high = np.concatenate(([0], np.cumsum(data >= 128)))
        for d in np.flatnonzero(~letter & (high[bounds[1:]] > high[bounds[:-1]])):
            letter[d] = bool(_LETTER.search(bytes(data[bounds[d] : bounds[d + 1]]).decode("utf-8", "replace")))
        if not languages:
            return {"lang_pred": [UNKNOWN] * len(letter), "score": np.zeros(len(letter))}
        best = total.argmax(1)
        z = (total - total.max(1, keepdims=True)) / np.maximum(1, np.sqrt(words))[:, None]
        p = 1 / np.exp(z).sum(1)
        return {"lang_pred": [languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], "score": np.where(letter, p, 0.0)}

    return map_text(docs.select(*keep, text_bytes().alias("_raw")), keep, "lang_pred string, score double", work)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns only from
    rows that are not held out. Repeated rows each get a row; texts of any length are read
    whole, an empty table gives no rows, and other columns are not read."""
    held = stable_split("doc_id", 5) == 0
    got = predict(docs, fit(docs.where(~held).select("doc_id", "text", "lang")), ["doc_id"])
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")
