"""Phrase collocation mining with Rabin-Karp fingerprints.

A text's words are hashed once; prefix polynomials over these hashes then give the
fingerprint of every n-gram as one difference. Shuffles aggregate fingerprints, not
phrases: a first pass counts words, a second the pairs of frequent words, a third
the 2- to 4-grams all of whose pairs are frequent, with a pointer to an occurrence
of each and an independent digest of its bytes, which tells colliding fingerprints
apart. Only phrases that are frequent are read from the text, at their pointers,
where fingerprint and digest are checked again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bitmap_of, chunks, hash_spans, in_bitmap, map_arrow, materialise, maybe_in, mix64, table_of, text_bytes

#: Ends of pieces ``[.,;:!?\x0A-\x0D]``; words are ``[^\x20\x09]+`` within a piece.
BREAK = table_of([*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
WORD = ~(BREAK | table_of([0x20, 0x09]))
LONGEST = 4
#: Bytes of text that a task counts together.
BLOCK = 1 << 22
SCALE = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_KEY_BITS = 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse for k < n, modulo 2**64."""
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Grams:
    """The n-grams of a chunk of texts. ``salt`` is a number for each text's language,
    mixed into its fingerprints; ``bits`` are the fingerprints' bits."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, salt: np.ndarray, bits: int = 64):
        self.w = w = Words(data, bounds, WORD)
        self.bounds, self.mask = bounds, np.uint64((1 << bits) - 1)
        self.salt = salt[w.doc] if len(w.doc) else np.zeros(0, np.uint64)
        h = w.hashes()
        size = 1 << max(10, len(h).bit_length())
        self.up, self.down = _powers(size)
        # prefix polynomials: the sum of h[k] * BASE**k for k < i
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)))
        cuts = np.concatenate(([0], np.cumsum(BREAK[w.data])))
        piece = cuts[w.starts]
        same = np.zeros(len(h), bool)
        same[:-1] = (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1])
        self.same = same

    def places(self, n: int) -> np.ndarray:
        """First words of all n-grams: n words of one piece."""
        ok = np.ones(max(0, len(self.w.starts) - n + 1), bool)
        for j in range(n - 1):
            ok &= self.same[j : j + len(ok)]
        return np.flatnonzero(ok)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        poly = (self.prefix[at + n] - self.prefix[at]) * self.down[at]
        return mix64(poly + mix64(self.salt[at] + np.uint64(n))) & self.mask

    def digests(self, at: np.ndarray, n: int) -> np.ndarray:
        """Independent hashes of the words' bytes, white space between them left out."""
        out = np.full(len(at), n, np.uint64)
        for j in range(n):
            out = mix64(out * np.uint64(0xD1342543DE82EF95) + self.w.span_hash(self.w.starts[at + j], self.w.ends[at + j], 7))
        return out

    def phrase(self, at: int, n: int) -> str:
        w = self.w
        return b" ".join(bytes(w.data[w.starts[k] : w.ends[k]]) for k in range(at, at + n)).decode()


def _salts(lang: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(salt, code) of each row's language and the languages."""
    encoded = lang.dictionary_encode()
    names = encoded.dictionary.to_pylist()
    blob = [x.encode() for x in names]
    off = np.concatenate(([0], np.cumsum([len(x) for x in blob]))).astype(np.int64)
    salt = hash_spans(np.frombuffer(b"".join(blob), np.uint8), off[:-1], off[1:], 3)
    code = encoded.indices.to_numpy()
    return salt[code], code, names


def _docs(docs: DataFrame) -> DataFrame:
    """Language, bytes and key of each text. Equal texts have equal keys."""
    raw = text_bytes()
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), raw.alias("_raw"), F.shiftrightunsigned(F.xxhash64(raw), 64 - _KEY_BITS).alias("_key"))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(_signed(x))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _each(lang: pa.Array, raw: pa.Array, bits: int) -> Iterator[tuple[int, int, Grams, np.ndarray, list[str]]]:
    salt, code, names = _salts(lang)
    for i, j, data, bounds in chunks(raw, BLOCK):
        yield i, j, Grams(data, bounds, salt[i:j], bits), code[i:j], names


def word_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, fp, digest, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, g, code, names in _each(batch.column("lang"), batch.column("_raw"), bits):
                at = g.places(1)
                digest = g.digests(at, 1)
                key = mix64(digest + mix64(g.salt[at]))
                _, first, many = np.unique(key, return_index=True, return_counts=True)
                at = at[first]
                lang = pa.DictionaryArray.from_arrays(pa.array(code[g.w.doc[at]].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, _longs(g.fingerprints(at, 1)), _longs(digest[first]), pa.array(many.astype(np.int64))], names=["lang", "fp", "digest", "f"])

    got = map_arrow(_docs(docs).drop("_key"), run, "lang string, fp long, digest long, f long")
    return got.groupBy("lang", "fp", "digest").agg(F.sum("f").alias("f"))


def pair_counts(docs: DataFrame, words: DataFrame, bits: int = 64) -> DataFrame:
    """(fp, f) of the pairs whose words may be among ``words``. Fingerprints alone: a
    collision only makes f larger."""
    known = bitmap_of(words, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, g, _, _ in _each(batch.column("lang"), batch.column("_raw"), bits):
                often = in_bitmap(known.value, g.fingerprints(g.places(1), 1))
                at = g.places(2)
                at = at[often[at] & often[at + 1]]
                fp, many = np.unique(g.fingerprints(at, 2), return_counts=True)
                yield pa.RecordBatch.from_arrays([_longs(fp), pa.array(many.astype(np.int64))], names=["fp", "f"])

    return map_arrow(_docs(docs).drop("_key"), run, "fp long, f long").groupBy("fp").agg(F.sum("f").alias("f"))


def gram_counts(docs: DataFrame, pairs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, n, fp, digest, f, at) of the 2- to 4-grams all of whose pairs may be among
    ``pairs``. ``at`` points to an occurrence: the key of its text and the place of its
    first word."""
    known = bitmap_of(pairs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            for i, j, g, code, names in _each(batch.column("lang"), batch.column("_raw"), bits):
                two = g.places(2)
                often = np.zeros(len(g.w.starts) + LONGEST, bool)
                often[two[in_bitmap(known.value, g.fingerprints(two, 2))]] = True
                for n in range(2, LONGEST + 1):
                    at = g.places(n)
                    for k in range(n - 1):
                        at = at[often[at + k]]
                    digest = g.digests(at, n)
                    key = mix64(digest + mix64(g.salt[at]))
                    # the occurrence with the smallest pointer stands for the phrase
                    doc = g.w.doc[at]
                    pointer = (keys[i:j][doc] << np.int64(64 - _KEY_BITS)) | (at - g.w.first[doc])
                    order = np.lexsort((pointer, key))
                    key = key[order]
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                    many = np.diff(np.append(first, len(key)))
                    take = order[first]
                    at = at[take]
                    lang = pa.DictionaryArray.from_arrays(pa.array(code[g.w.doc[at]].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                    cols = [lang, pa.array(np.full(len(at), n, np.int32)), _longs(g.fingerprints(at, n)), _longs(digest[take]), pa.array(many.astype(np.int64)), pa.array(pointer[take])]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "n", "fp", "digest", "f", "at"])

    got = map_arrow(_docs(docs), run, "lang string, n int, fp long, digest long, f long, at long")
    return got.groupBy("lang", "n", "fp", "digest").agg(F.sum("f").alias("f"), F.min("at").alias("at"))


def read_phrases(docs: DataFrame, grams: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, fp, digest, f, phrase, parts) of ``grams``, read from the text at their
    pointers and checked there. ``parts`` has (at, n, fp, digest) of every shorter run
    of the phrase's words."""
    shift = 64 - _KEY_BITS
    asked = grams.groupBy("lang", F.shiftrightunsigned("at", shift).alias("_key")).agg(
        F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit((1 << shift) - 1)).alias("word"), "n", "fp", "digest", "f")).alias("asked")  # grams of one text
    )
    asked = materialise(asked, "asked")
    # one row for each text, whatever its copies: they are told by more bits than the key has
    texts = maybe_in(_docs(docs), asked, "_key").withColumn("_text", F.xxhash64("_raw", F.lit(5)))
    texts = texts.groupBy("lang", "_key", "_text").agg(F.first("_raw").alias("_raw"))
    rows = texts.join(asked, ["lang", "_key"]).select("lang", "_raw", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            ends, every = asked.offsets.to_numpy(), asked.values
            word, size, fp, digest, f = (every.field(x).to_numpy() for x in ("word", "n", "fp", "digest", "f"))
            for i, j, g, code, names in _each(batch.column("lang"), batch.column("_raw"), bits):
                mine = slice(ends[i], ends[j])
                doc = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                at = g.w.first[doc] + word[mine]
                for n in range(2, LONGEST + 1):
                    # another text of the same key has other words there, or none
                    ok = np.flatnonzero((size[mine] == n) & (at + n <= g.w.first[doc + 1]))
                    ok = ok[(_signed(g.fingerprints(at[ok], n)) == fp[mine][ok]) & (_signed(g.digests(at[ok], n)) == digest[mine][ok])]
                    where = [(k, m) for m in range(1, n) for k in range(n - m + 1)]
                    each = lambda of: pa.array(np.stack([_signed(of(at[ok] + k, m)) for k, m in where], 1).ravel())  # noqa: B023, E731
                    fixed = lambda x: pa.array(np.tile(np.array([w[x] for w in where], np.int32), len(ok)))  # noqa: B023, E731
                    parts = pa.StructArray.from_arrays([fixed(0), fixed(1), each(g.fingerprints), each(g.digests)], names=["at", "n", "fp", "digest"])
                    parts = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1, dtype=np.int32) * len(where)), parts)
                    lang = pa.array([names[c] for c in code[doc[ok]]], pa.string())
                    phrase = pa.array([g.phrase(k, n) for k in at[ok].tolist()], pa.string())
                    cols = [lang, *(pa.array(x[mine][ok]) for x in (fp, digest, f)), phrase, parts]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "fp", "digest", "f", "phrase", "parts"])

    schema = "lang string, fp long, digest long, f long, phrase string, parts array<struct<at:int,n:int,fp:long,digest:long>>"
    # texts that share a key can only repeat a phrase
    return map_arrow(rows, run, schema).dropDuplicates(["lang", "fp", "digest", "phrase"])


def mine(docs: DataFrame, min_count: int = 30, top: int = 2000, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``top`` phrases of each language by
    their weakest cut.

    Phrases are 2 to 4 words of one piece, found at least ``min_count`` times; one that
    lies inside a longer candidate with four fifths of its occurrences is left out. All
    counts cover all documents, and the arithmetic is exact. Null text is empty, null
    lang is ``und``; repeated rows count each; a text of any length is read whole, an
    empty table gives no rows, and other columns are not read. Ties go by the phrase's
    bytes.
    """
    docs = docs.select("text", "lang")
    words = materialise(word_counts(docs, bits), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialise(words.where(F.col("f") >= min_count), "often")
    pairs = materialise(pair_counts(docs, words, bits).where(F.col("f") >= min_count).select("fp"), "pairs")
    grams = materialise(gram_counts(docs, pairs, bits).where(F.col("f") >= min_count), "grams")
    found = materialise(read_phrases(docs, grams, bits), "phrases")

    counts = words.select("lang", F.lit(1).alias("n"), "fp", "digest", "f").unionByName(grams.drop("at"))
    key = ["lang", "n", "fp", "digest"]
    size = F.lit(1) + F.array_max(F.transform("parts", lambda p: p["n"]))
    found = found.withColumn("size", size)
    each = found.select("lang", "fp", "digest", "f", "size", F.explode("parts").alias("p"))
    # counts of both sides of each cut
    ends = each.where((F.col("p.at") == 0) | (F.col("p.at") + F.col("p.n") == F.col("size")))
    ends = ends.select("lang", F.col("fp").alias("_fp"), F.col("digest").alias("_dg"), "f", "size", F.col("p.at").alias("_at"), F.col("p.n").alias("n"), F.col("p.fp").alias("fp"), F.col("p.digest").alias("digest"))
    sides = ends.join(counts.withColumnRenamed("f", "_c"), key)
    cut = F.when(F.col("_at") == 0, F.col("n")).otherwise(F.col("size") - F.col("n")).alias("k")
    cuts = sides.groupBy("lang", "_fp", "_dg", "f", cut).agg(F.sum(F.when(F.col("_at") == 0, F.col("_c"))).alias("l"), F.sum(F.when(F.col("_at") > 0, F.col("_c"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide("f"), wide("l") + wide("r"))
    weakest = cuts.groupBy("lang", "_fp", "_dg").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    # candidates within longer ones
    inner = each.where("p.n > 1").select("lang", F.col("p.n").alias("n"), F.col("p.fp").alias("fp"), F.col("p.digest").alias("digest"), "f")
    inner = inner.groupBy(*key).agg(F.max("f").alias("_most"))
    rows = found.select("lang", F.col("size").alias("n"), "fp", "digest", F.col("f").alias("a"), "phrase").join(inner, key, "left")
    rows = rows.where(F.col("_most").isNull() | (100 * wide("_most") < 80 * wide("a"))).drop("n", "_most")
    rows = rows.join(weakest.select("lang", F.col("_fp").alias("fp"), F.col("_dg").alias("digest"), "c"), ["lang", "fp", "digest"]).join(totals, "lang")
    rows = rows.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # a group limit: a task sends the first ``top`` of its rows at most
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
