"""Benchmark decontamination by winnowing, in DataFrame operations only.

Hashes of k consecutive words are thinned to the minimum of each window of w
hashes; with k + w - 1 = 10 every shared run of 10 words shares a fingerprint.
Training and benchmark fingerprints are joined, and hits are extended to exact
10-word windows in the documents that have one. One pass over the documents finds
the candidates for benchmark items of every length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_unique, mark_in, materialise, maybe_in, not_in, unlike

SPAN = 10
K = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing A-Z (folding moves no word boundary), the most
#: frequent characters first.
RAW_WORD = r"[a-z0-9A-Z\x80-\x{10FFFF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold(word: Column) -> Column:
    """A-Z lower-cased. Words of ASCII alone take the plain function, which is faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def raw_words(col: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(RAW_WORD), F.lit(0))


def words(col: str = "text") -> Column:
    """Words after lower-casing A-Z; null has none."""
    return F.transform(raw_words(col), fold)


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of every k consecutive entries (an array; empty if too short)."""
    n = F.size(hashes)
    at = F.sequence(F.lit(0), n - k)
    return F.when(n >= k, F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def winnow(grams: Column, w: int) -> Column:
    """Distinct minima of every w consecutive hashes."""
    n = F.size(grams)
    at = F.sequence(F.lit(0), n - w)
    least = F.transform(at, lambda i: F.least(*(F.get(grams, i + j) for j in range(w))))
    return F.when(n >= w, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, keys: list[str], span: int, k: int, short: tuple[int, ...] = ()) -> DataFrame:
    """``keys``, n_words and the distinct fingerprints ``fps`` of each text: the
    winnowed ones, and all runs of the ``short`` lengths."""
    # each step a column of its own, so that no lambda computes it again
    df = df.select(*keys, F.transform(raw_words(), lambda x: F.xxhash64(fold(x))).alias("_w"))
    df = df.select(*keys, "_w", gram_hashes(F.col("_w"), k).alias("_g"))
    all_ = [winnow(F.col("_g"), span - k + 1), *(gram_hashes(F.col("_w"), n) for n in short)]
    return df.select(*keys, F.size("_w").cast("long").alias("n_words"), (F.array_distinct(F.concat(*all_)) if short else all_[0]).alias("fps"))


#: Windows of a text that are built at a time.
RUN = 256


def windows(df: DataFrame, keys: list[str], length: int) -> DataFrame:
    """``keys``, start and the words of every window of ``length`` words. A text is cut
    into runs of RUN windows first, so no row holds all of its windows."""
    n = F.size("_words")
    cuts = F.sequence(F.lit(1), n - length + 1, F.lit(RUN))
    runs = F.transform(cuts, lambda i: F.struct(i.alias("at"), F.slice("_words", i, RUN + length - 1).alias("words")))
    each = df.where(n >= length).select(*keys, F.explode(runs).alias("_run"))
    each = each.select(*keys, F.col("_run.at").alias("_at"), F.col("_run.words").alias("_words"))
    own = F.transform(F.sequence(F.lit(1), F.size("_words") - length + 1), lambda i: F.concat_ws(" ", F.slice("_words", i, length)))
    found = each.select(*keys, "_at", F.posexplode(own).alias("_pos", "window"))
    return found.select(*keys, (F.col("_at") - 1 + F.col("_pos")).cast("int").alias("start"), "window")


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(``keep`` columns, _key and n_words of every document) and (_key, items, start,
    length) of every occurrence of a benchmark window, with the sorted items that have
    it.

    ``docs`` has _key (equal only for equal texts) and text, ``benchmark`` item and
    text. Items of fewer than ``span`` words are looked up as one window through the
    hashes of all runs of their length. Windows are joined, not items: a passage of
    many items makes one row for each place.
    """
    items = benchmark.select("item", words().alias("_words")).where(F.size("_words") > 0)
    n = F.least(F.size("_words"), F.lit(span))
    items = materialise(items.withColumn("length", n), "items")
    short = tuple(sorted(r[0] for r in items.where(F.col("length") < span).select("length").distinct().collect()))  # at most span - 1 values
    # written out whole: an optimizer that drops n_words would fold the steps into one lambda
    probe = materialise(fingerprints(benchmark, [], span, k), "fps").select(F.explode("fps").alias("fp"))
    bench_windows = windows(items, ["item", "length"], span)
    for m in short:
        own = items.where(F.col("length") == m)
        probe = probe.unionByName(own.select(F.explode(gram_hashes(F.transform("_words", lambda x: F.xxhash64(x)), m)).alias("fp")))
        bench_windows = bench_windows.unionByName(windows(own, ["item", "length"], m))
    probe = materialise(probe.distinct(), "probe")
    classes = bench_windows.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    classes = materialise(classes.select("*", F.xxhash64("window", "length").alias("_wid")), "windows")

    # one pass: a row for each fingerprint that may be wanted, and one for each document
    prints = fingerprints(docs, [*keep, "_key"], span, k, short)
    each = prints.select(*keep, "_key", "n_words", F.posexplode_outer("fps").alias("_at", "fp"))
    seen = materialise(mark_in(each, probe, "fp", "_likely").where("_likely or coalesce(_at, 0) = 0"), "prints")
    candidates = materialise(seen.where("_likely").join(probe, "fp", "left_semi").select("_key").distinct(), "leaks")
    # copies fold into one within their task before texts move
    texts = maybe_in(docs.select("_key", "text"), candidates, "_key").dropDuplicates(["_key"])
    texts = texts.join(candidates, "_key", "left_semi").select("_key", words().alias("_words"))
    runs = windows(texts, ["_key"], span).withColumn("length", F.lit(span))
    for m in short:
        runs = runs.unionByName(windows(texts, ["_key"], m).withColumn("length", F.lit(m)))
    runs = runs.withColumn("_wid", F.xxhash64("window", "length"))
    runs = materialise(maybe_in(runs, classes.select("_wid"), "_wid"), "runs")
    # a window is told by its words and length; the number only names it
    name = F.struct("window", "length").alias("_window")
    sizes = runs.groupBy(name).agg(F.count("*").alias("_rows"))
    found = join_unique(runs.select("_key", "start", name), classes.select(name, "items"), "_window", sizes)
    counted = seen.where("coalesce(_at, 0) = 0").select(*keep, "_key", "n_words")
    return counted, found.select("_key", "items", F.col("start").cast("long").alias("start"), F.col("_window.length").cast("long").alias("length"))


def _covered(spans: Column) -> Column:
    """Positions covered by an array of (start, end), sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"),
        F.greatest(a["end"], s["end"]).alias("end"),
    )
    return F.aggregate(spans, zero, step)["n"]


def _key_of(text: str) -> Column:
    """Names a text: equal only for equal texts, short, and never null."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items of
    every document.

    A word is hit if it lies in any occurrence of a window of ``span`` item words
    (of the whole item, if it is shorter). Null or empty text has no words and
    isn't contaminated; null item_ids are searched too, but aren't among the items;
    repeated rows each get a row, and equal texts are searched once. An empty table
    gives no rows, a text of any length is read whole, other columns are not read.
    """
    keyed = docs.select("doc_id", "text", _key_of("text").alias("_key"))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    slim, found = hits(keyed, bench, ["doc_id"], span, k)
    ends = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    per_doc = found.groupBy("_key").agg(F.array_sort(F.collect_set(ends)).alias("_spans"), F.collect_set("items").alias("_lists"))
    per_doc = per_doc.select("_key", _covered(F.col("_spans")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("_lists"))).alias("items"))
    per_doc = materialise(per_doc, "hits")
    # rows without a hit need no join; a text of many rows doesn't go to one task
    likely = maybe_in(slim, per_doc, "_key")
    sizes = likely.groupBy("_key").agg(F.count("*").alias("_rows"))
    joined = join_unique(likely, per_doc, "_key", sizes, "left")
    rest = unlike(slim, per_doc, "_key").select("*", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    joined = joined.unionByName(rest)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        items.alias("items"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The documents without any hit, with their own columns."""
    key = free_name(docs, "_hit")
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    _, found = hits(docs.select("text", _key_of("text").alias("_key")), bench, [], span, k)
    found = materialise(found.select(F.col("_key").alias(key)).distinct(), "hits")
    return not_in(docs.withColumn(key, _key_of("text")), found, key).drop(key)
