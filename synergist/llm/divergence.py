"""Source divergence audit with late string materialisation.

Terms are counted as 64-bit digests: the shuffles that count hold no strings. For
the digests that enough documents hold, a second pass reads the terms' texts and
takes the smallest and the largest of each digest; where these differ the digest
stands for several terms, which are then counted by their texts. Terms are joined
back only to the rows that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Seen, Words, bitmap_of, chunks, in_bitmap, map_arrow, materialise, mix64, string_spans, table_of, text_bytes

#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after lower-casing A-Z.
TERM = table_of([*range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes of text that a task counts together.
BLOCK = 1 << 22
#: Sources of a language that are compared with each other at a time.
SOURCES = 256
SCALE = 1_000_000_000
SMOOTH = 5


def _digests(w: Words, bits: int) -> np.ndarray:
    h = w.hashes()
    return h if bits >= 64 else h & np.uint64((1 << bits) - 1)


def _codes(lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """A number for each row's (lang, source), and what the numbers mean."""
    names: dict[tuple[str, str], int] = {}
    codes = np.array([names.setdefault(x, len(names)) for x in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
    return codes, list(names)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each run) that bring equal keys together."""
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(fresh)


def _rows(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), text_bytes().alias("_raw"))


def term_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, source, d, n, docs): occurrences of each digest in each group, and its
    rows that hold it. No strings of terms are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column("lang"), batch.column("source")
            for i, j, data, bounds in chunks(batch.column("_raw"), BLOCK):
                w = Words(data, bounds, TERM)
                if not len(w.doc):
                    continue
                group, names = _codes(lang.slice(i, j - i), source.slice(i, j - i))
                d = _digests(w, bits)
                # once for each document, then for each group
                order, first = _grouped(d, w.doc)
                many = np.diff(np.append(first, len(order)))
                d, g = d[order][first], group[w.doc[order][first]]
                order, first = _grouped(d, g)
                n = np.add.reduceat(many[order], first)
                has = np.diff(np.append(first, len(order)))
                which = g[order][first]
                each = lambda k: pa.DictionaryArray.from_arrays(pa.array(which, pa.int32()), pa.array([x[k] for x in names], pa.string())).cast(pa.string())  # noqa: B023, E731
                cols = [each(0), each(1), pa.array(d[order][first].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(has.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "d", "n", "docs"])

    got = map_arrow(_rows(docs), run, "lang string, source string, d long, n long, docs long")
    return got.groupBy("lang", "source", "d").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_texts(docs: DataFrame, wanted: DataFrame, bits: int = 64, by_source: bool = False) -> DataFrame:
    """(lang, d, term) of the terms whose (lang, d) is wanted, at least once for each part
    of the input; with ``by_source`` also (source, n, docs) of each part. Terms that a
    bitmap of the wanted digests rules out never leave their task."""
    bitmap = bitmap_of(wanted, "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, salts = Seen(), {}
        for batch in batches:
            lang, source = batch.column("lang"), batch.column("source")
            for i, j, data, bounds in chunks(batch.column("_raw"), BLOCK):
                w = Words(data, bounds, TERM)
                d = _digests(w, bits)
                take = np.flatnonzero(in_bitmap(bitmap.value, d))
                group, names = _codes(lang.slice(i, j - i), source.slice(i, j - i))
                # a digest's terms are told apart by a second hash
                salt = np.array([salts.setdefault(x if by_source else x[0], len(salts) + 1) for x in names], np.uint64)[group[w.doc[take]]]
                key = mix64(d[take] ^ mix64(w.span_hash(w.starts[take], w.ends[take], 1) + mix64(salt)))
                if by_source:
                    order, first = _grouped(key)
                    n = np.diff(np.append(first, len(order)))
                    by_doc, start = _grouped(w.doc[take], key)
                    _, has = np.unique(key[by_doc[start]], return_counts=True)
                    take = take[order[first]]
                else:
                    take = take[seen.fresh(key)]
                langs = [names[g] for g in group[w.doc[take]]]
                cols = [pa.array([x[0] for x in langs], pa.string()), pa.array(d[take].view(np.int64)), string_spans(w.data, w.starts[take], w.ends[take])]
                out = ["lang", "d", "term"]
                if by_source:
                    cols += [pa.array([x[1] for x in langs], pa.string()), pa.array(n.astype(np.int64)), pa.array(has.astype(np.int64))]
                    out += ["source", "n", "docs"]
                yield pa.RecordBatch.from_arrays(cols, names=out)

    schema = "lang string, d long, term string" + (", source string, n long, docs long" if by_source else "")
    return map_arrow(_rows(docs), run, schema).join(wanted.select("lang", "d"), ["lang", "d"], "left_semi")


def kept_terms(docs: DataFrame, min_docs: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, source, d, sub, n) of the kept terms, and (lang, d, sub, term). A term is
    (d, sub); ``sub`` is 0 unless several terms share the digest."""
    counts = materialise(term_counts(docs, bits), "terms")
    often = counts.groupBy("lang", "d").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    often = materialise(often.select("lang", "d"), "often")
    ends = term_texts(docs, often, bits).groupBy("lang", "d").agg(F.min("term").alias("term"), F.max("term").alias("last"))
    ends = materialise(ends, "ends")
    alone = ends.where("term = last").select("lang", "d", F.lit(0).alias("sub"), "term")
    kept = counts.join(alone.select("lang", "d", "sub"), ["lang", "d"]).select("lang", "source", "d", "sub", "n")
    shared = ends.where("term <> last").select("lang", "d")
    if shared.take(1):
        texts = materialise(term_texts(docs, materialise(shared, "shared"), bits, by_source=True).groupBy("lang", "source", "d", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "split")
        split = texts.groupBy("lang", "d", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        # the terms of one digest: a few
        split = split.select("lang", "d", F.row_number().over(Window.partitionBy("lang", "d").orderBy("term")).alias("sub"), "term")
        split = materialise(split, "subs")
        alone = alone.unionByName(split)
        kept = kept.unionByName(texts.join(split, ["lang", "d", "term"]).select("lang", "source", "d", "sub", "n"))
    return materialise(kept, "kept"), alone


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    below = (total + SMOOTH * terms).cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.when(below > 0, F.call_function("div", above, below))


def _pair_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, extra): for the sources of places i < j, the sum over kept terms of
    abs(p - q) - abs(base_i - base_j); terms that neither has add nothing.

    ``rows`` has lang, d, sub, at, p; ``groups`` has lang, at, base. Terms are dealt to
    slices, so a language of any size is shared by many tasks; a task holds the sums of
    two blocks of SOURCES sources and a few of their terms at a time.
    """
    width = SOURCES
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = groups.groupBy("lang").agg((F.floor(F.max("at") / width) + 1).cast("int").alias("_blocks"))
    block = F.floor(F.col("at") / width).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    ends = [F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj")]
    spread = lambda df: df.join(n_blocks, "lang").withColumn("_own", block).select("*", partner).select("*", *ends)
    slice_ = F.pmod(F.xxhash64("d", "sub"), F.lit(slices)).cast("int").alias("slice")
    terms = spread(rows).select("lang", slice_, "bi", "bj", F.lit(1).alias("kind"), "d", "sub", "at", "p")
    # every slice knows the base of each source first
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    bases = spread(groups).select("lang", every, "bi", "bj", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("d"), F.lit(0).alias("sub"), "at", F.col("base").alias("p"))
    order = ["lang", "slice", "bi", "bj", "kind", "d", "sub", "at"]
    dealt = bases.unionByName(terms).repartition(slices, "lang", "slice").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None}

        def close() -> Iterator[pa.RecordBatch]:
            if state["key"] is None or state["sums"] is None:
                return
            flush()
            lang, bi, bj = state["key"]
            at = state["at"]
            i, j = np.nonzero(state["sums"])
            good = (at[i] < at[j]) & (at[i] // width == bi) & (at[j] // width == bj)
            i, j = i[good], j[good]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(at[i]), pa.array(at[j]), pa.array(state["sums"][i, j])], names=["lang", "i", "j", "extra"])

        def flush() -> None:
            """Add the held terms' differences."""
            if state["n"] == 0:
                return
            at, base = state["at"], state["base"]
            d, sub, where, p = (np.concatenate(x) for x in state["held"])
            fresh = np.ones(len(d), bool)
            fresh[1:] = (d[1:] != d[:-1]) | (sub[1:] != sub[:-1])
            term = np.cumsum(fresh) - 1
            many = int(term[-1]) + 1
            col = np.searchsorted(at, where)
            step = max(1, (1 << 21) // len(at))
            for a in range(0, many, step):
                b = min(many, a + step)
                mine = (term >= a) & (term < b)
                table = np.repeat(base[None, :], b - a, 0)
                table[term[mine] - a, col[mine]] = p[mine]
                for k in range(len(at)):
                    state["sums"][k] += np.abs(table - table[:, k : k + 1]).sum(0) - (b - a) * np.abs(base - base[k])
            state["held"], state["n"] = ([], [], [], []), 0

        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column("lang").to_pylist()
            bi, bj, kind, d, sub, at, p, sl = (batch.column(x).to_numpy() for x in ("bi", "bj", "kind", "d", "sub", "at", "p", "slice"))
            keys = list(zip(lang, sl.tolist(), bi.tolist(), bj.tolist(), strict=True))
            cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if state.get("run") != keys[a]:
                    yield from close()
                    state = {"run": keys[a], "key": (lang[a], int(bi[a]), int(bj[a])), "sums": None, "bases": ([], []), "held": ([], [], [], []), "n": 0}
                m = a + int(np.searchsorted(kind[a:b], 1))
                if m > a:
                    state["bases"][0].append(at[a:m])
                    state["bases"][1].append(p[a:m])
                if m < b:
                    if state["sums"] is None:
                        state["at"], state["base"] = (np.concatenate(x).astype(np.int64) for x in state["bases"])
                        state["sums"] = np.zeros((len(state["at"]),) * 2, np.int64)
                    # a term's rows stay together: what is held ends with a whole term
                    if state["n"] > 1 << 18:
                        last_d, last_s = state["held"][0][-1][-1], state["held"][1][-1][-1]
                        same = (d[m:b] == last_d) & (sub[m:b] == last_s)
                        tail = int(np.argmin(same)) if not same.all() else b - m
                        for x, v in zip(state["held"], (d, sub, at, p), strict=True):
                            x.append(v[m : m + tail])
                        state["n"] += tail
                        m += tail
                        if m < b:
                            flush()
                    for x, v in zip(state["held"], (d, sub, at, p), strict=True):
                        x.append(v[m:b])
                    state["n"] += b - m
        yield from close()

    got = map_arrow(dealt, run, "lang string, i long, j long, extra long")
    return got.groupBy("lang", "i", "j").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value and rank: how far the sources of a language are
    apart (part ``pair``), and the terms that set a source apart (part ``term``).

    Shares are integers of SCALE, smoothed by SMOOTH for each kept term; the arithmetic
    is exact. Null text, lang and source count as ''. Rows without terms count as
    members of their group only; repeated rows are documents of their own; an empty
    table gives no rows; a text of any length is read whole; other columns are not
    read. Ties of values go by the item's bytes.
    """
    docs = docs.select("text", "lang", "source")
    kept, texts = kept_terms(docs, min_docs, bits)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    present = docs.select(blank("lang"), blank("source")).distinct()
    per_term = materialise(kept.groupBy("lang", "d", "sub").agg(F.sum("n").alias("all_n")), "per_term")
    langs = per_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = present.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_n"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source of a language
    groups = groups.withColumn("at", place.cast("long")).withColumn("base", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0).cast("long")))
    groups = materialise(groups, "groups")

    rows = kept.join(groups.select("lang", "source", "at", "total", "v", "lang_n"), ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    rows = materialise(rows.select("lang", "source", "at", "d", "sub", "p", "v", "lang_n"), "shares")

    extra = _pair_sums(rows.select("lang", "d", "sub", "at", "p"), groups.select("lang", "at", "base"))
    extra = materialise(extra, "extra")
    both = extra.unionByName(extra.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "extra"))
    mine = groups.select("lang", "source", F.col("at").alias("i"), F.col("base").alias("_a"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("j"), F.col("base").alias("_b"))
    # the result has a row for each two sources of a language
    pairs = mine.join(other, "lang").where("i <> j").join(both, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * F.abs(F.col("_a") - F.col("_b")) + F.coalesce("extra", F.lit(0).cast("long"))).alias("value"))
    by_item = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_item))

    over = rows.join(per_term, ["lang", "d", "sub"]).withColumn("value", F.col("p") - share(F.col("all_n"), F.col("lang_n"), F.col("v"))).where("value > 0")
    # ties at the last rank stay until their texts are known
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    best = over.select("lang", "source", "d", "sub", "value").withColumn("_r", F.rank().over(by_value)).where(F.col("_r") <= top)
    named = materialise(best.drop("_r"), "best").join(texts, ["lang", "d", "sub"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    named = named.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    return pairs.unionByName(named)
