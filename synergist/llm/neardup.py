"""Near-duplicate detection by the chosen-path set similarity join.

Every document is a set of word shingles. In each of several independent trees
a document descends to the children named by selected minwise tokens; nodes
that stay large branch again on further tokens, small nodes are compared
exhaustively on minwise sketches. What looks similar is then confirmed on the
full sets, in groups of bounded size, and links are joined into components.

Identical sets are one class from the start, so copies never multiply; a class is
told by 128 bits, 64 from each of two independent hashes of the words' bytes. A pair at
similarity s shares a child with probability s for each selected token: with 8
first-level branches (4 trees of 2) and 2 below, a pair at 0.85 is missed in a
share of about 1e-6 even three levels deep.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, NONSPACE, Words, chunks, join_unique, map_arrow, map_text, materialise, maybe_in, mix64, not_in, runs, text_bytes

TREES, BRANCH, LEVELS = 4, 2, 3
#: Tokens used by each level: every node of every tree has its own hash function.
PER_LEVEL = [TREES * BRANCH**level for level in range(1, LEVELS + 1)]
FIRST = np.concatenate(([0], np.cumsum(PER_LEVEL))).tolist()
SKETCH = 64
#: Nodes of up to LEAF documents are compared exhaustively on sketches; full sets
#: are confirmed in groups of about GROUP documents.
LEAF = 1000
GROUP = 200
LEADERS = 16
#: Share of the pairs at the threshold that the sketch filter may miss.
MISS = 1e-6

_MULTIPLIERS = mix64(np.arange(101, 101 + SKETCH, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a chunk. A text of
    fewer than ``k`` words is one shingle; without words the set is empty."""
    return _sets(Words(data, bounds, NONSPACE, FOLD), k, seed)


def _sets(w: Words, k: int, seed: int) -> list[np.ndarray]:
    h = w.hashes(seed)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mix64(one * np.uint64(0xD1342543DE82EF95) + x)
            out.append(one)
        else:
            out.append(h[:0])
    return out


def _sums(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit digest of each of several sets that aren't empty."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    return np.add.reduceat(mix64(np.concatenate(sets)), at)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, _id, n (set size), d (128-bit digest of the set), mins (32-bit
    minwise tokens for branching) and sig (16-bit ones for estimates)."""

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        words = Words(data, bounds, NONSPACE, FOLD)
        sets, other = _sets(words, k, 0), _sets(words, k, 1)
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        out = {"n": n, "d": [b""] * len(n), "mins": [b""] * len(n), "sig": [b""] * len(n)}
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
            digest = np.stack([_sums([x[i] for i in full]) for x in (sets, other)], 1)
            tokens = np.empty((len(full), SKETCH), np.uint32)
            for j, m in enumerate(_MULTIPLIERS):
                tokens[:, j] = np.minimum.reduceat((flat * m) >> np.uint64(32), at)
            low = (tokens ^ (tokens >> np.uint32(16))).astype(np.uint16)
            for row, i in enumerate(full.tolist()):
                out["d"][i] = digest[row].tobytes()
                out["mins"][i] = tokens[row].astype(">u4").tobytes()
                out["sig"][i] = low[row].tobytes()
        return out

    rows = docs.select("doc_id", "_id", text_bytes().alias("_raw"))
    return map_text(rows, ["doc_id", "_id"], "n long, d binary, mins binary, sig binary", work)


def least_equal(num: int, den: int, miss: float = MISS) -> int:
    """Equal tokens of SKETCH that a pair needs to count as similar: all but a share
    ``miss`` of the pairs at num/den have as many (exact binomial)."""
    s, below, t = num / den, 0.0, 0
    while below <= miss and t <= SKETCH:
        below += comb(SKETCH, t) * s**t * (1 - s) ** (SKETCH - t)
        t += 1
    return t - 1


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _candidates(node_rows: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, members): groups within small nodes (key, doc_id, n, sig) whose sketches
    look similar. Where the rows have a label, only documents of different labels
    are compared."""
    floor = least_equal(num, den)
    labelled = "label" in node_rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, groups = [], []
        for node in runs(batches, "key"):
            if node.num_rows < 2:
                continue
            ids, n = node["doc_id"].to_numpy(), node["n"].to_numpy()
            sig = np.frombuffer(b"".join(node["sig"].to_pylist()), np.uint16).reshape(-1, SKETCH)
            label = node["label"].to_numpy() if labelled else None
            parent = list(range(len(ids)))
            for i in range(len(ids) - 1):
                like = (sig[i + 1 :] == sig[i]).sum(1) >= floor
                like &= den * np.minimum(n[i + 1 :], n[i]) >= num * np.maximum(n[i + 1 :], n[i])
                if labelled:
                    like &= label[i + 1 :] != label[i]
                for j in np.flatnonzero(like) + i + 1:
                    parent[_find(parent, int(j))] = _find(parent, i)
            by: dict[int, list[int]] = {}
            for i in range(len(ids)):
                by.setdefault(_find(parent, i), []).append(int(ids[i]))
            for group in by.values():
                group = sorted(set(group))
                if len(group) > 1:
                    cids.append(_group_id(np.array(group, np.int64)))
                    groups.append(group)
            if len(cids) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(groups, pa.list_(pa.int64()))], names=["cid", "members"])
                cids, groups = [], []
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(groups, pa.list_(pa.int64()))], names=["cid", "members"])

    return map_arrow(node_rows.repartition("key").sortWithinPartitions("key"), run, "cid long, members array<long>")


def _group_id(ids: np.ndarray) -> int:
    """The same 64 bits for the same set of ids, in whatever node it is found."""
    return int(np.add.reduce(mix64(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))).view(np.int64))


def _confirm(groups: DataFrame, docs: DataFrame, k: int, num: int, den: int, once: bool = False) -> DataFrame:
    """(a, b): links within each group (cid, doc_id, label; at most a few hundred
    documents), confirmed on full sets. Documents of one label count as linked
    already; of every component only edges to its smallest member come out. With
    ``once``, ``docs`` may repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for group in runs(batches, "cid"):
            ids, labels = group["doc_id"].to_pylist(), group["label"].to_pylist()
            raw = group["_raw"].combine_chunks()
            sets = [s for _, _, data, bounds in chunks(raw) for s in shingle_sets(data, bounds, k)]
            sizes = [len(s) for s in sets]
            parent, head = list(range(len(ids))), {}
            for i, x in enumerate(labels):
                if x is not None:
                    parent[_find(parent, i)] = _find(parent, head.setdefault(x, i))
            for i in range(len(ids)):
                for j in range(i + 1, len(ids)):
                    small, large = sorted((sizes[i], sizes[j]))
                    if den * small < num * large or not small or _find(parent, i) == _find(parent, j):
                        continue
                    both = np.concatenate((sets[i], sets[j]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if den * shared >= num * (small + large - shared):
                        parent[_find(parent, j)] = _find(parent, i)
            least: dict[int, int] = {}
            for i, x in enumerate(ids):
                r = _find(parent, i)
                least[r] = min(x, least.get(r, x))
            for i, x in enumerate(ids):
                if x != least[_find(parent, i)]:
                    a_out.append(x)
                    b_out.append(least[_find(parent, i)])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    texts = maybe_in(docs.select(F.col("_id").alias("doc_id"), text_bytes().alias("_raw")), groups, "doc_id")
    if once:
        # rows that repeat a document fold into one before they are compared
        texts = texts.groupBy("doc_id").agg(F.first("_raw").alias("_raw"))
    rows = groups.join(texts, "doc_id").select("cid", "doc_id", "label", "_raw")
    return map_arrow(rows.repartition("cid").sortWithinPartitions("cid", "doc_id"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label): smallest member of each connected component, for every
    endpoint. Alternates large-star and small-star steps, each written out, until
    the edges are stars: every document has one edge or is a centre, never both."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours, and whoever has a smaller one, point at the smallest
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a's smaller neighbours and a itself point at the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = materialise(small, "cc")
    centres = e.select("b").distinct()
    return e.select(F.col("a").alias("doc_id"), F.col("b").alias("label")).unionByName(centres.select(F.col("b").alias("doc_id"), F.col("b").alias("label")))


def _stars(e: DataFrame) -> bool:
    """Whether the different edges (a, b), b the smaller, are stars around smallest members."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and down = 1)"))).first()[0] == 0


def _nodes(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(leaf rows, rows of nodes that stay large at the last level), each (key,
    doc_id). Nodes of one document are dropped."""
    roots = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(0).cast("long").alias("key")) for i in range(TREES)])
    # the roots hold all documents, so the first level needs no join
    rows = reps.select("doc_id", "mins", F.explode(roots).alias("p")).select("doc_id", "mins", "p.at", "p.key")
    leaves, big = None, None
    for level in range(LEVELS):
        first = FIRST[level]
        children = F.transform(
            F.sequence(F.lit(0), F.lit(BRANCH - 1)),
            lambda j: F.struct((F.col("at") * BRANCH + j).alias("at"), F.xxhash64("key", F.col("at") * BRANCH + j, F.substring("mins", ((F.col("at") * BRANCH + j) + first) * 4 + 1, F.lit(4))).alias("key")),
        )
        grown = rows.select("doc_id", F.explode(children).alias("p")).select("doc_id", "p.at", "p.key")
        if level:  # counted and joined below: the join that made it runs once
            grown = materialise(grown, "grown")
        counts = grown.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
        sized = materialise(grown.join(counts, "key"), "nodes")
        leaf = sized.where(F.col("_n") <= LEAF).select("key", "doc_id")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        large = sized.where(F.col("_n") > LEAF)
        if not large.take(1):
            return leaves, None
        big = large.select("key", "doc_id")
        rows = _with_columns(large, ["at", "key"], reps.select("doc_id", "mins"))
    return leaves, big


def _with_columns(rows: DataFrame, columns: list[str], reps: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ``columns``; at most a few dozen of a document) with the columns of
    ``reps``. A document meets its row once, not once for each node that it is in."""
    nodes = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("_p"))
    return nodes.join(reps, "doc_id").withColumn("_p", F.explode("_p")).select("doc_id", "_p.*", *(c for c in reps.columns if c != "doc_id"))


def link(docs: DataFrame, k: int, num: int, den: int, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with n and class digest, classes with their head and rows, labels
    of linked class heads). With ``once``, rows of ``docs`` may repeat an id."""
    table = materialise(sketches(docs, k), "sketch")
    reps = table.where("n > 0 and _id is not null").groupBy("d").agg(F.min("_id").alias("doc_id"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("sig").alias("sig"), F.count("*").alias("_rows"))
    reps = materialise(reps, "classes")
    leaves, big = _nodes(reps)
    node_rows = _with_columns(leaves, ["key"], reps.select("doc_id", "n", "sig"))
    found = _candidates(node_rows, num, den)
    pairs = found.select(F.explode("members").alias("a"), F.col("members")[0].alias("b"))
    if big is not None:
        # a large node counts as one coarse component until exact checks split it
        head = big.groupBy("key").agg(F.min("doc_id").alias("b"))
        pairs = pairs.unionByName(big.join(head, "key").select(F.col("doc_id").alias("a"), "b"))
    coarse = components(pairs)
    sizes = coarse.groupBy("label").agg(F.count("*").alias("_n"))
    none = F.lit(None).cast("long").alias("label")
    sized = materialise(coarse.join(sizes, "label"), "coarse")
    whole = sized.where(F.col("_n") <= GROUP).select(F.col("label").alias("cid"), "doc_id", none)
    large = sized.where(F.col("_n") > GROUP).select("doc_id", F.col("label").alias("home"), "_n")
    # large components, first pass: blocks of documents, each with the component's leaders
    rank = F.xxhash64("doc_id", F.lit(7))
    spot = F.pmod(rank, F.ceil(F.col("_n") / GROUP))
    blocks = large.select("doc_id", "home", "_n", spot.alias("spot"))
    leaders = large.groupBy("home").agg(F.min_by("_n", "doc_id").alias("_n"), F.expr(f"slice(array_sort(collect_set(case when pmod(xxhash64(doc_id, 11), greatest(1, _n div {4 * LEADERS})) = 0 then doc_id end)), 1, {LEADERS})").alias("ids"))
    spread = leaders.select("home", F.explode("ids").alias("doc_id"), F.ceil(F.col("_n") / GROUP).alias("m")).select("home", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("spot"))
    first = blocks.select("home", "doc_id", "spot").unionByName(spread.select("home", "doc_id", "spot")).distinct()
    first = first.select(F.xxhash64("home", "spot", F.lit("block")).alias("cid"), "doc_id", none)
    links = materialise(_confirm(whole.unionByName(first), docs, k, num, den, once), "links")
    if not large.take(1):
        return table, reps, components(links)

    # second pass, exact: in each large component every document outside the main
    # label meets all documents of the component, block by block; sketches meet
    # first, and texts only where they look similar under different labels
    labels = materialise(components(links), "labels")
    at = large.select("doc_id", "home").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    at = materialise(at, "apart")
    main = at.groupBy("home", "label").agg(F.count("*").alias("_c")).groupBy("home").agg(F.max_by("label", F.struct("_c", "label")).alias("main"), F.sum("_c").alias("_n"), F.max("_c").alias("_m")).where("_m < _n")
    half = GROUP // 2
    blocks_of = lambda n: F.ceil(n / half)
    at = at.join(main, "home").withColumns({"_rows": blocks_of(F.col("_n") - F.col("_m")), "_cols": blocks_of(F.col("_n"))})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # a document meets its sketch before its blocks spread out
    sketched = at.join(reps.select("doc_id", "n", "sig"), "doc_id")
    left = sketched.where("label <> main").select("home", "doc_id", "label", "n", "sig", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.col("_rows")).alias("r"), each("_cols").alias("s"))
    right = sketched.select("home", "doc_id", "label", "n", "sig", each("_rows").alias("r"), F.pmod(F.xxhash64("doc_id", F.lit(19)), F.col("_cols")).alias("s"))
    second = left.unionByName(right).select(F.xxhash64("home", "r", "s", F.lit("cross")).alias("key"), "doc_id", "label", "n", "sig").distinct()
    alike = _candidates(second, num, den).groupBy("cid").agg(F.first("members").alias("members"))
    alike = alike.select("cid", F.explode("members").alias("doc_id")).join(at.select("doc_id", "label"), "doc_id").select("cid", "doc_id", "label")
    more = _confirm(materialise(alike, "alike"), docs, k, num, den, once)
    # the first pass is in its labels: their stars stand for its links
    known = labels.where("doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
    return table, reps, components(known.unionByName(more))


def _identified(docs: DataFrame) -> tuple[DataFrame, bool, bool]:
    """``docs`` with ``_id``, a number for each different (doc_id, text), whether it
    differs from doc_id anywhere, and whether a doc_id has several rows. Ids are whole numbers (or text that casts to them).

    It is the doc_id where that has one text only, null ids included. Ids of several
    texts take numbers that no doc_id has.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    per_id = docs.select("doc_id", text.alias("_t")).groupBy("doc_id").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_c"))
    many = materialise(per_id.where("doc_id is not null and _c > 1").select("doc_id", F.expr("_lo <> _hi").alias("_odd")), "many")
    seen = many.agg(F.count("*").alias("n"), F.count_if("_odd").alias("odd")).first()
    odd = many.where("_odd").select("doc_id")
    if not seen.odd:
        return docs.withColumn("_id", F.col("doc_id").cast("long")), False, seen.n > 0
    ends = docs.agg(F.max("doc_id").cast("long").alias("hi"), F.min("doc_id").cast("long").alias("lo")).first()
    hi, lo, room = ends.hi or 0, ends.lo or 0, 1 << 62
    keyed = docs.withColumn("_t", text)
    found = keyed.select("doc_id", "_t").join(odd, "doc_id", "left_semi").distinct()
    serial = F.monotonically_increasing_id()
    number = serial + (hi + 1) if hi < room else -serial + (lo - 1) if lo > -room else F.xxhash64("doc_id", "_t", F.lit("odd"))
    found = materialise(found.select("doc_id", "_t", number.alias("_own")), "numbers")
    joined = keyed.join(found, ["doc_id", "_t"], "left")
    return joined.select(*docs.columns, F.coalesce("_own", F.col("doc_id").cast("long")).alias("_id")), True, True


def _labelled(docs: DataFrame, odd: bool, again: bool, shingle: int, num: int, den: int) -> DataFrame:
    """doc_id, _id, n, label (same for all of a component) and best (its first _id) of
    every row of identified ``docs``."""
    table, classes, labels = link(docs, shingle, num, den, again)
    heads = classes.select("d", F.col("doc_id").alias("_head")).join(labels.select(F.col("doc_id").alias("_head"), "label"), "_head", "left")
    heads = heads.select("d", F.coalesce("label", "_head").alias("label"))
    linked = F.col("_id").isNotNull() & (F.col("n") > 0)
    full = join_unique(table.where(linked).select("doc_id", "_id", "n", "d"), heads, "d", classes.select("d", "_rows")).drop("d")
    rows = full.unionByName(table.where(~linked).select("doc_id", "_id", "n", F.col("_id").alias("label")))
    if not odd:
        return rows.withColumn("best", F.col("label")).withColumn("component_id", F.col("label"))
    # numbers stand for some ids: the least doc_id of a component isn't its label
    rows = materialise(rows, "labelled")
    first = F.min(F.struct(F.col("doc_id").alias("id"), F.col("_id").alias("own"))).alias("m")
    alone = rows.where("label is null").withColumns({"best": F.col("label"), "component_id": F.col("label")})
    rows = rows.where("label is not null")
    per = rows.groupBy("label").agg(first, F.count("*").alias("_rows"))
    best = per.select("label", F.col("m.own").alias("best"), F.col("m.id").alias("component_id"))
    return join_unique(rows, best, "label", per.select("label", "_rows")).unionByName(alone)


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked when the Jaccard similarity of their shingle sets is at
    least ``num``/``den``; component_id is the smallest doc_id reachable. Null or
    empty texts and those without words have empty sets and link with nothing. A
    document is a doc_id with its text: rows that repeat both are one document, rows
    that share the doc_id alone aren't. A null doc_id links with nothing and is kept.
    An empty table gives no rows, a text of any length is read whole, other columns are
    not read; ids that don't cast to whole numbers are an error.
    """
    named, odd, again = _identified(docs.select("doc_id", "text"))
    rows = _labelled(named, odd, again, shingle, num, den)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("_id") == F.col("best"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, with its own columns: of the kept document's rows,
    the first in the order of their columns as JSON. Rows without a doc_id all stay."""
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)), "doc_id", "text")
    named, odd, again = _identified(plain)
    gone = materialise(_labelled(named.select("doc_id", "text", "_id"), odd, again, shingle, num, den).where("_id <> best").select("_id").distinct(), "gone")
    kept = not_in(named, gone, "_id")
    own = [f"_{i}" for i in range(len(docs.columns))]
    if again:
        row = F.struct(*own)
        rows = named.groupBy("_id").agg(F.count("*").alias("_c")).where("_id is not null and _c > 1").select("_id")
        rows = materialise(rows, "again")
        twice = kept.join(rows, "_id", "left_semi").groupBy("_id").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
        kept = kept.join(rows, "_id", "left_anti").select(*own).unionByName(twice)
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
