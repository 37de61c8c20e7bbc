"""Helpers shared by the corpus operators: tables in the shared folder and
vectorised work on Arrow text batches."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent (tests on one machine) a temporary folder is
    made and set; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage,
    survives lost executors and lets several consumers share one scan."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application, so that
    functions run wherever the session was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: Rows of an Arrow batch.
BATCH_ROWS = 2000


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers. A worker gives back the memory
    that a task has freed, for it waits beside others for its next task; batches of long
    texts have fewer rows than Spark's default, which holds them outside the heap."""
    ship(df.sparkSession)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(most)) <= BATCH_ROWS:
        df.sparkSession.conf.set(most, BATCH_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(task, schema)


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def stable_split(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bits of the candidate filter: a table of at most FILTER / 64 rows.
FILTER = 1 << 23


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mark_in(df: DataFrame, wanted: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` and whether its ``column`` may be among the wanted values (if not, it isn't
    for sure), by a bitmap of them. It has a fixed size, so it is broadcast whatever
    their number."""
    word, bits = free_name(df, "_word"), free_name(df, "_bits")
    spot = f"pmod(xxhash64(`{column}`, 23), {FILTER})"
    at, mask = F.expr(f"cast({spot} div 64 as int)"), F.expr(f"shiftleft(1L, cast({spot} % 64 as int))")
    bitmap = wanted.select(at.alias(word), mask.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    rows = df.withColumn(word, at).join(F.broadcast(bitmap), word, "left")  # at most FILTER / 64 rows
    hit = F.coalesce(F.col(bits).bitwiseAND(mask) != 0, F.lit(False))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), hit.alias(name))


def bitmap_of(wanted: DataFrame, column: str, bits: int = 1 << 24) -> Broadcast[np.ndarray]:
    """A bitmap of a column of 64-bit hashes, for ``in_bitmap`` in tasks. Its size is
    fixed, so what comes to the driver and goes to the executors is too; with very many
    values it rules out few rows, and the exact join that follows decides."""
    spot = F.col(column).bitwiseAND(F.lit(bits - 1))
    word, mask = F.shiftright(spot, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int")).alias("mask")
    got = wanted.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be among the bitmap's."""
    spot = (values & np.uint64(len(bitmap) * 64 - 1)).view(np.int64)
    return (bitmap[spot >> 6] >> (spot & 63)) & 1 == 1


def string_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as an Arrow array of strings."""
    length = ends - starts
    offsets = np.concatenate(([0], np.cumsum(length)))
    at = np.repeat(starts - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


class Seen:
    """Remembers 64-bit keys in a table of fixed size: a key that it knows was given
    before; one that it has forgotten counts as new."""

    def __init__(self, slots: int = 1 << 20):
        self.table = np.zeros(slots, np.uint64)

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys that aren't known, each key once."""
        keys, first = np.unique(keys, return_index=True)
        spot = (keys & np.uint64(len(self.table) - 1)).view(np.int64)
        new = self.table[spot] != keys
        self.table[spot] = keys
        return np.sort(first[new])


def _split(df: DataFrame, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    name = free_name(df, "_in")
    rows = mark_in(df, wanted, column, name)
    return rows.where(F.col(name)).drop(name), rows.where(~F.col(name)).drop(name)


def maybe_in(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the wanted ones.

    Texts of other rows are then not shuffled. With very many wanted values all rows
    may pass; the exact join that follows decides.
    """
    return _split(df, wanted, column)[0]


def unlike(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows that ``maybe_in`` leaves out."""
    return _split(df, wanted, column)[1]


def not_in(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` isn't among the gone ones. Only rows that the
    bitmap can't tell from them are shuffled."""
    likely, rest = _split(df, gone, column)
    return rest.unionByName(likely.join(gone, column, "left_anti"))


#: A key is hot if it has one row in so many; there are at most so many hot keys.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each ``key`` once. ``sizes`` has
    (key, _rows) of all keys of ``left``.

    Rows of hot keys, a thousandth of all rows or more each, meet their row of
    ``right`` without a shuffle; at most HOT rows are broadcast for that. Every
    other key goes to a task with less than a thousandth of the rows.
    """
    total = sizes.agg(F.sum("_rows").alias("_all"))
    hot = sizes.join(F.broadcast(total)).where(F.col("_rows") * HOT >= F.col("_all")).select(key)  # one row; then at most HOT
    known = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))  # at most HOT rows
    fast = left.join(F.broadcast(hot), key, "left_semi").join(known, key, how)  # at most HOT rows
    return fast.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))  # at most HOT rows


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` different ``rows`` in the order of their column ``_r``, a hash of
    their ids, and of the others. Only rows whose hash is small enough for the first
    ``2 * most`` ids or so are shuffled; the estimate of the number of ids doesn't
    depend on repeats."""
    ids = rows.agg(F.approx_count_distinct("_r")).first()[0]
    share = 2 * most / max(1, ids)
    near = rows if share >= 1 else rows.where((F.col("_r").cast("double") + 2.0**63) / 2.0**64 < share)
    return near.distinct().orderBy("_r", *(c for c in rows.columns if c != "_r")).limit(most)


# ---------------------------------------------------------------- Arrow text

CHUNK = 1 << 20


def binary_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column without copying its data."""
    if pa.types.is_large_binary(col.type):
        kind, size = np.int64, 8
    else:
        kind, size = np.int32, 4
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind, len(col) + 1, col.offset * size).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: (first row, end row, bytes, bounds).

    A longer text makes a chunk of its own, so temporary arrays stay
    proportional to the limit or to one text.
    """
    data, off = binary_view(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def table_of(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all non-ASCII.
ALNUM = table_of([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words ``[^\x20\x09-\x0D]+``.
NONSPACE = ~table_of([0x20, *range(0x09, 0x0E)])
#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes up to which a span is hashed in lanes of eight; longer ones go one by one.
LANES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: equal bytes give equal hashes anywhere.

    A span is read in lanes of eight bytes, each mixed into the state by a
    bijection, so spans of one length up to eight bytes never collide. Memory goes
    with the number of spans, not with the bytes.
    """
    length = ends - starts
    h = mix64(length.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    if not len(starts):
        return h
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each position
    todo = np.flatnonzero(length <= LANES)
    at, left = starts[todo], length[todo]
    while len(todo):
        h[todo] = mix64(h[todo] ^ (lanes[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LANES):
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = np.frombuffer(digest, "<u8")[0]
    return h


class Words:
    """Words of a chunk of texts: byte spans, document of each, 64-bit hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, member: np.ndarray, fold: np.ndarray = FOLD):
        self.data = data = fold[data]
        m = member[data]
        n = len(m)
        before = np.zeros(n, bool)
        before[1:] = m[:-1]
        edge = bounds[:-1]
        before[edge[edge < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = m[1:]
        edge = bounds[1:]
        after[edge[edge > 0] - 1] = False
        self.starts = np.flatnonzero(m & ~before)
        self.ends = np.flatnonzero(m & ~after) + 1
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(bounds) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, starts, ends, seed)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, seed)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives to these words."""
    blob = " ".join(words).encode()
    w = Words(np.frombuffer(blob, np.uint8), np.array([0, len(blob)]), ALNUM, np.arange(256, dtype=np.uint8))
    return w.hashes()


def map_text(
    df: DataFrame,
    keep: list[str],
    schema: str,
    work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray | list]],
    raw: str = "_raw",
) -> DataFrame:
    """Run ``work(bytes, bounds)`` over the texts in chunks of about 1 MB and
    put its columns beside the ``keep`` columns. ``raw`` names the column of bytes."""
    out_schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), schema])
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in chunks(batch.column(raw)):
                got = work(data, bounds)
                cols = [batch.column(c).slice(i, j - i) for c in keep]
                names = [*keep, *got]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, types[k]) for k, v in got.items())], names=names)

    return map_arrow(df.select(*keep, raw), run, out_schema)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``column`` from sorted input, one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy(zero_copy_only=False)
        cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)
