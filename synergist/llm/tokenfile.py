"""Token files: flat unsigned integers with 64-bit document offsets.

A dataset is a folder of shards in ascending doc_id order. ``<shard>.bin`` holds
little-endian token ids, ``<shard>.idx`` little-endian 64-bit integers: the
number of documents n, n+1 token offsets within the shard, then n doc_ids. The
``manifest`` table has one row for each shard with the ids and documents before
it, prefix sums over the shards' counts. Readers memory-map local files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice, pairwise
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyarrow import fs

from .common import fresh_path, map_arrow


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _publish(folder: str, name: str, data: bytes) -> None:
    """Write under an attempt's own name, then rename: a retried task replaces
    the file whole."""
    files, path = _filesystem(folder)
    mine = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(mine) as out:
        out.write(data)
    files.move(mine, f"{path}/{name}")


def _map(folder: str, name: str, kind: str, first: int = 0, end: int | None = None) -> np.ndarray:
    """Entries of a shard's file as an array: memory-mapped where the folder is local,
    elsewhere just these entries are read."""
    files, path = _filesystem(folder)
    if isinstance(files, fs.LocalFileSystem):
        full = f"{path}/{name}"
        return np.memmap(full, kind, "r")[first:end] if os.path.getsize(full) else np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    with files.open_input_file(f"{path}/{name}") as f:
        f.seek(first * width)
        return np.frombuffer(f.read() if end is None else f.read((end - first) * width), kind)


#: How byte-level vocabularies write the space.
SPACE = "\u0120"


class PieceEncoder:
    """Encodes texts through a tokenizer of the tokenizers library, remembering
    the ids of space-delimited pieces.

    A byte-level pre-tokenizer never joins a non-space character to the space
    after it, so a text may be cut there; pieces that begin or end in other
    white space are never cut apart. The memory is bounded by ``max_pieces``.
    """

    def __init__(self, path: str, end_id: int, max_pieces: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        # 16 bits where all ids fit
        self.kind = "<u2" if max(end_id, *vocab.values()) < 1 << 16 else "<u4"
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}
        # ids whose token begins with the space's byte symbol
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True

    def _encode(self, pieces: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        flat = np.fromiter((i for e in got for i in e.ids), self.kind).tobytes()
        width = np.dtype(self.kind).itemsize
        ends = [0, *accumulate(len(e.ids) * width for e in got)]
        return [flat[a:b] for a, b in pairwise(ends)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it, from one joined text: a token
        that begins with a space begins a word."""
        ids = np.array(self.tokenizer.encode(" " + " ".join(words), add_special_tokens=False).ids, np.int64)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words) or starts[0]:
            return self._encode([f" {w}" for w in words])
        flat, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        ends = [*(starts * width).tolist(), len(flat)]
        return [flat[a:b] for a, b in pairwise(ends)]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.max_pieces:
            # frequent pieces come early: the older half stays
            self.known = dict(islice(self.known.items(), self.max_pieces // 2))
        todo = list(words)
        for at in range(0, len(todo), 2000):
            part = todo[at : at + 2000]
            self.known.update(zip(part, self._encode_words(part), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split = [t.split(" ") for t in texts]
        heads = self._encode([w[0] for w in split])
        get, open_, new = self.known.get, [], set()
        for d, words in enumerate(split):
            got = list(map(get, words))
            got[0] = heads[d]
            if None in got:
                fresh = {w for w, g in zip(words, got, strict=True) if g is None}
                if not all(fresh) or any(w[-1].isspace() for w in fresh):
                    continue
                open_.append(d)
                new |= fresh
            elif not words[0][-1:].isspace():
                out[d] = b"".join(got)
        self._learn(new)
        get = self.known.get
        for d in open_:
            got = list(map(get, split[d]))
            got[0] = heads[d]
            if None not in got and not split[d][0][-1:].isspace():
                out[d] = b"".join(got)
        # joined across runs of white space, or forgotten meanwhile: encoded whole
        rest = [d for d, x in enumerate(out) if x is None]
        for d, x in zip(rest, self._encode([texts[d] for d in rest]), strict=True):
            out[d] = x
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, end_id: int, max_pieces: int = 1_000_000) -> PieceEncoder:
    """One for each Python worker, so its memory serves several tasks."""
    key = path, end_id, max_pieces
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, end_id, max_pieces)
    return _encoders[key]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, batch_chars: int = 1 << 20, max_pieces: int = 1_000_000) -> DataFrame:
    """Encode doc_id and text of ``docs`` into shards under ``folder`` and return
    the manifest (shard, n_docs, n_tokens, doc_base, token_base, dtype).

    Null text is empty, and each document ends in ``end_id``. Rows that share a
    doc_id are ordered by text, null ids come first (as the smallest long).
    Ids take 16 bits if all of the tokenizer's and ``end_id`` fit, else 32. A worker
    remembers the ids of at most ``max_pieces`` pieces, some 250 bytes each.
    """
    spark = docs.sparkSession
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer, end_id, max_pieces)
        end = np.array([end_id], enc.kind).tobytes()
        width = len(end)
        sizes, ids, total = [], [], 0
        name = f"shard-{shard:06d}"
        attempt = TaskContext.get().taskAttemptId()
        files, path = _filesystem(folder)
        mine = f"{path}/.{name}.bin.{attempt}"
        out = files.open_output_stream(mine)
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id")
            todo: list[str] = []
            size = 0
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or size > batch_chars:
                    for got in enc.encode(todo):
                        out.write(got)
                        out.write(end)
                        sizes.append(len(got) // width + 1)
                        total += sizes[-1]
                    todo, size = [], 0
                if k < batch.num_rows:
                    todo.append(texts[k].as_py())
                    size += len(todo[-1])
            ids.append(keys.to_numpy(zero_copy_only=False))
        out.close()
        if not sizes:
            files.delete_file(mine)
            return
        files.move(mine, f"{path}/{name}.bin")
        index = np.concatenate([[len(sizes)], [0], np.cumsum(sizes), *ids]).astype("<i8")
        _publish(folder, f"{name}.idx", index.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([total], pa.int64()), pa.array([enc.kind])], names=["shard", "n_docs", "n_tokens", "dtype"])

    smallest = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), smallest).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # the shards' counts: one row for each shard, so the prefix sums need one small window
    map_arrow(ordered, encode, "shard int, n_docs long, n_tokens long, dtype string").write.parquet(f"{folder}/counts")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = spark.read.parquet(f"{folder}/counts")
    manifest = counts.select(
        "shard",
        "n_docs",
        "n_tokens",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
        "dtype",
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, part: int = 4096) -> DataFrame:
    """Documents of a dataset: doc_id, start (ids before it in the whole
    dataset), n_tokens with the end id, and ids_crc32 over its ids as
    little-endian unsigned 32-bit integers. Ids that were null come back null."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"shard-{row['shard']:06d}"
                index = _map(folder, f"{name}.idx", "<i8")
                n = int(index[0])
                offsets, keys = index[1 : n + 2], index[n + 2 :]
                for a in range(0, n, part):
                    b = min(n, a + part)
                    base = int(offsets[a])
                    tokens = _map(folder, f"{name}.bin", row["dtype"], base, int(offsets[b]))
                    crc = [zlib.crc32(tokens[offsets[k] - base : offsets[k + 1] - base].astype("<u4").tobytes()) for k in range(a, b)]
                    key = keys[a:b]
                    cols = [pa.array(key, mask=key == -(1 << 63)), pa.array(offsets[a:b] + row["token_base"]), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    manifest = manifest.repartition(max(1, manifest.count()), "shard")  # one task for each shard or so
    return map_arrow(manifest, load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(folder: str, shard: int, dtype: str = "<u2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc_ids) of one shard, memory-mapped: the training-side reader."""
    index = _map(folder, f"shard-{shard:06d}.idx", "<i8")
    n = int(index[0])
    return _map(folder, f"shard-{shard:06d}.bin", dtype), index[1 : n + 2], index[n + 2 :]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, max_pieces: int = 1_000_000) -> DataFrame:
    """Write ``docs`` to a new dataset in the shared folder and read it back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    write(docs, folder, tokenizer, end_id, max_pieces=max_pieces)
    return read(spark, folder)


def local_path(folder: str) -> str:
    return urlparse(folder).path if "://" in folder else folder
