"""Packing token sequences: best fit, then swap-based local search.

Documents become pieces of at most the capacity. Pieces are dealt to blocks of a
bounded size; within a block they are packed by best fit, and then bins that are
not full exchange pieces, one for one, two for one or one for two, or give one
away, wherever that raises the sum of squared fills, until the emptiest bins are
empty. The emptiest bins that are left in several blocks meet in one block of the
next round, so no task ever holds more than a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, runs
from .tokenfile import encoder

#: Pieces of a block, and blocks whose emptiest bins meet in the next round.
BLOCK, FAN = 20_000, 16
#: Pieces and pairs of the giving bin that are tried at a time, neighbours that a piece
#: of a taking bin is paired with, and exchanges that a block may make for each bin.
SINGLES, PAIRS, REACH, STEPS = 32, 64, 8, 4


def best_fit(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, fill of each bin); large pieces go first, each to the fullest
    bin that has room."""
    where, fill = np.empty(len(size), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r
    for i in np.argsort(-size, kind="stable").tolist():
        s = int(size[i])
        fits = rooms >> s
        if fits:
            room = s + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i] = b
        fill[b] += s
        left = room - s
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return where, np.array(fill, np.int64)


def _choices(own: np.ndarray, size: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """What a bin may give: single pieces of different sizes, and pairs of them."""
    seen, single = set(), []
    for i in own[np.argsort(-size[own], kind="stable")].tolist():
        if int(size[i]) not in seen:
            seen.add(int(size[i]))
            single.append(i)
    single = single[:SINGLES]
    out = [(int(size[i]), (i,)) for i in single]
    near = own[: SINGLES // 2].tolist()
    pairs = {int(size[i] + size[j]): (i, j) for x, i in enumerate(near) for j in near[x + 1 :]}
    return out + sorted(pairs.items(), reverse=True)[:PAIRS]


def _exchange(giver: int, size: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int) -> tuple[tuple[int, ...], tuple[int, ...], int] | None:
    """(pieces that leave the giver, pieces that come back, taker) of the exchange that
    moves most tokens to a bin and raises the squared fill; None if there is none."""
    room = capacity - fill
    options = _choices(np.flatnonzero(where == giver), size)
    able = np.flatnonzero((room > 0) & (fill > 0) & (np.arange(len(fill)) != giver))
    if not len(able) or not options:
        return None
    best, found = 0, None

    def offer(back: np.ndarray, taker: np.ndarray, items: np.ndarray) -> None:
        nonlocal best, found
        for give, pieces in options:
            if give <= best or (len(pieces) > 1 and items.ndim == 2 and items.shape[1] > 1):
                continue
            gain = give - back
            ok = (gain > best) & (gain <= room[taker]) & (fill[taker] + gain > fill[giver])
            if ok.any():
                k = int(np.argmax(np.where(ok, gain, 0)))
                best = int(gain[k])
                found = pieces, tuple(int(x) for x in np.atleast_1d(items[k])), int(taker[k])

    offer(np.zeros(len(able), np.int64), able, np.zeros((len(able), 0), np.int64))
    is_able = np.zeros(len(fill), bool)
    is_able[able] = True
    items = np.flatnonzero(is_able[where])
    items = items[np.argsort(where[items], kind="stable")]
    offer(size[items], where[items], items[:, None])
    for lag in range(1, REACH + 1):
        a, b = items[:-lag], items[lag:]
        same = where[a] == where[b]
        a, b = a[same], b[same]
        if not len(a):
            break
        offer(size[a] + size[b], where[a], np.stack((a, b), 1))
    return found


def improve(size: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int) -> None:
    """Local search in place, from the emptiest bins up, until no exchange raises the
    squared fill, the bins are as few as the sum of sizes allows, or STEPS exchanges for
    each bin are made."""
    least, steps = -(-int(size.sum()) // capacity), STEPS * len(fill)
    while steps > 0 and np.count_nonzero(fill) > least:
        moved = False
        givers = np.flatnonzero((fill > 0) & (fill < capacity))
        for giver in givers[np.argsort(fill[givers], kind="stable")][:64].tolist():
            while steps > 0 and fill[giver] and (got := _exchange(giver, size, where, fill, capacity)):
                out, back, taker = got
                delta = int(size[list(out)].sum() - size[list(back)].sum())
                where[list(out)], where[list(back)] = taker, giver
                fill[taker] += delta
                fill[giver] -= delta
                steps, moved = steps - 1, True
            if moved:
                break
        if not moved:
            return


def pack_block(size: np.ndarray, capacity: int, old: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, fill of each bin), never more bins than ``old`` had."""
    where, fill = best_fit(size, capacity)
    if old is not None and np.count_nonzero(fill) > len(np.unique(old)):
        _, where = np.unique(old, return_inverse=True)
        fill = np.bincount(where, weights=size).astype(np.int64)
    improve(size, where, fill, capacity)
    return where, fill


def _round(items: DataFrame, number: int, last: bool, capacity: int) -> DataFrame:
    """One round over (uid, length, block, bin): uid, length, block, bin, offset, and
    whether the piece's bin goes to the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, "block"):
            uid, size, old = (block[x].to_numpy() for x in ("uid", "length", "bin"))
            where, fill = pack_block(size, capacity, None if (old < 0).any() else old)
            again = np.zeros(len(fill), bool)
            if not last:
                room = np.flatnonzero((fill > 0) & (fill < capacity))
                again[room[np.argsort(fill[room], kind="stable")][: max(1, np.count_nonzero(fill) // FAN)]] = True
            order = np.lexsort((uid, where))
            before = np.cumsum(size[order]) - size[order]
            head = np.concatenate(([True], where[order][1:] != where[order][:-1]))
            offset = before - np.maximum.accumulate(np.where(head, before, 0))
            name = int(block["block"][0].as_py())
            bin_ = (number << 56) + (name << 20) + where[order]
            cols = [uid[order], size[order], np.full(len(uid), name), bin_, offset, again[where[order]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["uid", "length", "block", "bin", "offset", "again"])

    dealt = items.repartition("block").sortWithinPartitions("block", "uid")
    return map_arrow(dealt, run, "uid long, length long, block long, bin long, offset long, again boolean")


def pack(items: DataFrame, capacity: int = 2048, block: int = BLOCK) -> DataFrame:
    """(uid, sequence_id, offset): a place for each of ``items`` (uid unique, length from
    1 to ``capacity``). The places of a sequence are gapless from 0."""
    full = items.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("uid", F.col("length").cast("long").alias("length"))
    blocks = max(1, -(-rest.count() // block))
    todo = rest.select("*", F.pmod(F.xxhash64("uid", F.lit(41)), F.lit(blocks)).alias("block"), F.lit(-1).cast("long").alias("bin"))
    number, placed = 0, full
    while True:
        got = materialise(_round(todo, number, blocks == 1, capacity), "packed")
        placed = placed.unionByName(got.where("not again").select("uid", F.col("bin").alias("sequence_id"), "offset"))
        if blocks == 1:
            return placed
        todo = got.where("again").select("uid", "length", F.floor(F.col("block") / FAN).alias("block"), "bin")
        number, blocks = number + 1, -(-blocks // FAN)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, batch_chars: int = 1 << 20) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece. A document is its ids
    and ``end_id``; if it is longer than ``capacity`` it is cut so that only the first
    piece may be shorter."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        end = np.array([end_id], enc.kind)
        for batch in batches:
            texts, n, k = batch.column("text"), batch.num_rows, 0
            while k < n:
                first, part, chars = k, [], 0
                while k < n and chars <= batch_chars:
                    part.append(texts[k].as_py())
                    chars += len(part[-1])
                    k += 1
                row, piece, start, length, crc = [], [], [], [], []
                for at, got in enumerate(enc.encode(part), first):
                    ids = np.concatenate((np.frombuffer(got, enc.kind), end)).astype("<u4")
                    a, b, number = 0, (len(ids) - 1) % capacity + 1, 0
                    while a < len(ids):
                        row.append(at)
                        piece.append(number)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        a, b, number = b, b + capacity, number + 1
                cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Null text is empty (a piece of the end id alone); rows that repeat a doc_id, null
    ones too, are documents of their own; a text of any length is encoded whole, an
    empty table gives no rows, and other columns are not read.
    """
    table = materialise(pieces(docs.select("doc_id", "text"), tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return table.join(pack(table.select("uid", "length"), capacity), "uid").drop("uid")
