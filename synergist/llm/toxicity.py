"""Toxicity by multiple-instance learning.

A document is a bag of sentences; sentence probabilities combine by noisy-or,
1 - prod(1 - p). The sentence model (hashed words and word beginnings) is
trained from document labels only and then also locates the offending sentences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, first_by_hash, map_text, materialise, stable_split, text_bytes
from .quality import _Adam, sigmoid

BITS = 18
#: Byte lengths of the word beginnings used as features beside whole words.
PREFIXES = (3, 4, 5, 6, 8)
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def instances(data: np.ndarray, bounds: np.ndarray):
    """Feature slots and sentences of a chunk.

    Returns (slots [words, 1+len(PREFIXES)] with -1 for none, sentence of each
    word, document of each sentence, byte start and end of each sentence).
    """
    w = Words(data, bounds, ALNUM)
    if not len(w.starts):
        empty = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), empty, empty, empty, empty
    stops = np.concatenate(([0], np.cumsum(_END[data])))
    key = stops[w.starts]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (w.doc[1:] != w.doc[:-1])
    sent = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(key)) - 1
    mask = np.uint64((1 << BITS) - 1)
    length = w.ends - w.starts
    cols = [(w.hashes() & mask).astype(np.int64)]
    for k in PREFIXES:
        ok = length > k
        h = w.span_hash(w.starts, np.minimum(w.starts + k, w.ends)) * np.uint64(0x9E3779B97F4A7C15)
        cols.append(np.where(ok, ((h >> np.uint64(40)) & mask).astype(np.int64), -1))
    return np.stack(cols, 1), sent, w.doc[head], w.starts[head], w.ends[tail]


def sentence_logits(slots: np.ndarray, sent: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Bias plus the summed weights of a sentence; ``weights`` ends with a zero
    (slot -1 is none) before the bias."""
    return np.bincount(sent, weights=weights[:-1][slots].sum(1), minlength=n) + weights[-1]


def noisy_or(p_log_miss: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, weights=p_log_miss, minlength=n))


def screen(seen: np.ndarray, n: np.ndarray, least: float = 12.0) -> np.ndarray:
    """Slots whose presence in a bag goes with the label: those over-represented in
    toxic bags with a likelihood-ratio statistic of at least ``least``. ``seen`` has
    the bags of each label (0, 1) that hold a slot, ``n`` all bags of each label."""
    share = seen.sum(0) / max(n.sum(), 1)
    log = lambda a, b: a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12))
    g = 2 * sum(log(seen[k], n[k] * share) + log(n[k] - seen[k], n[k] * (1 - share)) for k in (0, 1))
    return (g >= least) & (seen[1] / max(n[1], 1) > seen[0] / max(n[0], 1))


def train(bags: list[tuple[np.ndarray, np.ndarray, int, int]], rounds: int = 250, ridge: float = 1e-5) -> np.ndarray:
    """Weights from bags (screened slots with -1 for none, sentence of each word,
    number of sentences, label), by full-batch Adam on the noisy-or log likelihood."""
    size = 1 << BITS
    weights = np.zeros(size + 2)
    weights[-1] = -4.0
    if len({y for *_, y in bags}) < 2 or not sum(len(b[0]) for b in bags):
        return weights
    slots, sent, doc, at = [], [], [], 0
    for d, (s, k, n, _) in enumerate(bags):
        slots.append(s.astype(np.int64))
        sent.append(k.astype(np.int64) + at)
        doc.append(np.full(n, d))
        at += n
    slots, sent, doc = np.concatenate(slots), np.concatenate(sent), np.concatenate(doc)
    y = np.array([b[3] for b in bags], float)
    # compact the slots in use
    used, inverse = np.unique(slots, return_inverse=True)
    inverse = inverse.reshape(slots.shape)
    word = np.repeat(sent, slots.shape[1])
    flat = inverse.ravel()
    real = used >= 0
    w, opt = np.zeros(len(used) + 1), _Adam(len(used) + 1, 0.1)
    w[-1] = -4.0
    scale = 1 / len(y)
    for _ in range(rounds):
        z = np.bincount(sent, weights=(w[:-1] * real)[inverse].sum(1), minlength=at) + w[-1]
        p = sigmoid(z)
        miss = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        bag = np.clip(-np.expm1(miss), 1e-9, 1 - 1e-12)
        pull = np.where(y > 0, -(1 - bag) / bag, 1.0)  # d loss / d z = pull * p
        g = pull[doc] * p * scale
        grad = np.append(np.bincount(flat, weights=g[word], minlength=len(used)), g.sum())
        w = opt.step(w, grad + ridge * np.append(w[:-1], 0))
    weights[used[real]] = w[:-1][real]
    weights[-1] = w[-1]
    return weights


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 2000) -> np.ndarray:
    """Fit on a bounded sample: at most ``max_toxic`` and ``max_clean`` different
    labelled (doc_id, text), the first by a hash of doc_id, with their whole texts.
    The driver gets at most a count for each slot and label, then the words with a
    screened slot."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("_r"), F.xxhash64("text").alias("_t"), text_bytes().alias("_raw"))
    keyed = rows.select("_r", "doc_id", "_t").join(known, "doc_id").select("_r", "doc_id", "_t", "_y")
    drawn = [first_by_hash(keyed.where(F.col("_y") == y), n) for y, n in ((1, max_toxic), (0, max_clean))]
    drawn = materialise(drawn[0].unionByName(drawn[1]), "drawn")  # at most max_toxic + max_clean rows: a bounded broadcast
    keys = ["_r", "doc_id", "_t"]
    texts = rows.join(F.broadcast(drawn), keys).groupBy(*keys, "_y").agg(F.first("_raw").alias("_raw"))
    texts = materialise(texts, "bags")

    def bags_of(data: np.ndarray, bounds: np.ndarray):
        slots, sent, doc, *_ = instances(data, bounds)
        owner = doc[sent] if len(sent) else sent
        cut = np.searchsorted(owner, np.arange(len(bounds)))
        return [(slots[a:b], sent[a:b] - (sent[a] if b > a else 0)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def present(data: np.ndarray, bounds: np.ndarray) -> dict:
        found = (np.unique(s) for s, _ in bags_of(data, bounds))
        return {"slots": [u[u >= 0].tolist() for u in found]}

    counts = map_text(texts, ["_y"], "slots array<int>", present).select("_y", F.explode("slots").alias("slot")).groupBy("_y", "slot").agg(F.count("*").alias("c"))
    counts = counts.toArrow()  # at most a row for each slot and label
    seen = np.zeros((2, 1 << BITS))
    seen[counts["_y"].to_numpy(), counts["slot"].to_numpy()] = counts["c"].to_numpy()
    per_label = {r[0]: r[1] for r in drawn.groupBy("_y").count().collect()}  # two rows
    useful = screen(seen, np.array([per_label.get(y, 0) for y in (0, 1)], float))

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        out = {"s": [], "k": [], "n": []}
        for s, k in bags_of(data, bounds):
            out["n"].append(int(k[-1]) + 1 if len(k) else 0)
            s = np.where((s >= 0) & useful[s], s, -1)
            some = (s >= 0).any(1)  # words without a screened slot add nothing
            out["s"].append(s[some].astype(np.int32).tobytes())
            out["k"].append(k[some].astype(np.int32).tobytes())
        return out

    got = map_text(texts, [*keys, "_y"], "s binary, k binary, n long", work).toArrow().sort_by([(c, "ascending") for c in keys])
    bags = [
        (np.frombuffer(s, np.int32).reshape(-1, 1 + len(PREFIXES)), np.frombuffer(k, np.int32), n, y)
        for s, k, n, y in zip(got["s"].to_pylist(), got["k"].to_pylist(), got["n"].to_pylist(), got["_y"].to_pylist(), strict=True)
    ]
    return train(bags)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], sentence_threshold: float = 0.5) -> DataFrame:
    """Score of every document, how many sentences offend, and the byte span
    and probability of the worst one (null without words)."""

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        n = len(bounds) - 1
        slots, sent, doc, start, end = instances(data, bounds)
        p = sigmoid(sentence_logits(slots, sent, len(doc), weights)) if len(doc) else np.zeros(0)
        total = noisy_or(np.log1p(-np.minimum(p, 1 - 1e-9)), doc, n) if len(doc) else np.zeros(n)
        bad = np.bincount(doc[p >= sentence_threshold], minlength=n) if len(doc) else np.zeros(n, np.int64)
        order = np.lexsort((start, -p, doc))
        first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))] if len(doc) else order
        worst = np.full(n, -1)
        worst[doc[first]] = first
        pick = lambda a: [None if k < 0 else a[k].item() for k in worst]
        base = bounds[:-1]
        return {
            "score": np.clip(total, 0, 1),
            "n_sentences_hit": bad.astype(np.int64),
            "worst_start": [None if k < 0 else int(start[k] - base[d]) for d, k in enumerate(worst)],
            "worst_end": [None if k < 0 else int(end[k] - base[d]) for d, k in enumerate(worst)],
            "worst_score": pick(p),
        }

    schema = "score double, n_sentences_hit long, worst_start long, worst_end long, worst_score double"
    return map_text(docs.select(*keep, text_bytes().alias("_raw")), keep, schema, work)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(stable_split("doc_id", 3) != 1)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7), then the location
    of the worst sentence. Empty or null text scores 0. Repeated rows each get a
    row; without labels of both kinds only the untrained bias speaks. An empty table
    gives no rows, a text of any length is read whole, other columns are not read."""
    got = score(docs, fit(docs, learnable(labels)), ["doc_id"])
    return got.select(
        "doc_id",
        (stable_split("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_sentences_hit",
        "worst_start",
        "worst_end",
        "worst_score",
    )
