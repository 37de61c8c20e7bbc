"""Quality classifier by positive-unlabelled learning.

A linear model over text statistics is fitted by minimising the non-negative
unbiased risk: trusted positives against unlabelled web text, with a class
prior estimated from the same two samples. Negative labels are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, NONSPACE, Words, first_by_hash, free_name, map_text, stable_split, text_bytes

#: Byte classes of the bigram statistics (fixed values); other bytes fall in class 0.
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
    bytes(range(128, 256)), b".", b",", b"'\"", b"!", b"?", b":;", b"-", b"_", b"()[]{}", b"|", b"#", b"$", b"%",
    b"&", b"*", b"+=", b"<>", b"/\\", b"@", b"~^`",
]
N_CLASS = len(CLASSES) + 1
N_FEATURES = N_CLASS * N_CLASS + 6

_CLASS_OF = np.zeros(256, np.int32)
for _i, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c)] = _i + 1


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """float32 matrix, one row for each text: root frequencies of byte-class
    bigrams and shares of repeated words and lines. An empty text gives zeros."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    grams = 0
    # in pieces that overlap by a byte: a very long text takes no more memory than a chunk
    for a in range(0, len(data), CHUNK):
        b = min(len(data), a + CHUNK + 1)
        at = np.searchsorted(bounds, [a, b - 1], "right") - 1
        inside = np.clip(bounds[at[0] : at[1] + 2], a, b)
        doc = np.repeat(np.arange(at[0], at[1] + 1, dtype=np.int32), np.diff(inside))
        cls = _CLASS_OF[data[a:b]]
        key = ((doc[1:] * N_CLASS + cls[1:]) * N_CLASS + cls[:-1])[doc[1:] == doc[:-1]]
        grams = np.bincount(key, minlength=n * N_CLASS * N_CLASS) + grams
    out = np.zeros((n, N_FEATURES), np.float32)
    if len(data):
        out[:, : N_CLASS * N_CLASS] = np.sqrt(grams.reshape(n, -1) / np.maximum(1, size - 1)[:, None])
    extra = out[:, N_CLASS * N_CLASS :]

    w = Words(data, bounds, NONSPACE)
    h = w.hashes()
    count = np.maximum(1, w.per_doc)
    for k, gap in enumerate((1, 2)):
        if len(h) > gap:
            hit = (h[gap:] == h[:-gap]) & (w.doc[gap:] == w.doc[:-gap])
            extra[:, k] = np.bincount(w.doc[gap:][hit], minlength=n) / count
    extra[:, 2] = np.bincount(w.doc, weights=w.ends - w.starts, minlength=n) / count / 10
    extra[:, 3] = np.minimum(1, np.log1p(w.per_doc) / 10)

    lines = Words(data, bounds, ~(np.arange(256) == 10))
    lh = lines.hashes()
    if len(lh):
        order = np.lexsort((lh, lines.doc))
        d, v = lines.doc[order], lh[order]
        again = np.zeros(len(v), bool)
        again[1:] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        extra[:, 4] = np.bincount(d[again], minlength=n) / np.maximum(1, lines.per_doc)
    extra[:, 5] = size == 0
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n, np.float32), np.zeros(n, np.float32), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        return w - np.float32(self.rate * fix) * self.m / (np.sqrt(self.v) + np.float32(1e-8))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, rounds: int = 150) -> float:
    """Class prior by best-bin estimation: a positive-against-unlabelled
    classifier fitted on one half ranks the other half; the prior is the least
    ratio of unlabelled to positive share above a threshold, with slack."""
    (pa, pb), (ua, ub) = (pos[::2], pos[1::2]), (unl[::2], unl[1::2])
    if min(len(pa), len(pb), len(ua), len(ub)) < 20:
        return 0.5
    w, opt = np.zeros(pos.shape[1], np.float32), _Adam(pos.shape[1], 0.05)
    for _ in range(rounds):
        g = -((1 - sigmoid(pa @ w)) @ pa) / len(pa) + sigmoid(ua @ w) @ ua / len(ua)
        w = opt.step(w, g + 1e-3 * w)
    sp, su = np.sort(pb @ w), np.sort(ub @ w)
    cuts = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    qp = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    qu = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.95))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights minimising prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)) under
    logistic loss. When the bracket turns negative the step goes against it."""
    w, opt = np.zeros(pos.shape[1], np.float32), _Adam(pos.shape[1], 0.05)
    for _ in range(rounds):
        zp, zu = pos @ w, unl @ w
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        g_pos = -prior * ((1 - sigmoid(zp)) @ pos) / len(pos)
        g_neg = sigmoid(zu) @ unl / len(unl) - prior * (sigmoid(zp) @ pos) / len(pos)
        w = opt.step(w, (g_pos + g_neg if negative >= 0 else -g_neg) + ridge * w)
    return w


def _matrix(docs: DataFrame, most: int, seed: int) -> np.ndarray:
    """Features of at most ``most`` different (doc_id, text) of ``docs``, the first by
    a hash of the doc_id, in that order whatever the layout of the table."""

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        return {"x": [r.tobytes() for r in features(data, bounds)]}

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("_r"), F.xxhash64("text").alias("_t"), text_bytes().alias("_raw"))
    drawn = first_by_hash(rows.select("_r", "doc_id", "_t"), most)
    picked = rows.join(F.broadcast(drawn), ["_r", "doc_id", "_t"])  # at most ``most`` rows
    # rows that repeat both fold into one before they leave their task
    got = map_text(picked, ["_r", "doc_id", "_t"], "x binary", work).groupBy("_r", "doc_id", "_t").agg(F.first("x").alias("x"))
    got = got.toArrow().sort_by([("_r", "ascending"), ("doc_id", "ascending"), ("_t", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def fit(docs: DataFrame, positives: DataFrame, max_positives: int = 3000, max_unlabelled: int = 6000) -> dict:
    """Fit on bounded samples: at most ``max_positives`` trusted positives
    (``positives`` has their doc_id) and ``max_unlabelled`` texts of ``docs``,
    both the first by a hash of doc_id. Null ids are not drawn, rows that repeat a
    doc_id and its text count once."""
    texts = docs.select("doc_id", "text")
    p = _matrix(texts.join(positives.select("doc_id").distinct(), "doc_id", "left_semi"), max_positives, 17)
    u = _matrix(texts, max_unlabelled, 29)
    if len(p) == 0 or len(u) == 0:
        return {"weights": np.zeros(N_FEATURES + 1), "prior": 0.5}
    prior = estimate_prior(p, u)
    return {"weights": fit_nnpu(p, u, prior).astype(float), "prior": prior}


def score(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns of every document and its score in [0, 1]."""
    w = model["weights"]

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        return {name: sigmoid(features(data, bounds) @ w[:-1] + w[-1])}

    return map_text(docs.select(*keep, text_bytes().alias("_raw")), keep, f"`{name}` double", work)


def trusted_positives(labels: DataFrame) -> DataFrame:
    """Ids marked good among the rows that may be learnt from."""
    return labels.where((F.col("quality") == 1) & (stable_split("doc_id", 3) != 1)).select("doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Null or empty text is scored like any other (all statistics zero). Repeated
    rows each get a row. Without trusted positives every score is 0.5. An empty table
    gives no rows, a text of any length is read whole, other columns are not read.
    """
    got = score(docs, fit(docs, trusted_positives(labels)), ["doc_id"])
    return got.select(
        "doc_id",
        (stable_split("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns."""
    model = fit(docs, trusted_positives(labels))
    name, raw = free_name(docs, "_score"), free_name(docs, "_raw")
    kept = list(docs.columns)
    w = model["weights"]

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        return {name: sigmoid(features(data, bounds) @ w[:-1] + w[-1])}

    return map_text(docs.withColumn(raw, text_bytes()), kept, f"`{name}` double", work, raw).where(F.col(f"`{name}`") >= threshold).select(*(F.col(f"`{c}`") for c in kept))
