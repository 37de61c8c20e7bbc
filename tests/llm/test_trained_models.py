"""The trained operators against plain Python on small tables, and their samples."""

import math
import random

import numpy as np

from synergist.llm import chat, langid, quality, toxicity
from synergist.llm.common import LANES


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def test_risk_goes_down_the_gradient_of_its_formula():
    rng = np.random.default_rng(0)
    # overlapping samples: the bracket stays positive, so that the minimum is where the gradient ends
    pos, unl, prior = rng.normal(0.6, 1, (300, 3)), rng.normal(0, 1, (400, 3)), 0.2
    pos[:, -1] = unl[:, -1] = 1

    def risk(w):  # non-negative unbiased risk under logistic loss, term by term
        loss = lambda z: math.log1p(math.exp(-z))
        z = lambda x: sum(a * b for a, b in zip(x, w, strict=True))
        on_pos = sum(loss(z(x)) for x in pos) / len(pos)
        neg = sum(loss(-z(x)) for x in unl) / len(unl) - prior * sum(loss(-z(x)) for x in pos) / len(pos)
        return prior * on_pos + max(0.0, neg)

    w = quality.fit_nnpu(pos.astype(np.float32), unl.astype(np.float32), prior, rounds=2000, ridge=0.0)
    here = risk(w)
    for k in range(3):
        for step in (-0.05, 0.05):
            other = np.array(w, float)
            other[k] += step
            assert risk(other) >= here - 1e-3
    assert here < risk([0.0, 0.0, 0.0])


def test_features_of_one_text_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "".join(rng.choice("ab C.9\n$") for _ in range(500)), "", "xy z" * 40]
    data, bounds = chunk(texts)
    whole = quality.features(data, bounds)
    monkeypatch.setattr(quality, "CHUNK", 37)
    assert np.array_equal(quality.features(data, bounds), whole)
    for i, t in enumerate(texts):
        grams = {}
        for a, b in zip(t.encode(), t.encode()[1:]):
            key = int(quality._CLASS_OF[b]) * quality.N_CLASS + int(quality._CLASS_OF[a])
            grams[key] = grams.get(key, 0) + 1
        want = np.zeros(quality.N_CLASS**2)
        for k, n in grams.items():
            want[k] = math.sqrt(n / (len(t) - 1))
        assert np.allclose(whole[i, : quality.N_CLASS**2], want)


def test_samples_are_of_rows_and_do_not_depend_on_the_layout(spark):
    rows = [(i % 7, f"text {i} of {i % 13}") for i in range(300)] + [(3, "again and again")] * 50 + [(None, "x"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = quality._matrix(docs.coalesce(1), 20, 17)
    b = quality._matrix(docs.repartition(7), 20, 17)
    assert len(a) == 20 and np.array_equal(a, b)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(3, 1)], "doc_id long, toxic int")
    one = toxicity.fit(docs.coalesce(1), labels, 10, 10)
    assert np.array_equal(one, toxicity.fit(docs.repartition(7), labels, 10, 10))


def test_noisy_or_by_hand():
    texts = ["bad thing. fine here! bad bad", "", "nothing else", "bad"]
    data, bounds = chunk(texts)
    rng = np.random.default_rng(2)
    weights = rng.normal(0, 2, (1 << toxicity.BITS) + 2)
    weights[-2] = 0.0
    slots, sent, doc, start, end = toxicity.instances(data, bounds)
    p = 1 / (1 + np.exp(-toxicity.sentence_logits(slots, sent, len(doc), weights)))
    got = toxicity.noisy_or(np.log1p(-p), doc, len(texts))
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["bad thing", "fine here", "bad bad", "nothing else", "bad"]
    logit = {}
    for s, k in zip(slots, sent, strict=True):
        logit[k] = logit.get(k, weights[-1]) + sum(weights[x] if x >= 0 else 0.0 for x in s)
    for d in range(len(texts)):
        miss = 1.0
        for k, z in logit.items():
            if doc[k] == d:
                miss *= 1 - 1 / (1 + math.exp(-z))
        assert got[d] == float(np.float64(1 - miss)) or abs(got[d] - (1 - miss)) < 1e-12


def test_backoff_by_hand(spark):
    train = [("abba abba acca", "xx"), ("abba zaza zizi zaza", "yy"), ("acca acca", "xx"), ("zizi zaza", "yy")]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train * 2)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model["languages"] == ["xx", "yy"]
    counts = {n: {} for n in (0, *langid.ORDERS)}
    for t, g in train * 2:
        for w in t.split():
            for n in counts:
                for gram in [w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)]:
                    counts[n].setdefault(gram, {"xx": 0, "yy": 0})[g] += 1
    for n in counts:
        counts[n] = {k: {g: c for g, c in v.items()} for k, v in counts[n].items()}

    def log_freq(n, gram, g):
        kept = {k: {x: (c if c >= 2 else 0) for x, c in v.items()} for k, v in counts[n].items()}
        if not any(kept.get(gram, {}).values()):
            return None
        total = sum(v[g] for v in kept.values())
        return math.log((kept[gram][g] + 0.1) / max(1, total))

    def score(word, g):  # the word, else the mean over its known grams of the longest known length
        if (x := log_freq(0, word, g)) is not None:
            return x
        for n in langid.ORDERS:
            known = [x for i in range(len(word) - n + 1) if (x := log_freq(n, word[i : i + n], g)) is not None]
            if known:
                return sum(known) / len(known)
        return 0.0

    texts = ["abba zaza", "abbaz", "zizz ccab q", "qqq"]
    got, _ = langid.scores(*chunk(texts), model)
    for i, t in enumerate(texts):
        want = [sum(score(w, g) for w in t.split()) for g in ("xx", "yy")]
        assert np.allclose(got[i], want, atol=1e-4), (t, got[i], want)


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word other", f"l{i % 5}") for i in range(23)], "doc_id long, text string, lang string")
    assert langid.fit(docs, max_languages=3)["languages"] == ["l0", "l1", "l2"]


def test_part_splits_read_back():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice([*chat.CONTROLS, "\\", "<", "|>", "[", "a", "\n"]) for _ in range(rng.randint(0, 4)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 5)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        image_at = rng.choice([None, *range(len(pieces) + 1)])
        v = chat.PartVisitor("assistant", True)
        want = []
        for k, p in enumerate([*pieces, ""]):
            if k == image_at:
                v.visit({"type": "image", "ref": "r", "n_tokens": 1})
                want.append(("image", ""))
            v.visit({"type": rng.choice(["text", "unheard of"]), "text": p})
            if want and want[-1][0] == "text":
                want[-1] = ("text", want[-1][1] + p)
            elif p:
                want.append(("text", p))
        done = v.done()
        assert chat.parse_turn(done) == ("assistant", want), pieces
        inner = done[len(chat.TURN) : -len(chat.END) - 1]
        assert sum(inner.count(c) for c in chat.CONTROLS) == (image_at is not None)
        assert "".join(chat.unescape(done[s["start"] : s["end"]]) for s in v.loss) == text


def test_long_words_and_texts():
    data, bounds = chunk(["w" * (3 * LANES), "w" * (3 * LANES) + " x", "x " * 200_000])
    assert np.isfinite(quality.features(data, bounds)).all()
