"""Term and phrase statistics against plain Python, with digests so narrow that they
collide."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from synergist.llm import collocations, divergence

SCHEMA = "doc_id long, text string, lang string, source string"
BITS = pytest.mark.parametrize("bits", [64, 5])


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed, n=120, vocabulary=40):
    rng = np.random.default_rng(seed)
    words = [f"{'É' if k % 7 == 0 else ''}w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(vocabulary)] + ["A", "über", "日本", "x\x1cy"]
    weight = 1 / np.arange(1, len(words) + 1)
    seps = np.array([" ", "  ", "\t", ", ", ".\n", " 7 ", "-"])
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 60))
        picks = rng.choice(len(words), k, p=weight / weight.sum())
        text = "".join(words[p] + str(rng.choice(seps, p=[0.7, 0.05, 0.05, 0.1, 0.04, 0.03, 0.03])) for p in picks)
        rows.append((i % 100, text, [None, "en", "de", ""][i % 4], [None, "s1", "s2", "ü", ""][i % 5]))
    rows += [(1, None, "en", "s1"), (None, "", None, None), (2, "...", "fr", "only"), (3, " \t\n", "fr", "other"), (4, "wa wb " * 3000, "en", "s1"), (4, "wa wb " * 3000, "en", "s1")]
    return rows


def audit_by_hand(rows, min_docs, top):
    groups, df, n = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= min_docs]
        mine = sorted(s for x, s in groups if x == lang)
        table = {s: n[lang, s] for s in mine}
        every = sum(table.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(table[s]) for s in mine}, shares(every)
        for s in mine:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted(((p[s][t] - q[t], t) for t in kept if table[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(terms[:top])]
    return sorted(out)


@BITS
def test_audit(spark, bits, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 2)  # blocks of two sources
    rows = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"n": F.lit(1), "d": F.lit("x")})
    got = divergence.audit(docs, 8, 5, bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, 8, 5)


def test_audit_without_terms(spark):
    docs = spark.createDataFrame([(1, None, None, "a"), (2, "7 8", None, "b"), (3, "x", "en", None)], SCHEMA)
    got = sorted(map(tuple, divergence.audit(docs, 30).collect()))
    assert got == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
    assert divergence.audit(docs.limit(0)).count() == 0


def mine_by_hand(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * found[p[i : i + m]]}
        rest = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rest.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@BITS
def test_phrases(spark, bits):
    rows = corpus(2, 160, 12)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"fp": F.lit(1), "f": F.lit("x"), "_key": F.lit(0)})
    got = collocations.mine(docs, 10, 60, bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mine_by_hand(rows, 10, 60)
    assert collocations.mine(docs.limit(0)).count() == 0
