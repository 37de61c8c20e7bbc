"""Matches and chains against brute force, and plain prose that is no licence."""

import numpy as np
import pytest

from synergist.llm import licenses
from synergist.llm.templates import TEMPLATES

PROSE = [
    "The film was released under the title X in the spring",
    "this work is licensed under a private deal between the two houses",
    "the software is provided to any person who asks for it",
    "a copy of this letter was sent to the author of the book",
    "all the copies of the work were provided with the distribution of prizes",
    "You may not use this file as a chair",
    "permission to use the garden is hereby granted to all",
    "free of charge to any person",
    "the contract, tort or otherwise, was of no use",
]


def brute_matches(words, texts, least):
    """All runs of at least ``least`` words that occur in a template and get no longer."""
    out = set()
    for t, text in enumerate(texts):
        for i in range(len(words)):
            for j in range(len(text)):
                if i and j and words[i - 1] == text[j - 1]:
                    continue
                n = 0
                while i + n < len(words) and j + n < len(text) and words[i + n] == text[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, n, t, j + n))
    return out


def brute_best(matches, gap):
    """Most words that a chain of matches covers, by trying every predecessor."""
    best = {}
    rows = sorted(matches)
    covered = []
    for k, (start, n, t, t_end) in enumerate(rows):
        most = n
        for q, (s, m, u, u_end) in enumerate(rows[:k]):
            add = min(n, start + n - s - m, t_end - u_end)
            if u == t and add > 0 and start - s - m <= gap and t_end - n - u_end <= gap:
                most = max(most, covered[q] + add)
        covered.append(most)
        best[t] = max(best.get(t, 0), most)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_matches_and_chains_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    letters = "a b c d".split()[: rng.integers(2, 5)]
    draw = lambda n: [letters[k] for k in rng.integers(0, len(letters), n)]
    templates = {f"t{k}": draw(rng.integers(3, 14)) for k in range(3)}
    scanner = licenses.Scanner({}, {k: " ".join(v) for k, v in templates.items()}, min_match=2, max_gap=3)
    words = [w if rng.random() < 0.9 else "zz" for w in draw(40)]
    words[5:5] = templates["t0"]
    ids = {w: i for i, w in enumerate(sorted({w for t in templates.values() for w in t}))}
    known = [i for i, w in enumerate(words) if w in ids]
    _, got = scanner.matches(known, [ids[words[i]] for i in known])
    want = brute_matches(words, list(templates.values()), 2)
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
    best = scanner.best_chains(got)
    assert {t: c[0] for t, c in best.items()} == brute_best(want, 3)
    assert all(f >= 0 and e <= len(words) and c <= e - f for c, f, e in best.values())


def labels_of(spark, texts):
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, labels long, _raw long")
    return {r.doc_id: r for r in licenses.scan(rows, ["doc_id"]).collect()}


def test_templates_are_found_and_prose_is_not(spark):
    names = list(TEMPLATES)
    cut = [" ".join(licenses.words_of(TEMPLATES[k])) for k in names]
    edited = [" ".join(w if i % 29 else f"{w} Jane" for i, w in enumerate(c.split())) for c in cut if len(c.split()) > 60]
    long_names = [k for k, c in zip(names, cut, strict=True) if len(c.split()) > 60]
    got = labels_of(spark, [*TEMPLATES.values(), *PROSE, *(f"Once. {e} And so on." for e in edited), None, ""])
    for i, k in enumerate(names):
        mine = set(got[i].labels.split(",")) - set(got[i].base_labels.split(","))
        assert mine == {k}, (k, got[i])
        first, last = got[i].spans.split(":")[1].split("-")
        assert (int(first), int(last)) == (0, got[i].n_words - 1)
    for i in range(len(PROSE)):
        assert got[len(names) + i].labels == got[len(names) + i].base_labels, PROSE[i]
    for i, k in enumerate(long_names):
        r = got[len(names) + len(PROSE) + i]
        assert k in r.labels.split(",") and 0.6 <= r.score <= 1
    assert [(got[len(got) - d].n_words, got[len(got) - d].labels) for d in (1, 2)] == [(0, "")] * 2
