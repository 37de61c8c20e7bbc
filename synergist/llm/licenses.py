"""Licence scan with a generalised suffix automaton of licence tokens.

Texts stream through the automaton and give matching statistics: at each word
the longest run ending there that occurs in some template, and all places where it
or a shorter one does. Long matches, each as long as it gets in its template, chain
in the order of both text and template into covered template spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import ALNUM, Words, hash_words, map_text, text_bytes
from .templates import TEMPLATES

#: Phrases and their labels (fixed values).
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: What a text must cover of a template: all of one of fewer than SHORT words, this
#: share of the longer ones.
SHORT, MIN_COVER = 12, 0.6


def words_of(text: str) -> list[str]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), ALNUM)
    return [bytes(w.data[a:b]).decode() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton over lists of token ids."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (text, end) of every place of the state's runs

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, text: int, tokens: list[int]) -> None:
        last = 0
        for at, c in enumerate(tokens):
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
            else:
                cur, p = self._state(self.len[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = cur
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
                last = cur
            self.ends[last].add((text, at + 1))

    def finish(self) -> None:
        """Carry the end positions up the suffix links."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[v]] |= self.ends[v]

    def locate(self, tokens: list[int]) -> int:
        v = 0
        for c in tokens:
            v = self.next[v][c]
        return v


class Scanner:
    """Templates compiled for scanning. Runs of ``min_match`` words are long
    matches; they chain over gaps of up to ``max_gap`` words in text
    and template, and the best chain labels the text where it covers enough of its
    template. A chain inside the span of another that covers more words, or as many and a
    larger share, doesn't count."""

    def __init__(self, phrases: dict[str, str] = BASE_PHRASES, templates: dict[str, str] = TEMPLATES, min_match: int = 3, max_gap: int = 8, min_cover: float = MIN_COVER, short: int = SHORT):
        self.phrases, self.min_match, self.max_gap, self.min_cover, self.short = phrases, min_match, max_gap, min_cover, short
        texts = {k: words_of(t) for k, t in {**{f"\0{p}": p for p in phrases}, **templates}.items()}
        words = sorted({w for t in texts.values() for w in t})
        ids = {w: i for i, w in enumerate(words)}
        h = hash_words(words)
        order = np.argsort(h)
        self.keys, self.ids = h[order], order
        self.labels = [k if k[0] != "\0" else None for k in texts]
        self.texts = [[ids[w] for w in t] for t in texts.values()]
        self.sizes = [len(t) for t in self.texts]
        sam = self.sam = SuffixAutomaton()
        for k, t in enumerate(self.texts):
            sam.add(k, t)
        sam.finish()
        at = {sam.locate([ids[w] for w in p.split()]): (len(p.split()), label) for p, label in phrases.items()}
        self.found = []  # of each state: phrases that end there, as (state is the phrase's own, words, label)
        for v in range(len(sam.len)):
            hits, u = [], v
            while u > 0:
                if u in at:
                    hits.append((u == v, *at[u]))
                u = sam.link[u]
            self.found.append(hits)
        self._stops: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Token id of each word, -1 outside the vocabulary."""
        i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[i] == hashes, self.ids[i], -1)

    def stops(self, state: int, c: int) -> list[tuple[int, int, int]]:
        """Places (words, template, end) that end at ``state`` and don't go on with token
        ``c``; 0 words are those of the match itself, others are shorter runs."""
        key = state, c
        if key not in self._stops:
            out, seen, u = [], set(), state
            while u > 0 and (u == state or self.sam.len[u] >= self.min_match):
                for t, end in self.sam.ends[u] - seen:
                    if self.labels[t] is not None and (end == self.sizes[t] or self.texts[t][end] != c):
                        out.append((0 if u == state else self.sam.len[u], t, end))
                seen |= self.sam.ends[u]
                u = self.sam.link[u]
            self._stops[key] = sorted(out)
        return self._stops[key]

    def scan(self, where: list[int], tokens: list[int]):
        """Positions (ascending) and tokens of one text's known words. Returns
        base places [(start, label)] and chains {label: (covered share, first, last word)}."""
        places, matches = self.matches(where, tokens)
        return places, self.chains(matches)

    def matches(self, where: list[int], tokens: list[int]):
        """Base places, and long matches (text start, words, template, template end)."""
        sam, found = self.sam, self.found
        nxt, link, length = sam.next, sam.link, sam.len
        state = matched = 0
        before, places, matches = -2, [], []

        def stop(c: int) -> None:
            for n, t, end in self.stops(state, c):
                n = n or matched
                if n >= self.min_match:
                    matches.append((before + 1 - n, n, t, end))

        for i, c in zip(where, tokens, strict=True):
            if i != before + 1:
                if matched >= self.min_match:
                    stop(-1)
                state = matched = 0
            elif matched >= self.min_match:
                stop(c)
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
                for own, n, label in found[state]:
                    if not own or matched >= n:
                        places.append((i + 1 - n, label))
            before = i
        if matched >= self.min_match:
            stop(-1)
        return places, matches

    def enough(self, template: int, covered: int) -> bool:
        size = self.sizes[template]
        return covered == size if size < self.short else covered >= self.min_cover * size

    def best_chains(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, int]]:
        """{template: (covered words, first word, end)} of each template's best chain.

        A match goes on from the chain before it, at most ``max_gap`` words away in text
        and template, with which it covers most words; what overlaps counts once. Only
        chains that end within the gap are looked at, so the work goes with the matches.
        """
        best: dict[int, tuple[int, int, int]] = {}
        near: dict[int, list[tuple[int, int, int, int]]] = {}  # template: (text end, template end, covered, first)
        for start, n, t, t_end in sorted(matches):
            open_ = near[t] = [c for c in near.get(t, ()) if c[0] >= start - self.max_gap]
            covered, first = n, start
            for end, o_end, o_covered, o_first in open_:
                add = min(n, start + n - end, t_end - o_end)
                if add > 0 and t_end - n - o_end <= self.max_gap:
                    covered, first = max((covered, first), (o_covered + add, o_first))
            open_.append((start + n, t_end, covered, first))
            if (covered, first) > best.get(t, (0, 0))[:2]:
                best[t] = covered, first, start + n
        return best

    def chains(self, matches: list[tuple[int, int, int, int]]) -> dict[str, tuple[float, int, int]]:
        """{label: (covered share, first, last word)} of the chains that count."""
        best = self.best_chains(matches)
        found = [((covered, covered / self.sizes[t]), first, end, t) for t, (covered, first, end) in best.items() if self.enough(t, covered)]
        out: dict[str, tuple[float, int, int]] = {}
        for weight, first, end, t in found:
            if not any(w > weight and f <= first and end <= e for w, f, e, _ in found):
                out[self.labels[t]] = weight[1], first, end - 1
        return out


def scan(docs: DataFrame, keep: list[str], scanner: Scanner | None = None) -> DataFrame:
    """Licence findings of every document.

    n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start, null without any), base_labels and labels
    (distinct, sorted, comma-joined; '' if none), score (largest covered share
    of a template, 1 with a base phrase) and spans, the covered template spans
    as ``label:first-last`` word positions. Null text has no words; repeated rows each
    get a row, an empty table gives none, a text of any length is read whole, and of
    other columns only ``keep`` are read.
    """
    scanner = scanner or Scanner()

    def work(data: np.ndarray, bounds: np.ndarray) -> dict:
        w = Words(data, bounds, ALNUM)
        ids = scanner.tokens(w.hashes()) if len(w.starts) else np.zeros(0, np.int64)
        known = np.flatnonzero(ids >= 0)
        cut = np.searchsorted(known, w.first)
        out: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for d in range(len(bounds) - 1):
            mine = known[cut[d] : cut[d + 1]]
            places, chains = scanner.scan((mine - w.first[d]).tolist(), ids[mine].tolist()) if len(mine) else ([], {})
            base = sorted({x for _, x in places})
            out["n_base"].append(len(places))
            out["first_word"].append(min((s for s, _ in places), default=None))
            out["last_word"].append(max((s for s, _ in places), default=None))
            out["base_labels"].append(",".join(base))
            out["labels"].append(",".join(sorted({*base, *chains})))
            out["score"].append(1.0 if places else max((c[0] for c in chains.values()), default=0.0))
            out["spans"].append(",".join(f"{k}:{a}-{b}" for k, (_, a, b) in sorted(chains.items())))
        return {"n_words": w.per_doc.astype(np.int64), **out}

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return map_text(docs.select(*keep, text_bytes().alias("_raw")), keep, schema, work)
