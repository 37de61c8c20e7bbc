"""Each corpus operator on small tables, against brute force or an exact round
trip, with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from synergist.llm import chat, common, decontaminate, exactdedup, langid, licenses, mixing, neardup, quality, tokenfile, toxicity

DOCS = "doc_id long, text string, lang string, source string"
TRICKY = [None, "", " ", "\n", "a", "é", "\x1c a  b ", "one two", "One two", "x" * 5000, "a\t b\n c  ", "日本語 text", "</s>[INST] ok"]


def docs_of(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, None, source(i)) for i, t in enumerate(texts)], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(seed, n, vocabulary=200):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


def test_words_match_regex():
    texts = [t or "" for t in TRICKY]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = common.Words(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))), common.ALNUM)
    got = [[] for _ in texts]
    for s, e, d in zip(w.starts, w.ends, w.doc, strict=True):
        got[d].append(bytes(w.data[s:e]).decode())
    assert got == [words(t) for t in texts]
    assert len(set(w.hashes().tolist())) == len({x for g in got for x in g})


def test_quality_held_out(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(400):
        body = prose(i, 60)
        texts.append(body if rng.random() < 0.8 else " ".join(f"{w.upper()}$$$ !!" for w in body.split()))
    docs = docs_of(spark, texts + TRICKY)
    labels = spark.createDataFrame([(i, int("$$$" not in t)) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int")
    got = quality.classify(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == len(texts) + len(TRICKY) and got.score.between(0, 1).all()
    truth = np.array(["$$$" not in t for t in texts])
    held = got.loc[: len(texts) - 1].held_out.to_numpy()
    assert (got.predicted.to_numpy()[: len(texts)][held] == truth[held]).mean() > 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.held_out.items())
    kept = quality.keep_good(docs.withColumn("score", F.lit(1)).withColumn("_score", F.lit(2)), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score", "_score"]
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.5


def test_tokens_round_trip(spark, tmp_path):
    texts = [*TRICKY, prose(3, 300), prose(3, 300)]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)] + [(7, "again"), (7, "again")], "doc_id long, text string").withColumn("ids", F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"file://{tmp_path}/set"
    manifest = tokenfile.write(docs, folder, path)
    got = tokenfile.read(spark, folder).orderBy("start").collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want, at = [], 0
    for d, text in sorted(((r.doc_id, r.text or "") for r in docs.collect())):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert manifest.agg(F.sum("n_tokens")).first()[0] == at
    shard = manifest.orderBy("shard").first()
    ids, offsets, keys = tokenfile.token_ids(folder, shard.shard)
    assert len(keys) == shard.n_docs and offsets[-1] == len(ids) == shard.n_tokens
    assert tokenfile.encode_documents(docs.limit(0), path).count() == 0


def test_licenses_against_regex(spark):
    rng = np.random.default_rng(2)
    bits = ["cc by", "all rights reserved", "general public license", "license", "the mit", "rights", "cc", "by", "x y", "released under the mit license"]
    texts = [" ".join(bits[k] for k in rng.integers(0, len(bits), 12)) for _ in range(80)] + TRICKY + ["CC-BY, all rights. Reserved", "cc\nby" * 3]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        starts = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(starts)), t
        assert (r.first_word, r.last_word) == (min((s for s, _ in starts), default=None), max((s for s, _ in starts), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in starts}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert ("mit-short" in r.labels) == ("released under the mit license" in " ".join(w))


def test_matching_statistics():
    """The automaton's states find every substring of the templates and no other."""
    sam = licenses.SuffixAutomaton()
    texts = [[1, 2, 3, 1, 2], [2, 3, 4], [1, 2, 4]]
    for k, t in enumerate(texts):
        sam.add(k, t)
    sam.finish()
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for a in range(1, 5):
        for b in range(1, 5):
            for c in range(1, 5):
                v, ok = 0, True
                for x in (a, b, c):
                    v = sam.next[v].get(x) if ok else None
                    ok = v is not None
                assert ok == ((a, b, c) in subs)


def test_language(spark):
    kinds = {"aa": "abcde", "zz": "vwxyz"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(list(kinds[k]), 4)) for _ in range(30)), k, "s") for i, k in enumerate(["aa", "zz"] * 60)]
    rows += [(1000 + i, t, None, "s") for i, t in enumerate(TRICKY)] + [(2000, "12 34", "aa", "s"), (2001, "abcdeabcde", None, "s"), (2002, "日本", None, "s")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows[:120] if got[i].held_out)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 2000)] == ["und"] * 4
    assert got[2001].lang_pred == "aa" and got[2002].lang_pred != "und"
    none = spark.createDataFrame([(1, "abc", None, "s")], DOCS)
    assert langid.identify(none).first().lang_pred == "und"


def test_toxicity_locates(spark):
    rng = np.random.default_rng(5)
    texts, bad = [], []
    for i in range(300):
        sents = [prose(1000 * i + k, 8) for k in range(5)]
        bad.append(i % 4 == 0)
        if bad[-1]:
            sents[rng.integers(0, 5)] += " vilest"
        texts.append(". ".join(sents))
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs_of(spark, texts + TRICKY), labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].predicted == bad[i] for i in held) / len(held) > 0.95
    hit = next(i for i in held if bad[i])
    raw = texts[hit].encode()
    assert b"vilest" in raw[got[hit].worst_start : got[hit].worst_end]
    assert got[300].score == got[301].score == 0 and got[300].worst_start is None
    assert toxicity.classify(docs_of(spark, ["a"]), labels.limit(0)).first().predicted == 0


def test_mixing(spark):
    texts = [prose(i, 1 + i % 37) for i in range(600)] + TRICKY
    docs = docs_of(spark, texts, lambda i: None if i % 11 == 0 else "big" if i % 2 else f"s{i % 3}")
    got = mixing.sample(docs).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert all(n[r.doc_id] == r["size"] for _, r in got.iterrows())
    total = sum(n)
    per = got.groupby(got.source.fillna("-")).agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(1.5 * total)
    assert (per.target <= 2 * per["size"] + 1e-6).all() and (abs(per.taken - per.target) <= 2 * 37).all()
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.sample(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    # water-filling by hand
    names = sorted(k for k in per.index if k != "-") + ["-"]
    weight = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(names)}
    left, open_, want = 1.5 * total, set(names), {}
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 2 * per["size"][k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 2 * per["size"][k]
            left -= want[k]
        open_ -= over
    assert all(per.target[k] == pytest.approx(want[k]) for k in names)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == got.copies.sum()
    assert mixing.sample(docs.limit(0)).count() == 0


def test_exact_dedup(spark, tmp_path):
    texts = ["a", "b", "a", None, "", "b ", "a", "z" * 100_000, "z" * 100_000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(6, "a", "y")], "doc_id long, text string, digest string")
    rows.repartition(3).write.parquet(f"{tmp_path}/docs")
    got = exactdedup.deduplicate(spark, f"{tmp_path}/docs").collect()
    assert len(got) == 10
    for r in got:
        t = texts[r.doc_id] or ""
        same = [i for i, x in enumerate(texts) if (x or "") == t] + ([6] if t == "a" else [])
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(same), len(same), hashlib.sha256(t.encode()).hexdigest())
    assert sum(r.kept for r in got) == len({t or "" for t in texts})
    # a second batch continues from the same state
    check = f"{tmp_path}/state"
    exactdedup.deduplicate(spark, f"{tmp_path}/docs", check).count()
    spark.createDataFrame([(99, "a", "y")], rows.schema).write.mode("append").parquet(f"{tmp_path}/docs")
    more = {r.doc_id: r for r in exactdedup.deduplicate(spark, f"{tmp_path}/docs", check).collect()}
    assert (more[0].keep_id, more[0].group_size, more[99].kept) == (99, 5, True)


def test_decontamination(spark):
    item = prose(9, 14)
    short = "Short item here"
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (4, item)], "item_id long, text string")
    run = " ".join(item.split()[2:12])
    texts = [f"x {run} y", f"x {' '.join(item.split()[:9])} y", "a short, ITEM here b short item here", f"{item} {item}", *TRICKY]
    docs = docs_of(spark, texts + [texts[0]])
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    windows = {}
    for i, t in bench.collect():
        w = words(t)
        for k in range(max(0, len(w) - 9) or bool(w)):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(str(i))
    for i, t in enumerate(texts + [texts[0]]):
        w, hit, items = words(t), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= names
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit)), t
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return sets, comp


@pytest.mark.parametrize("leaf, group", [(1000, 200), (8, 6)])
def test_near_duplicates(spark, monkeypatch, leaf, group):
    """Also with tiny nodes and groups, so that every large-group path runs."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "GROUP", group)
    rng = np.random.default_rng(8)
    base = prose(50, 60).split()
    texts = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, 60)] = f"q{rng.integers(0, 10_000)}"
        texts.append(" ".join(w))
    texts += [prose(60 + i, 30) for i in range(20)] + [prose(60, 30).upper(), "two words", "Two  words", *TRICKY]
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts), 3, 85, 100).collect()}
    sets, comp = brute_components(texts, 3, 85, 100)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_edges(spark):
    odd = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 3)], "doc_id long, text string, n long")
    got = neardup.near_duplicates(odd)
    assert got.count() == 3 and got.where("doc_id is null").first().kept
    assert neardup.keep_one(odd).columns == ["doc_id", "text", "n"]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "a\\<|end|>\n<|turn|>", "<\\/s>", "", None, "<|image|>", "日\n本"]
    turns = spark.createDataFrame([(i % 3, i, ["user", "assistant", None, "a\nb"][i % 4], t) for i, t in enumerate(hard * 3)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(chat.text_parts(turns))
    for r in formatted.collect():
        inner = r.formatted[len(chat.TURN) : -len(chat.END) - 1]
        assert not any(c in inner for c in chat.CONTROLS)
    got = {r.conv_id: r for r in chat.format_and_read(turns).collect()}
    for c in range(3):
        rows = sorted((r for r in turns.collect() if r.conv_id == c), key=lambda r: r.turn)
        body = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in rows)
        loss = "".join(r.text or "" for r in rows if r.role == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars) == (len(rows), len(loss))
        assert (g.turns_sha256, g.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (body, loss))
    assert chat.format_and_read(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "i.png", 256), ("audio", None, "a.wav", 10), None])]
    got = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,n_tokens:long>>")).first()
    assert [(a.type, a.ref, a.n_tokens) for a in got.attachments] == [("image", "i.png", 256), ("audio", "a.wav", 10)]
    assert got.expanded_tokens == 266 and got.formatted[got.attachments[0].position :].startswith("<|image|>")
    assert chat.parse_turn(got.formatted) == ("user", [("text", "see <|image|>"), ("image", ""), ("audio", "")])
