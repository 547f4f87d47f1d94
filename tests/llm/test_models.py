"""Operators 3, 4, 7 and 8: brute-force statistics, held-out accuracy, code lengths."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from quire.llm import ctw, language_id, quality, queries, toxicity
from quire.llm.shared import agreed_labels, labelled_texts, within
from tests.conftest import SMALL

SF = SMALL.replace("0.001", "0.01")


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, odd, none):
    extra = spark.createDataFrame([(1, "a b c d e f a b c d e a b c d e x\na\n\na\n \n"), (2, "a a a a a a a"), (3, "é|<># b \x0b c")], "doc_id long, text string")
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd, extra):
        for r in quality.judge(df, []).select("text", *quality.STATISTICS, "base_failed", "kept").collect():
            want = statistics(r.text)
            assert tuple(r[1:6]) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(none, []).count() == 0
    assert quality.keep(odd, []).columns == odd.columns and quality.keep(none, []).count() == 0


def test_rules_are_learned(spark):
    rows = [({"a": i % 100, "b": i % 7}, i % 100 >= 90 and i % 7 < 3) for i in range(3_000)]
    rules = quality.learn(rows)
    bad = lambda r: any(all(c.holds(r) for c in rule) for rule in rules)
    assert rules and sum(bad(r) != y for r, y in rows) < 30
    assert quality.learn([]) == [] and quality.learn([({"a": 1}, False)] * 20) == []
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in queries.op7_quality_rules(spark, SF).collect()}
    kept_good = [got[d] for d, q in labels.items() if q == 1]
    kept_bad = [got[d] for d, q in labels.items() if q == 0]
    assert np.mean(kept_good) > 0.95 and np.mean(kept_bad) < 0.1


def test_toxicity_held_out(spark, odd, none):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, SF).collect()
    assert len(rows) == 1_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.9
    net = toxicity.train(odd, spark.createDataFrame([(1, 0), (7, None)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd, net, keep=("doc_id", "score")).collect()} == {0.0}
    assert toxicity.keep(odd, net).columns == odd.columns and toxicity.keep(odd, net).count() == odd.count()
    assert toxicity.keep(none, net).count() == 0


def test_contradictions_and_hot_ids(spark, monkeypatch):
    """Contradicting labels teach nothing; rows that share a doc_id are one row; whole rows within the bound are taken."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None), (4, "d d d"), (5, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (4, None, 2), (9, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    known = agreed_labels(labels, "toxic")
    assert {(r.doc_id, r.label) for r in known.collect()} == {(1, 1), (3, 0), (9, 1)}
    assert {(r.doc_id, r.label, r.text) for r in labelled_texts(docs, known, "text").collect()} == {(1, 1, "text 0"), (3, 0, "")}
    assert sorted((f["n_words"], bad) for f, bad in quality.labelled_rows(docs, labels)) == [(0, False), (2, True)]
    sizes = spark.createDataFrame([(i / 10, 10) for i in range(10)], "o double, n int")
    assert within(sizes, "o", "n", 100).count() == 10 and within(sizes, "o", "n", 39).count() == 3 and within(sizes, "o", "n", 5).count() == 0
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, truth, langs: seen.append((len(texts), sorted(truth))))
    toxicity.train(docs, labels)
    assert seen == [(2, [0, 1])]


def test_thresholds_have_rows_of_their_own(monkeypatch):
    used = {}
    monkeypatch.setattr(toxicity.Net, "train", lambda self, docs, truth: used.update(fit={d.tobytes() for d in docs}))
    monkeypatch.setattr(toxicity.Net, "calibrate", lambda self, docs, truth, langs: used.update(own={d.tobytes() for d in docs}))
    texts = [toxicity.word_hashes(" ".join(f"w{j}" for j in range(40) if i >> (j % 7) & 1 or j % 9 == i % 9), {}) for i in range(120)]
    toxicity.fit(texts, np.arange(120) % 2, ["en"] * 120)
    assert used["own"] and not used["own"] & used["fit"]


def test_toxicity_finds_words():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts, truth = [], []
    for i in range(400):
        own = list(rng.choice(words, 60))
        if i % 5 == 0:
            own[int(rng.integers(60))] = f"bad{i % 3}"
            own[int(rng.integers(60))] = f"bad{(i + 5) % 3}"
        texts.append(toxicity.word_hashes(" ".join(own), {}))
        truth.append(int(i % 5 == 0))
    net = toxicity.fit(texts[:300], np.array(truth[:300]), ["en"] * 300)
    found = [net.score(t) >= 0.5 for t in texts[300:]]
    assert np.mean([f == bool(y) for f, y in zip(found, truth[300:], strict=True)]) > 0.95
    assert net.score(toxicity.word_hashes(None, {})) < 0.5


def test_language_held_out(spark, odd, none):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    model = language_id.train(odd)
    out = language_id.predict(odd, model, keep=("text", "score")).collect()
    assert len(out) == odd.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    numerals = spark.createDataFrame([(i, t) for i, t in enumerate(["²", "½ ①", "Ⅷ Ⅻ", "_ 12 ٣", "Ⅷ a", "ª", "語"])], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.predict(numerals, model).orderBy("doc_id").collect()] == [True] * 4 + [False] * 3
    nothing = language_id.train(none)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def ctw_brute(texts, text):
    """Context-tree weighting bit by bit, straight from its recursion, with every context a node."""
    end = bytes([ctw.END])
    counts = [Counter() for _ in range(ctw.DEPTH + 1)]

    def bits(byte):
        place = 1
        for k in range(7, -1, -1):
            b = byte >> k & 1
            yield place, b
            place = place * 2 + b

    for t in texts:
        data = end * ctw.DEPTH + t + end
        for i in range(ctw.DEPTH, len(data)):
            for d in range(ctw.DEPTH + 1):
                for place, b in bits(data[i]):
                    counts[d][data[i - d : i], place, b] += 1
    kids = {}
    for d in range(1, ctw.DEPTH + 1):
        for c, _, _ in counts[d]:
            kids.setdefault(c[1:], set()).add(c)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pair(c, place):
        return counts[len(c)][c, place, 0], counts[len(c)][c, place, 1]

    memo = {}

    def weighted(c, place):
        if (c, place) not in memo:
            own = log_kt(*pair(c, place))
            if len(c) < ctw.DEPTH and kids.get(c):
                own = math.log(0.5) + np.logaddexp(own, sum(weighted(k, place) for k in kids[c]))
            memo[c, place] = own
        return memo[c, place]

    def predict(path, place, d=0):
        c = path[len(path) - d :] if d else b""
        a, b = pair(c, place)
        one = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH or not kids.get(c):
            return one
        stop = math.exp(math.log(0.5) + log_kt(a, b) - weighted(c, place))
        longer = path[len(path) - d - 1 :]
        return stop * one + (1 - stop) * (predict(path, place, d + 1) if longer in kids[c] else 0.5)

    data, total = end * ctw.DEPTH + text + end, 0.0
    for i in range(ctw.DEPTH, len(data)):
        for place, b in bits(data[i]):
            one = predict(data[i - ctw.DEPTH : i], place)
            total += math.log10(one if b else 1 - one)
    return total


def test_ctw_as_its_recursion(spark):
    texts = ["abracadabra", "Abrakadabra!", "", None, "the cat sat on the mat", "été à la mer"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tree, words = ctw.train(df)
    more = [*texts, "abra cat", "zzz", "Ж" * 5]
    rows = ctw.score(spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string"), tree, words).collect()
    for r in rows:
        want = ctw_brute([(t or "").encode().lower() for t in texts], (more[r.doc_id] or "").encode().lower())
        assert math.isclose(r.score, want, rel_tol=1e-5)


def test_ctw_keeps_rare_contexts(spark, monkeypatch):
    """A context that stands behind far less than 1 / 32768 of the bytes has a node, in one shard or in many."""
    texts = ["ab" * 40_000, "the quick brown fox", "Qu'est-ce que c'est ?"]
    tree, words = ctw.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    plain = [t.encode().lower() for t in texts]
    more = ["the quick brown fox", "abab", "the quiz", "Ж"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    want = [ctw_brute(plain, t.encode().lower()) for t in more]
    for shards in (1, 3):
        got = {r.doc_id: r.score for r in ctw.score(asked, tree, words).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in range(len(more)))
        assert tree.shards >= shards
        keys = {r.key for r in tree.cells.collect()}
        monkeypatch.setattr(ctw, "SHARD", len(keys) // 3)
    grams = set(ctw.grams(plain).tolist())
    for d in range(ctw.DEPTH + 1):
        assert {ctw._key(d, (g >> 8) & ((1 << 8 * d) - 1), 1) for g in grams} <= keys


def test_lm_query(spark):
    docs = {r.doc_id: (r.text or "").encode().lower() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter(w for d, t in docs.items() if not held[d] for w in [*t.split(), b""])
    n = sum(c.values())
    down = math.log10(n + 0.5 * (len(c) + 1))
    rows = queries.op8_lm_scores(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        tokens = [*docs[r.doc_id].split(), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10(c[w] + 0.5) - down for w in tokens), rel_tol=1e-9)
        assert r.score < 0
    assert np.mean([r.code_length for r in rows if r.held_out]) < 3.5


def test_lm_rare_words_and_pieces(spark, odd, none, monkeypatch):
    tree, words = ctw.train(odd)
    whole = {(r.doc_id, r.text): (r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in ctw.score(odd, tree, words, keep=("doc_id", "text", "score")).collect()}
    assert len(whole) == len({(r.doc_id, r.text) for r in odd.collect()})
    texts = [(r.text or "").encode().lower() for r in odd.collect()]
    at_once = tree.score(texts)
    monkeypatch.setattr(ctw, "SPAN", 1_000)
    assert np.allclose(tree.score(texts), at_once)
    monkeypatch.setattr(ctw, "COMMON_WORDS", 4)
    again = {(r.doc_id, r.text): (r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in ctw.score(odd, tree, words, keep=("doc_id", "text")).collect()}
    assert again == whole
    tree, words = ctw.train(none)
    assert ctw.score(none, tree, words).count() == 0
    r = ctw.score(odd, tree, words).filter("doc_id = 5").first()
    assert math.isclose(r.score, 16 * math.log10(0.5), rel_tol=1e-6) and r.train_tokens == 0
