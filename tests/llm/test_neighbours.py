"""Operators 9 and 10, and the pipeline's stages, against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import hamming_search, near_duplicates, queries, shared
from quire.llm.components import components
from tests.conftest import SMALL


def nearest(codes, query, k):
    return sorted((bin(c ^ query).count("1"), i) for i, c in codes if c is not None)[:k]


def code(v):
    return sum(1 << i for i, x in enumerate(v[:64]) if x is not None and x > 0)


def test_search_as_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 64))
    vectors = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=64) * (i % 3)]) for i in range(1_500)]
    vectors += [(2_000 + i, vectors[0][1]) for i in range(300)] + [(None, vectors[1][1]), (5_000, None), (5_050, [None, float("nan"), 1.0]), (5_100, []), (100, vectors[100][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, query string, rank int")
    got = defaultdict(list)
    for r in hamming_search.top_k(df, df.filter("vec_id % 50 = 0"), 10).collect():
        got[r.query_id].append((r.rank, r.distance, r.vec_id))
    big = float("inf")
    codes = [(big if i is None else i, None if v is None else code(v)) for i, v in vectors]
    asked = [(i, c) for i, c in codes if i != big and i % 50 == 0 and c is not None]
    assert set(got) == {i for i, _ in asked}
    for i, c in asked:
        want = nearest(codes, c, 10)
        assert sorted(set(got[i])) == [(n + 1, d, None if j == big else j) for n, (d, j) in enumerate(want)]
    assert hamming_search.top_k(df.limit(0), df).count() == 0 and hamming_search.top_k(df, df.limit(0)).count() == 0
    few = df.limit(3)
    assert hamming_search.top_k(few, few, 10).count() == 9


def test_search_refuses_longer_vectors(spark):
    """Vectors that differ beyond 64 dimensions only aren't at distance 0 from each other."""
    df = spark.createDataFrame([(i, [1.0] * 64 + [float(i)]) for i in range(2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="65 dimensions"):
        hamming_search.top_k(df, df).collect()


def test_search_ends_early(spark, monkeypatch):
    """A near neighbour is found after few probes; blocks of a value that many codes have lose nothing."""
    codes = np.random.default_rng(1).integers(0, 2**63, 20_000)
    codes[:3_000] = codes[:3_000] >> 40 << 40 | np.arange(3_000)  # the highest segments of many are alike
    codes[:3_000] |= codes[0] >> 40 << 40
    df = spark.createDataFrame([(int(c),) for c in codes], "code long").distinct()
    asked = [int(codes[7]) ^ 5, int(codes[9_000]) ^ 3]
    seen, met = [], hamming_search._met

    def watched(open_, radius, *more):
        found = met(open_, radius, *more)
        seen.append((radius, found.count()))
        return found

    monkeypatch.setattr(hamming_search, "_met", watched)
    for block in (1 << 16, 100):
        monkeypatch.setattr(hamming_search, "BLOCK", block)
        got = hamming_search.nearest_codes(df, spark.createDataFrame([(q,) for q in asked], "query long"), 1).collect()
        for q in asked:
            want = min(bin(q ^ int(c)).count("1") for c in codes)
            assert {(r.code, r.distance) for r in got if r.query == q} == {(int(c), want) for c in codes if bin(q ^ int(c)).count("1") == want}
    assert {r for r, _ in seen} == {0} and max(n for _, n in seen) < 10_000


@pytest.mark.parametrize("least", [1_000, 5])
def test_components(spark, monkeypatch, least):
    monkeypatch.setattr(shared, "LEAST_HOT", least)  # with 5, hubs and large components are hot
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + i) for i in range(1, 100)] + [(int(a), int(b)) for a, b in rng.integers(2_000, 2_300, (200, 2))] + [(1, 0), (5_000, 5_000)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_classes(rows):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        same = (rows[a][1] or "") == (rows[b][1] or "")
        if same or (sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[root(i)].append(r[0])
    return sorted(sorted(v, key=repr) for v in out.values())


def planted():
    """A base text and versions of it: some within reach, chains of small changes, and others too far away."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5_000)]
    rows = [(i, " ".join(rng.choice(words, 40 + i))) for i in range(60)]
    base = list(rng.choice(words, 150))
    for i in range(40):  # versions of one base, most pairs of which are below the threshold
        own = list(base)
        for at in rng.choice(150, i % 8, replace=False):
            own[at] = f"new{i}-{at}"
        rows.append((100 + i, " ".join(own)))
    chain = list(rng.choice(words, 120))
    for i in range(12):
        chain = list(chain)
        chain[i * 10] = f"step{i}"
        rows.append((200 + i, " ".join(chain)))
    rows += [(300 + i, rows[3][1]) for i in range(30)] + [(400, rows[3][1] + " "), (401, "a b"), (402, "a  b"), (403, "a c"), (404, ""), (405, None), (406, " "), (None, "a b"), (3, rows[3][1])]
    return rows


def test_near_duplicates_as_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = near_duplicates.classes(df).collect()
    out = defaultdict(list)
    for r in found:
        out[r["class"]].append(r)
    assert sorted(sorted((r.doc_id for r in v), key=repr) for v in out.values()) == brute_classes(rows)
    for v in out.values():
        assert sum(r.kept for r in v) == 1 and {r.class_size for r in v} == {len(v)}
        least = min((r.doc_id for r in v if r.doc_id is not None), default=None)
        assert {r.class_id for r in v} == {least} and next(r.doc_id for r in v if r.kept) == least
    one = near_duplicates.deduplicate(df.withColumn("digest", F.lit("x")).withColumn("times", F.lit(3)))
    assert one.columns == ["doc_id", "text", "digest", "times"] and one.count() == len(out)


def test_unequal_repeats_are_candidates(spark):
    """Sets that are 0.8 or more alike meet, though one text has a footer many times."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(20):
        words, footer = [f"{i}-{w}" for w in rng.integers(0, 10**9, 300)], [f"{i}f{k}" for k in range(12)]
        rows += [(2 * i, " ".join(words + footer)), (2 * i + 1, " ".join(words + footer * (60 + i)))]
    found = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id // 2 * 2 and r.class_size == 2 for r in found) and len(brute_classes(rows)) == 20


def test_weighted_links(spark):
    """A passage that stands six times, and own words at the end: 0.855 by weights, 0.5 by sets."""
    rng = np.random.default_rng(12)
    passage = " ".join([*map(str, rng.integers(0, 10**9, 40))] * 6)
    rows = [(i, " ".join([passage, *map(str, rng.integers(0, 10**9, 20))])) for i in range(6)] + [(9, " ".join(map(str, range(200))))]
    found = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in found} == {*((i, 0, 6) for i in range(6)), (9, 9, 1)}
    assert len(brute_classes(rows)) == 7  # by sets alone


def test_blocks_of_large_buckets(spark, monkeypatch):
    """Whatever the blocks are, every pair of different components meets in a group, and no task gets all."""
    monkeypatch.setattr(shared, "LEAST_HOT", 5)
    for size in (1_024, 3):
        monkeypatch.setattr(near_duplicates, "BLOCK", size)
        labels = [0] * 10 + [1] * 4 + [2, 3, 3, 4]
        placed = spark.createDataFrame([(7, 5, i, 1, x) for i, x in enumerate(labels)], "band int, value long, node long, size long, label long")
        parts = placed.groupBy("band", "value", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        groups = defaultdict(list)
        for r in near_duplicates._blocks(placed, parts).collect():
            groups[r.i, r.j].append(r)
        met = {frozenset((a.node, b.node)) for (i, j), v in groups.items() for a in v for b in v if (a.block, b.block) == (i, j) and a.label != b.label}
        assert met == {frozenset((a, b)) for a in range(18) for b in range(18) if labels[a] != labels[b]}
        assert (len(groups) > 1) == (size == 3)
    rows = planted()
    found = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    out = defaultdict(list)
    for r in found:
        out[r["class"]].append(r.doc_id)
    assert sorted(sorted(v, key=repr) for v in out.values()) == brute_classes(rows)


def every_link(texts):
    """Pairs of different texts whose Jaccard or probability Jaccard similarity of five-word shingles is 0.8 or more."""

    def counted(t):
        w = t.encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()

    own = [counted(t) for t in texts]
    having = defaultdict(list)
    for i, c in enumerate(own):
        for g in c:
            having[g].append(i)
    common = Counter(pair for v in having.values() for pair in combinations(v, 2))
    for (a, b), n in common.items():
        x, y = own[a], own[b]
        if n >= 0.8 * (len(x) + len(y) - n):
            yield a, b
        elif max(x.values()) > 1 or max(y.values()) > 1:
            nx, ny, both = sum(x.values()), sum(y.values()), x.keys() & y.keys()
            if sum(min(x[g] / nx, y[g] / ny) for g in both) >= 0.8:
                if sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in both) >= 0.8:
                    yield a, b


def test_link_recall(spark):
    """Of all links, found by counting, those whose ends are in one class: the corpus, and pairs just within reach whose lines repeat unequally."""
    df = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(21)
    rows = []
    for i in range(300):
        words = [f"{i}-{w}" for w in range(int(rng.integers(60, 300)))]
        other, line = list(words), [f"{i}f{k}" for k in range(12)]
        for k in range(max(1, len(words) // 60)):
            other[(k * 60 + i) % len(words)] = f"{i}new{k}"
        rows += [(10_000 + 2 * i + k, " ".join(w + line * int(rng.integers(0, 40) if i % 2 else 0))) for k, w in enumerate((words, other))]
    df = df.union(spark.createDataFrame(rows, df.schema))
    texts = sorted({r.text or "" for r in df.collect()})
    of = {r.text or "": r["class"] for r in df.join(near_duplicates.classes(df).select("doc_id", "class"), "doc_id").collect()}
    found = [of[texts[a]] == of[texts[b]] for a, b in every_link(texts)]
    assert len(found) > 200 and np.mean(found) >= 0.99


def test_exact_similarity_and_its_estimate():
    rng = np.random.default_rng(3)
    for _ in range(5):
        sets = []
        for _ in range(2):
            e = np.sort(rng.choice(60, 40, replace=False)).astype(np.uint64)
            sets.append((near_duplicates._mix(e), rng.integers(1, 6, 40)))
        sets = [(s[np.argsort(s)], n[np.argsort(s)]) for s, n in sets]
        x, y = (dict(zip(s.tolist(), n.tolist(), strict=True)) for s, n in sets)
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        plain, weighted = near_duplicates.similarity(*sets)
        assert plain == pytest.approx(len(x.keys() & y.keys()) / len(x.keys() | y.keys())) and weighted == pytest.approx(want)
        a, b = near_duplicates.signatures(sets, 8_000)
        assert abs((a == b).mean() - want) < 0.03


def test_odd_rows(spark, odd, none):
    assert near_duplicates.classes(odd).count() == odd.count()
    assert near_duplicates.deduplicate(odd).columns == odd.columns
    assert near_duplicates.classes(none).count() == 0 and near_duplicates.deduplicate(none).count() == 0
    assert queries.op10_near_duplicates(spark, SMALL).count() == 200


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.cut(stage(spark, docs, SMALL))
        if name != "bpe":
            assert after.columns == docs.columns
            assert all(seen[r.doc_id] == r.text for r in after.collect())
        else:
            assert after.count() == docs.count()
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after.collect()) == sorted(min(c) for c in brute_classes([(r.doc_id, r.text) for r in docs.collect()]))
        docs = after
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
    rows = odd
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.cut(stage(spark, rows, SMALL))
