"""Operator 10: near-duplicate documents by ProbMinHash.

A text's shingles are its runs of five words, weighted by how often it has them. A
shingle's weight is the rate of a Poisson process whose arrivals are dealt to the
components of a signature at random; a component keeps the shingle that arrived
first. Arrivals are made shingle by shingle in rounds, and a shingle stops as soon
as its next arrival comes after the last component's, so a signature costs little
more than one arrival for each shingle. Two texts agree in a component with a
probability that is their probability Jaccard similarity.

Rows of the signature are banded; a text that repeats shingles has the bands of the
signature of its plain set too, so that texts whose sets are alike meet, however
often each has them. Texts that share a band's value are candidates,
and candidates are verified on their whole texts: a link is a pair whose Jaccard or
probability Jaccard similarity of shingles is at least the threshold.

Equal texts are one node. A bucket's texts are not paired with each other: first
each is verified with the likeliest of its buckets' centres, by their signatures, and
the links' components found; then the texts outside their bucket's main component are
verified with every text of the bucket that is in another component, bucket by bucket
in Python, so that only links come out of it; not again if an earlier band has both.
Pairs within a component can't change the classes and are never made.

Cases: a null text counts as empty; texts without words are alike only when they are
equal; texts of one to four words have one shingle, all their words; texts of any
length are whole; a null doc_id counts as the largest; repeated rows are members
each; columns other than doc_id and text play no part; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .pretokens import MEMO, MEMO_CHARS
from .shared import bounded_batches, clean, cut, hot_keys, spread_join

WORDS = 5
SIMILARITY = 0.8
BANDS = 22
ROWS = 5
#: Centres whose signatures agree in a share this far below the threshold aren't tried first.
MARGIN = 0.14
#: Centres that a text is verified with before components are found.
CENTRES = 3
#: Texts of a block, and shingles, about: large buckets are verified block by block.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Nodes that are broadcast to find their texts; more are joined by shuffling.
MAX_BROADCAST = 1_000_000
#: Characters of texts that are signed together.
SPAN = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted 64-bit numbers, and how often each occurs."""
    import xxhash

    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(memo) > MEMO:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    for w in [w for w in set(words) if len(w) > MEMO_CHARS]:
        del memo[w]
    n = max(len(h) - WORDS + 1, 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(_mix(out), return_counts=True)


def signatures(sets: Sequence[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """A row of size shingles for each set; zeros for an empty one."""
    sig = np.zeros(len(sets) * size, np.uint64)
    first = np.full(len(sets) * size, np.inf)
    lengths = np.array([len(s) for s, _ in sets], np.int64)
    if not lengths.sum():
        return sig.reshape(len(sets), size)
    owner = np.repeat(np.arange(len(sets)), lengths)
    e = np.concatenate([s for s, _ in sets])
    rate = np.concatenate([n for _, n in sets]).astype(float)
    state = e.copy()
    time = np.zeros(len(e))
    while len(e):
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
        at = owner * size + (_mix(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        sig[at[won]] = e[won]
        last = first.reshape(len(sets), size).max(1)
        going = time < last[owner]
        owner, e, rate, state, time = owner[going], e[going], rate[going], state[going], time[going]
    return sig.reshape(len(sets), size)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard and probability Jaccard of two weighted sets, exactly; 0 where either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, both, ratio = x[order], y[order], both[order], ratio[order]
    # a common shingle i adds 1 / sum over j of max(x_j / x_i, y_j / y_i); which is larger depends on the ratio
    up_to = np.concatenate([[0], np.cumsum(y)])
    from_on = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    at = np.searchsorted(ratio, ratio[both], side="left")
    total = from_on[at] / x[both] + up_to[at] / y[both]
    return float(both.sum() / len(every)), float((1 / total).sum())


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row (a number for each row), doc_id, digest, sig (16 bits of each component), bands, more (bands of the plain set, where it differs), size (shingles): written."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("row", T.LongType(), False), docs.schema["doc_id"], T.StructField("digest", T.StringType(), False), T.StructField("sig", T.ArrayType(T.ShortType(), False), False), T.StructField("bands", T.ArrayType(T.LongType(), False), False), T.StructField("more", T.ArrayType(T.LongType(), False), False), T.StructField("size", T.LongType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast({})
    size = bands * rows

    def banded(own):
        key = np.zeros((len(own), bands), np.uint64)
        for j in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, j::rows])
        return key.view(np.int64)

    def run(batches):
        import hashlib

        import pyarrow as pa

        memo = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            digest, sig, values, more, sizes = [], [], [], [], []
            lo = 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and n < SPAN:
                    n += len(texts[hi] or "") + 1
                    hi += 1
                part = texts[lo:hi]
                digest += [hashlib.md5((t or "").encode(), usedforsecurity=False).hexdigest() for t in part]
                sets = [shingles(t, memo) for t in part]
                own = signatures(sets, size)
                key = banded(own)
                some = np.array([len(s) > 0 for s, _ in sets])
                short = (own & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
                again = [i for i, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
                plain = dict(zip(again, banded(signatures([(sets[i][0], np.ones(len(sets[i][0]), np.int64)) for i in again], size)), strict=True))
                more += [plain.get(i, key[i, :0]) for i in range(len(part))]
                sizes += [len(s) for s, _ in sets]
                sig += [s if x else s[:0] for s, x in zip(short, some, strict=True)]
                values += [k if x else k[:0] for k, x in zip(key, some, strict=True)]
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digest), pa.array(sig, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=schema.names)

    return cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema))


def _sets(texts: DataFrame) -> DataFrame:
    """node, its shingles, and how often it has each (empty: once), of node and text: written."""
    bounded_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast({})

    def run(batches):
        import pyarrow as pa

        memo = shared.value
        for batch in batches:
            sets = [shingles(t, memo) for t in batch.column(1).to_pylist()]
            times = [n if len(n) and n.max() > 1 else n[:0] for _, n in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s, _ in sets], pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names=["node", "set", "times"])

    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", longs, False), T.StructField("times", longs, False)])
    return cut(texts.select("node", "text").mapInArrow(run, schema))


def _arrays(column) -> list[np.ndarray]:
    """The rows of an Arrow column of lists."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def similar(one: tuple[np.ndarray, np.ndarray], others: Sequence[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Whether the Jaccard or the probability Jaccard similarity of a weighted set with each of the others reaches the threshold.

    Without repeats the two are equal. The latter is at most the sum of the lesser shares, as it is
    the probability that two draws agree; only where that reaches the threshold it is worked out.
    """
    threshold -= 1e-12
    out = np.zeros(len(others), bool)
    sizes = np.array([len(s) for s, _ in others])
    repeats = np.array([n.max(initial=1) > 1 for _, n in others]) | (one[1].max(initial=1) > 1)
    fits = (np.minimum(sizes, len(one[0])) >= threshold * np.maximum(sizes, len(one[0]))) | repeats
    todo = np.flatnonzero(fits & (sizes > 0)) if len(one[0]) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[todo[lo:]]), SPAN)) + lo)
        part = todo[lo:hi]
        lo = hi
        starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        flat = np.concatenate([others[i][0] for i in part])
        at = np.minimum(np.searchsorted(one[0], flat), len(one[0]) - 1)
        both = one[0][at] == flat
        common = np.add.reduceat(both.astype(np.int64), starts)
        out[part] = common >= threshold * (sizes[part] + len(one[0]) - common)
        if (repeats[part] & ~out[part]).any():
            share = np.concatenate([others[i][1] / others[i][1].sum() for i in part])
            bound = np.add.reduceat(np.where(both, np.minimum(share, (one[1] / one[1].sum())[at]), 0.0), starts)
            for i in part[repeats[part] & ~out[part] & (bound >= threshold)]:
                out[i] = similarity(one, others[i])[1] >= threshold
    return out


def _weights(sets: list[np.ndarray], times: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(s.view(np.uint64), n if len(n) else np.ones(len(s), np.int64)) for s, n in zip(sets, times, strict=True)]


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, of a, b, sa, ta, sb, tb: written."""
    bounded_batches(pairs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            one, two = (_weights(_arrays(batch.column(c)), _arrays(batch.column(c + 1))) for c in (2, 4))
            ok = [bool(similar(x, [y], threshold)[0]) for x, y in zip(one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return cut(pairs.select("a", "b", "sa", "ta", "sb", "tb").mapInArrow(run, "a long, b long"))


def _within(rows: list[tuple], i: int, j: int, threshold: float) -> list[tuple[int, int]]:
    """Links between a group's texts (node, label, block, weighted set, bands before, the plain set's bands before) of different labels."""
    label, block = (np.array([r[k] for r in rows]) for k in (1, 2))
    sets = [r[3] for r in rows]
    before = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    found = []
    for x in range(len(rows)):
        if block[x] != i:
            continue
        others = np.flatnonzero((block == j) & (label != label[x]))
        if i == j:
            others = others[others > x]
        met = np.zeros(len(others), bool)
        for p in before:
            for q in before:
                met |= (p[x] == q[others]).any(1)
        others = others[~met]
        if len(others):
            for y in others[similar(sets[x], [sets[y] for y in others], threshold)]:
                found.append((rows[x][0], rows[y][0]))
                label[label == label[y]] = label[x]
    return found


def _grouped(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of every group: written. rows: band, value, i, j, node, label, block, set, times, bands, more (the last two up to the band)."""
    bounded_batches(rows.sparkSession)
    keys = ["band", "value", "i", "j"]

    def run(batches):
        import pyarrow as pa

        now, held = None, []

        def made(found):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            plain = [batch.column(c).to_pylist() for c in range(7)]
            sets, times, bands, more = (_arrays(batch.column(c)) for c in range(7, 11))
            for *key, node, label, block, s, m, b in zip(*plain, _weights(sets, times), more, bands, strict=True):
                if key != now:
                    if len(held) > 1:
                        found += _within(held, *now[2:], threshold)
                    now, held = key, []
                held.append((node, label, block, s, b, m if len(m) else b))
            yield made(found)
        if len(held) > 1:
            yield made(_within(held, *now[2:], threshold))

    dealt = rows.select(*keys, "node", "label", "block", "set", "times", "bands", "more").repartition(*keys).sortWithinPartitions(*keys)
    return cut(dealt.mapInArrow(run, "a long, b long"))


def _agreement(a: str, b: str) -> F.Column:
    """How many components of two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(0)))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def _blocks(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """Texts of buckets with several components, once for each group: band, value, i, j (the group's blocks), node, label, block.

    A bucket that is too large for one block has blocks of what is outside its main
    component, which meet each other, and then blocks of the main component, which meet those.
    """
    most = lambda c: F.max_by(c, F.struct("n", "label"))
    whole = parts.groupBy("band", "value").agg(F.count(F.lit(1)).alias("labels"), most("label").alias("main"), F.sum("n").alias("n"), F.sum("size").alias("s"), most("n").alias("n_main"), most("size").alias("s_main")).filter("labels > 1")
    need = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    one = need(F.col("n"), F.col("s")) <= 1
    outer = F.when(one, 1).otherwise(need(F.col("n") - F.col("n_main"), F.col("s") - F.col("s_main")))
    inner = F.when(one, 0).otherwise(need(F.col("n_main"), F.col("s_main")))
    dealt = cut(whole.select("band", "value", "main", outer.alias("outer"), inner.alias("inner"), "n"))
    dealt = spread_join(placed, dealt.drop("n"), ["band", "value"], hot_keys(dealt, ["band", "value"]))
    by = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    is_main = (F.col("inner") > 0) & (F.col("label") == F.col("main"))
    dealt = dealt.withColumn("block", F.when(is_main, F.col("outer") + by(F.col("inner"))).otherwise(by(F.col("outer"))))
    last = F.when(is_main, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    met = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return dealt.withColumn("g", F.explode(met)).select("band", "value", "g.i", "g.j", "node", "label", "block")


def links(docs: DataFrame, nodes: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame | None:
    """Verified pairs (a, b) of nodes that decide the components; None where there is no candidate.

    nodes: node, digest, sig, bands, more, size, one row for each distinct text.
    """
    least = int(np.ceil((threshold - MARGIN) * bands * rows))
    every = nodes.select("node", "size", "bands", F.posexplode(F.concat("bands", "more")).alias("pos", "value"))
    every = every.filter((F.col("pos") < bands) | (F.col("value") != F.get("bands", F.col("pos") - bands)))
    every = every.select("node", "size", (F.col("pos") % bands).alias("band"), "value")
    buckets = every.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("n > 1")
    buckets = cut(buckets)
    members = cut(spread_join(every, buckets.drop("n"), ["band", "value"], hot_keys(buckets, ["band", "value"])))
    clean(buckets)
    if members.isEmpty():
        return None
    involved = cut(members.select("node").distinct().join(nodes.select("node", "digest", "sig"), "node"))
    sigs = involved.select("node", "sig")
    wanted = involved.select("node", "digest")
    few = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    found = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    sets = _sets(found.join(F.broadcast(wanted) if few else wanted, "digest").groupBy("node").agg(F.first("text").alias("text")))

    # each text with the likeliest centres of its buckets
    centred = members.select("node", F.explode(F.array("lo", "hi")).alias("centre")).filter("node <> centre").distinct()
    close = centred.join(sigs, "node").join(sigs.toDF("centre", "sig_c"), "centre").withColumn("same", _agreement("sig", "sig_c")).filter(F.col("same") >= least)
    best = close.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("same", "centre")), asc=False), 1, CENTRES).alias("best"))
    tried = best.select(F.col("node").alias("a"), F.explode("best.centre").alias("b")).join(sets.toDF("a", "sa", "ta"), "a").join(sets.toDF("b", "sb", "tb"), "b")
    first = _verified(tried, threshold)

    # what is outside its bucket's main component, with all that is elsewhere in the bucket
    label = components(first) if not first.isEmpty() else first.toDF("node", "label")
    placed = cut(members.select("band", "value", "node", "size").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    parts = placed.groupBy("band", "value", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = _blocks(placed, parts)
    text = nodes.select("node", "bands", "more").join(sets, "node")
    first_of = lambda c: F.slice(c, F.lit(1), F.col("band")).alias(c)
    rows = groups.join(text, "node").select("band", "value", "i", "j", "node", "label", "block", "set", "times", first_of("bands"), first_of("more"))
    second = _grouped(rows, threshold)
    clean(members, involved, sets, placed)
    return first.unionByName(second)


def classes(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, digest, class (a number), class_id (its least doc_id), class_size, kept (of each class, the row of the least doc_id)."""
    signed = sign(docs, bands, rows)
    nodes = cut(signed.groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("sig", "bands", "more", "size"))))
    found = links(docs, nodes, threshold, bands, rows)
    of_node = nodes.select("digest", "node")
    if found is not None and not found.isEmpty():
        of_node = cut(of_node.join(components(found), "node", "left").select("digest", F.coalesce("label", "node").alias("class")))
    else:
        of_node = of_node.withColumnRenamed("node", "class")
    slim = cut(spread_join(signed.select("row", "doc_id", "digest"), of_node, ["digest"], hot_keys(nodes, ["digest"])))
    clean(signed, nodes)
    # the least row of the least doc_id; a null one is the largest
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    least = slim.groupBy("class").agg(first.alias("f"), F.count(F.lit(1)).alias("class_size"))
    least = cut(least.select("class", F.col("f.doc_id").alias("class_id"), "class_size", F.col("f.row").alias("first")))
    out = spread_join(slim, least, ["class"], hot_keys(least, ["class"], "class_size"))
    return out.withColumn("kept", F.col("row") == F.col("first")).drop("first")


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, the one of the least doc_id, and all columns that docs has."""
    found = cut(classes(docs, threshold))
    keep = found.filter("kept").select("doc_id", "digest")
    times = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    keep = cut(keep.join(times.toDF("_i", "_d", "times"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d"))).select("doc_id", "digest", "times"))
    inner = [f"c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, inner, strict=True))
    own = docs.toDF(*inner)
    same = F.md5(F.coalesce(own[named["text"]], F.lit("")).cast("binary")) == keep["digest"]
    out = own.join(keep, same & own[named["doc_id"]].eqNullSafe(keep["doc_id"])).select(*inner, "times")
    if not keep.filter("times > 1").isEmpty():
        # rows that agree in doc_id and text are one document
        others = [F.first(c).alias(c) for c in inner if c not in (named["doc_id"], named["text"])]
        again = out.filter("times > 1").groupBy(named["doc_id"], named["text"]).agg(*others) if others else out.filter("times > 1").select(*inner).distinct()
        out = out.filter("times = 1").select(*inner).unionByName(again.select(*inner))
    return out.select(*inner).toDF(*docs.columns)
