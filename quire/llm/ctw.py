"""Operator 8: language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision is predicted from the bytes before
it. At every depth of context a Krichevsky-Trofimov estimator counts, and the
mixture of all depths weighs each by how well it has coded the training text. The
trained tree is frozen, so the probability of a byte after a context is one number,
and a text's score is a sum of table look-ups.

Counts of DEPTH + 1 bytes in a row, over every training text, are summed up in
Spark; all shorter contexts follow from them. Every context that the texts have is a
node, however rare. Contexts that agree in their last two bytes lie in one part, and
parts are weighed apart from each other on the executors; only the sums over their
roots, at most 256 times 255 rows, go to the driver, which weighs the two shortest
depths. The tree is a written table of a number for each node and place of the byte's
binary tree that has counts, and of one for each run of bytes that has been seen. It
goes out to the workers in shards of whole parts, of about SHARD rows each; each
shard scores the bytes whose contexts lie in it, and a text's sums are added up. So the
tree grows with the corpus, and with it the number of passes, not what a worker holds.

The base score needs the counts of all words. Those that make up 1 / COMMON_WORDS
of the training tokens or more, of which there can't be more than COMMON_WORDS, go
out to the workers; the rare ones are joined with the documents that have them.

Texts are lower-cased in A-Z; a byte that UTF-8 doesn't know ends them, and stands
before their beginning.

Cases: a null text counts as empty, which has one token, the end; very long texts
are scored whole, in pieces that see the bytes before them; repeated rows are
learned from and scored each; without training rows every bit has probability one
half and every word the same; columns that aren't kept stay out; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, cut

DEPTH = 4
#: Rows of the tree's table that a worker holds at once, about.
SHARD = 1 << 22
COMMON_WORDS = 1 << 20
END = 255
#: Bytes whose contexts are looked at together, and entries a worker sums up before it passes them on.
SPAN = 1 << 20
HELD = 1 << 21
HELD_WORDS = 300_000


def _joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each with DEPTH end bytes before it and one after it; places of each text's first byte."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(pad + pad.join(t + bytes([END]) for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1 + DEPTH
    return data, np.concatenate([[0], np.cumsum(sizes)[:-1]]) + DEPTH


def _groups(texts: Sequence[bytes]):
    """Runs of texts of about SPAN bytes."""
    run: list[bytes] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= SPAN:
            yield run
            run, size = [], 0
    if run:
        yield run


def grams(texts: Sequence[bytes]) -> np.ndarray:
    """Every byte of the texts and their ends, with the DEPTH bytes before, as one number."""
    data, starts = _joined(texts)
    wide = data.astype(np.int64)
    n = len(data) - DEPTH
    key = np.zeros(n, np.int64)
    for j in range(DEPTH + 1):
        key = key << 8 | wide[j : j + n]
    real = np.ones(n, bool)
    for j in range(DEPTH):  # the end bytes before a text aren't predicted, but for the one that ends the text before
        real[starts[1:] - DEPTH - 1 - j] = False
    return key[real]


#: Contexts that agree in their last UPPER bytes lie in one part; shorter ones belong to all.
UPPER = 2
PARTS = 1 << 8 * UPPER
#: A key is a depth, a context and a place; at GRAM, a context and the byte after it.
GRAM = DEPTH + 1
LOG10 = np.log(10)


def _part(context: np.ndarray | Column) -> np.ndarray | Column:
    """The last bytes of a context, scrambled."""
    return (context % PARTS) * 40503 % PARTS


def _key(depth: int, context: np.ndarray | int, place: np.ndarray | int) -> np.ndarray | int:
    return depth << 8 * (DEPTH + 1) | context << 8 | place


class Shard:
    """Numbers by key, sorted: log odds of a one at a node's place, and log10 of the probability of a byte."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        at = np.searchsorted(keys, _key(GRAM, 0, 0))
        self.keys, self.odds = keys[:at], values[:at]
        self.grams, self.logp = keys[at:] - _key(GRAM, 0, 0), values[at:]
        self.slots = np.full(1 << max(1, 2 * len(self.grams) - 1).bit_length(), -1, np.int32)
        left = np.arange(len(self.grams), dtype=np.int32)
        at = self._slot(self.grams)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) % len(self.slots)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) % len(self.slots)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        at = self._slot(gram)
        found = self.slots[at]
        open_ = np.flatnonzero(found >= 0)
        open_ = open_[self.grams[found[open_]] != gram[open_]]
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            found[open_] = self.slots[at[open_]]
            open_ = open_[found[open_] >= 0]
            open_ = open_[self.grams[found[open_]] != gram[open_]]
        out = np.zeros(len(gram))
        seen = found >= 0
        out[seen] = self.logp[found[seen]]
        if not seen.all():
            new, to = np.unique(gram[~seen], return_inverse=True)
            out[~seen] = self._unseen(new)[to]
        return out

    def _unseen(self, gram: np.ndarray) -> np.ndarray:
        """Bit by bit: each from the longest context that has counts at its place; one half if none has."""
        total = np.zeros(len(gram))
        for k in range(8):
            odds = np.zeros(len(gram))
            left = np.arange(len(gram) if len(self.keys) else 0)
            for d in range(DEPTH, -1, -1):
                key = _key(d, gram[left] >> 8 & (1 << 8 * d) - 1, 1 << k | (gram[left] & 255) >> 8 - k)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                has = self.keys[at] == key
                odds[left[has]] = self.odds[at[has]]
                left = left[~has]
            total -= np.logaddexp(0, np.where(gram >> 7 - k & 1, -odds, odds)) / LOG10
        return total

    def score(self, texts: Sequence[bytes], at: int = 0, of: int = 1) -> np.ndarray:
        """log10 probability of each text and its end, summed over the bytes whose contexts are in shard `at` of so many."""
        out = []
        for run in _groups(texts):
            data, starts = _joined(run)
            n = len(data)
            total = np.zeros(n)
            real = np.ones(n, bool)
            for j in range(1, DEPTH + 1):
                real[starts - j] = False
            for lo in range(DEPTH, n, SPAN):
                hi = min(lo + SPAN, n)
                gram = np.zeros(hi - lo, np.int64)
                for j in range(DEPTH, -1, -1):
                    gram = gram << 8 | data[lo - j : hi - j]
                own = np.flatnonzero(real[lo:hi] & (_part(gram >> 8) % of == at))
                total[lo + own] = self.log10(gram[own])
            out.append(np.add.reduceat(total, starts))
        return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Tree:
    cells: DataFrame  # part (-1: of all), key, value: written

    @property
    def shards(self) -> int:
        return max(1, -(-self.cells.count() // SHARD))

    def shard(self, at: int, of: int) -> Shard:
        own = self.cells.filter((F.col("part") < 0) | (F.col("part") % of == at)).select("key", "value").toArrow()
        keys, values = (own.column(c).to_numpy() for c in ("key", "value"))
        order = np.argsort(keys)
        return Shard(keys[order], values[order])

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        of = self.shards
        return sum(self.shard(at, of).score(texts, at, of) for at in range(of))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series above 8, the recurrence below."""
    low = x < 8
    y = np.where(low, x + 8, x)
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if low.any():
        z = x[low]
        s[low] -= sum(np.log(z + k) for k in range(8))
    return s


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


def _levels(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, depths: Sequence[int]) -> list[tuple]:
    """Of cells (context << 8 | place), for each depth from the deepest: key, the place in it of each one before, zeros, ones."""
    out = []
    for d in depths:
        key, to = np.unique((key >> 8 & (1 << 8 * d) - 1) << 8 | key & 255, return_inverse=True)
        zeros, ones = np.bincount(to, zeros, len(key)), np.bincount(to, ones, len(key))
        out.append((key, to, zeros, ones))
    return out


def _weighed(levels: list[tuple], below: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level log of its weighted probability, and the share of its own estimator in that. below: of what the first level is made of; none for leaves."""
    out = []
    for key, to, zeros, ones in levels:
        own = _log_kt(zeros, ones)
        if below is None:
            out.append((own, np.ones(len(key))))
        else:
            weighted = np.log(0.5) + np.logaddexp(own, np.bincount(to, below, len(key)))
            out.append((weighted, np.exp(np.log(0.5) + own - weighted)))
        below = out[-1][0]
    return out


def _down(levels: list[tuple], weighed: list[tuple[np.ndarray, np.ndarray]], so_far: np.ndarray, left: np.ndarray):
    """From the shallowest: the level's number from the deepest, the probability that shallower estimators and its own add up to, and what is left for deeper ones.

    so_far, left: what the shallowest level's parents have, for each of its cells.
    """
    for i in range(len(levels) - 1, -1, -1):
        _, _, zeros, ones = levels[i]
        stop = weighed[i][1]
        so_far = so_far + left * stop * (ones + 0.5) / (zeros + ones + 1)
        left = left * (1 - stop)
        yield i, so_far, left
        if i:
            up = levels[i][1]  # the parent of each deeper cell
            so_far, left = so_far[up], left[up]


def _one(so_far: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Probability of a one where no deeper context has counts."""
    return np.clip(so_far + left * 0.5, 1e-300, 1 - 1e-16)


def _lower_levels(gram: np.ndarray, n: np.ndarray, k: int) -> list[tuple]:
    """The levels from DEPTH to UPPER, at the byte's bit k."""
    one = gram >> 7 - k & 1
    return _levels(gram >> 8 << 8 | 1 << k | (gram & 255) >> 8 - k, n * (1 - one), n * one, range(DEPTH, UPPER - 1, -1))


def _weigh(grams_: DataFrame) -> DataFrame:
    """part, key and value of the whole tree, from the counts of grams (gram, n): written."""
    parted = grams_.select("gram", "n", _part(F.shiftright("gram", 8)).alias("part")).repartition("part").select("gram", "n")

    def whole(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 2

    def roots(batches):
        import pyarrow as pa

        gram, n = whole(batches)
        for k in range(8):
            levels = _lower_levels(gram, n, k)
            key, _, zeros, ones = levels[-1]
            above, to = np.unique((key >> 8 & (1 << 8 * (UPPER - 1)) - 1) << 8 | key & 255, return_inverse=True)
            sums = [np.bincount(to, x, len(above)) for x in (_weighed(levels)[-1][0], zeros, ones)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (above, *sums)], names=["key", "below", "zeros", "ones"])

    top = parted.mapInArrow(roots, "key long, below double, zeros double, ones double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("below", "zeros", "ones"))).toArrow()
    key, below, zeros, ones = (top.column(c).to_numpy() for c in ("key", "below", "zeros", "ones"))
    levels = _levels(key, zeros, ones, range(UPPER - 1, -1, -1))
    weighed = _weighed(levels, below)
    of_all, last = [], None
    for i, so_far, left in _down(levels, weighed, np.zeros(len(levels[-1][0])), np.ones(len(levels[-1][0]))):
        p = _one(so_far, left)
        of_all += zip((_key(UPPER - 1 - i, 0, 0) | levels[i][0]).tolist(), (np.log(p) - np.log1p(-p)).tolist(), strict=True)
        last = levels[i][0], so_far, left
    spark = grams_.sparkSession
    shared = spark.sparkContext.broadcast(last)

    def cells(batches):
        import pyarrow as pa

        gram, n = whole(batches)
        above, so_far_above, left_above = shared.value

        def batches_of(key, value, context):
            for lo in range(0, len(key), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(_part(context[part]).astype(np.int32)), pa.array(key[part]), pa.array(value[part].astype(np.float32))], names=["part", "key", "value"])

        logp = np.zeros(len(gram))
        for k in range(8):
            levels = _lower_levels(gram, n, k)
            key = levels[-1][0]
            at = np.searchsorted(above, (key >> 8 & (1 << 8 * (UPPER - 1)) - 1) << 8 | key & 255)
            for i, so_far, left in _down(levels, _weighed(levels), so_far_above[at], left_above[at]):
                p = _one(so_far, left)
                yield from batches_of(_key(DEPTH - i, 0, 0) | levels[i][0], np.log(p) - np.log1p(-p), levels[i][0] >> 8)
            p = p[levels[0][1]]
            logp += np.log10(np.where(gram >> 7 - k & 1, p, 1 - p))
        yield from batches_of(_key(GRAM, 0, 0) | gram, logp, gram >> 8)

    upper = spark.createDataFrame([(-1, k, v) for k, v in of_all], "part int, key long, value float")
    return cut(parted.mapInArrow(cells, "part int, key long, value float").unionByName(upper))


def _lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word (empty: the end) or gram, and n, over all rows of df: written, so that it is computed once."""
    bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("word", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def some(words_: Counter):
            texts = pa.array([w.decode() for w in words_], pa.string())
            return pa.RecordBatch.from_arrays([texts, pa.nulls(len(words_), pa.int64()), pa.array(list(words_.values()), pa.int64())], schema=schema)

        def of_grams(keys, n):
            for lo in range(0, len(keys), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys[part]), pa.string()), pa.array(keys[part]), pa.array(n[part])], schema=schema)

        for batch in batches:
            texts = list(map(_lower, batch.column(0).to_pylist()))
            for t in texts:
                words.update(t.split())
            words[b""] += len(texts)
            if len(words) > HELD_WORDS:
                yield some(words)
                words = Counter()
            for run_ in _groups(texts):
                key, n = np.unique(grams(run_), return_counts=True)
                held.append((key, n))
                size += len(key)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from of_grams(*held[0])
                        held, size = [], 0
        if words:
            yield some(words)
        if held:
            yield from of_grams(*merged())

    found = df.select(df[text_col].alias("text")).mapInArrow(run, "word string, gram long, n long")
    return cut(found.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def train(df: DataFrame, text_col: str = "text") -> tuple[Tree, DataFrame]:
    """The tree, and the words' counts (word, n; the empty word is the end)."""
    counts = count(df, text_col)
    tree = Tree(_weigh(counts.filter("gram is not null").select("gram", "n")))
    return tree, counts.filter("word is not null").select("word", "n")


def _of_shard(rows: DataFrame, tree: Tree, at: int, of: int) -> DataFrame:
    """row and score of the bytes whose contexts are in that shard: written, so that the shard can go."""
    shared = rows.sparkSession.sparkContext.broadcast(tree.shard(at, of))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = list(map(_lower, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts, at, of))], names=["row", "score"])

    out = cut(rows.select("row", "text").mapInArrow(run, "row long, score double"))
    shared.unpersist()
    return out


def score(df: DataFrame, tree: Tree, words: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns with n_tokens, n_known, train_tokens, base_score, score and code_length (bits per byte)."""
    spark = df.sparkSession
    bounded_batches(spark)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    all_n, scale = total["n"], float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    common = {r["word"].encode(): (float(np.log10(r["n"] + 0.5)) - scale) for r in words.filter(F.col("n") * COMMON_WORDS >= max(all_n, 1)).toLocalIterator()}
    of = tree.shards
    shared = spark.sparkContext.broadcast((tree.shard(0, of), common))
    new = {"n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length"}
    kept = [c for c in keep if c.lower() not in new]
    inner = [f"k{i}" for i in range(len(kept))]
    schema = T.StructType(
        [T.StructField("row", T.LongType(), False)]
        + [T.StructField(i, df.schema[c].dataType) for i, c in zip(inner, kept, strict=True)]
        + [T.StructField("n_tokens", T.LongType(), False), T.StructField("n_common", T.LongType(), False), T.StructField("n_bytes", T.LongType(), False), T.StructField("base", T.DoubleType(), False), T.StructField("score", T.DoubleType(), False)]
        + [T.StructField("rare", T.ArrayType(T.StringType(), False), False), T.StructField("times", T.ArrayType(T.LongType(), False), False)]
    )

    def run(batches):
        import pyarrow as pa

        model, often = shared.value
        find = often.get
        to_arrow = {"n_tokens": pa.int64(), "n_common": pa.int64(), "n_bytes": pa.int64(), "base": pa.float64(), "score": pa.float64(), "rare": pa.list_(pa.string()), "times": pa.list_(pa.int64())}
        for batch in batches:
            texts = list(map(_lower, batch.column(batch.num_columns - 1).to_pylist()))
            n_tokens, n_common, base, rare, times = [], [], [], [], []
            for t in texts:
                tokens = [*t.split(), b""]
                values = list(map(find, tokens))
                unseen = Counter(w for w, v in zip(tokens, values, strict=True) if v is None) if None in values else {}
                if unseen:
                    values = [v for v in values if v is not None]
                n_tokens.append(len(tokens))
                n_common.append(len(values))
                base.append(sum(values))
                rare.append([w.decode() for w in unseen])
                times.append(list(unseen.values()))
            made = [n_tokens, n_common, list(map(len, texts)), base, model.score(texts, 0, of), rare, times]
            cols = [pa.array(x, k) for x, k in zip(made, to_arrow.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=schema.names)

    rows = df.select(F.monotonically_increasing_id().alias("row"), *(df[c].alias(i) for c, i in zip(kept, inner, strict=True)), df[text_col].alias("text"))
    if of > 1:
        rows = cut(rows)  # written: a row's number stays
    scored = cut(rows.mapInArrow(run, schema))  # so it does here
    if of > 1:
        others = _of_shard(rows, tree, 1, of)
        for at in range(2, of):
            others = others.unionByName(_of_shard(rows, tree, at, of))
        sums = others.groupBy("row").agg(F.sum("score").alias("others"))
        scored = cut(scored.join(sums, "row").withColumn("score", F.col("score") + F.col("others")).drop("others"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("word"), F.col("e.times").alias("times"))
    found = rare.join(words.filter(F.col("n") * COMMON_WORDS < max(all_n, 1)), "word", "left")
    one = (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - scale) * F.col("times")
    sums = found.groupBy("row").agg(F.sum(one).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = scored.drop("rare", "times").join(sums, "row", "left")
    return out.select(
        *(F.col(i).alias(c) for i, c in zip(inner, kept, strict=True)),
        "n_tokens",
        (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(all_n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("code_length"),
    )
