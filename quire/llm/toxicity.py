"""Operator 3: toxicity by a convolutional text classifier, trained in numpy.

Words are hashed; a hash that the training sample has often enough owns an
embedding, whose first number starts as the word's log odds there. Filters of one,
two and three words slide over a text's embeddings, each filter keeps its maximum,
and a logistic unit weighs the maxima. Stochastic gradient steps (Adagrad) train
all of it, on three quarters of the sample. The language is guessed from the words
alone; each language has the threshold that separates the calibration rows, the
fourth quarter, best, and scores are shifted so that the threshold becomes 0.5.

Training takes a sample of at most about MAX_TOXIC and MAX_CLEAN labelled rows, whole
ones, of at most MAX_WORDS words together (a hash of the id decides), so what comes
to the driver is bounded by that.

Cases: a null text counts as empty; a text without words gets the score of no
evidence; texts of any length are read whole; null labels and labels of no
document teach nothing, nor do labels of one document that contradict each other; of
rows that share a doc_id the least text teaches; with no labelled row, or of one class only, every score
is 0; repeated rows are scored each; a kept column whose name is that of an output
column gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import MEMO, MEMO_CHARS
from .shared import agreed_labels, bounded_batches, cut, labelled_texts, unit_hash, within

MAX_TOXIC = 1_500
MAX_CLEAN = 3_000
MAX_WORDS = 1 << 24
#: Hash values of words.
HASHES = 1 << 22
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Sampled documents that must have a word for it to own an embedding.
LEAST_DOCS = 3
#: Words that are convolved at once.
SPAN = 1 << 15
_WORDS = re.compile(r"\w+").findall


def word_hashes(text: str | None, memo: dict[str, int]) -> np.ndarray:
    """The hash of each lower-cased word."""
    words = _WORDS(text.lower()) if text else []
    if len(memo) > MEMO:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = zlib.crc32(w.encode()) % HASHES
    out = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
    for w in [w for w in set(words) if len(w) > MEMO_CHARS]:
        del memo[w]
    return out


class Net:
    """Row 0 of the embeddings stands for every other word and for padding, and stays zero."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hashes = hashes  # sorted; row i + 1 belongs to hashes[i]
        self.e = np.zeros((len(hashes) + 1, DIMENSIONS), np.float32)
        self.e[1:, 0] = odds
        self.e[1:, 1:] = rng.normal(0, 0.02, (len(hashes), DIMENSIONS - 1))
        self.w = [rng.normal(0, 0.2, (k, DIMENSIONS, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.w:
            w[:, 0, :] += 0.5
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.c = np.float32(-1.0)
        self.languages: list[str] = []
        self.words_of = np.zeros((len(hashes) + 1, 0), np.float32)
        self.cutoffs = np.zeros(1)
        self.none = False

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.hashes, hashes)
        i[i == len(self.hashes)] = 0
        return np.where(self.hashes[i] == hashes, i + 1, 0) if len(self.hashes) else np.zeros(len(hashes), int)

    def pool(self, rows: np.ndarray):
        """Maximum and its place for each filter of each width."""
        most = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
        place = [np.zeros(FILTERS, int) for _ in WIDTHS]
        rows = np.concatenate([rows, np.zeros(max(WIDTHS) - 1, rows.dtype)]) if len(rows) else np.zeros(max(WIDTHS), int)
        for lo in range(0, len(rows) - max(WIDTHS) + 1, SPAN):
            x = self.e[rows[lo : lo + SPAN + max(WIDTHS) - 1]]
            for i, k in enumerate(WIDTHS):
                n = len(x) - k + 1
                y = x[:n] @ self.w[i][0]
                for j in range(1, k):
                    y += x[j : j + n] @ self.w[i][j]
                at = y.argmax(0)
                top = y[at, np.arange(FILTERS)]
                better = top > most[i]
                most[i] = np.where(better, top, most[i])
                place[i] = np.where(better, at + lo, place[i])
        return rows, most, place

    def logit(self, rows: np.ndarray) -> float:
        _, most, _ = self.pool(rows)
        return float(np.maximum(np.concatenate([m + b for m, b in zip(most, self.b, strict=True)]), 0) @ self.v + self.c)

    def language(self, rows: np.ndarray) -> int:
        """The guess, or the number of languages where no word speaks for any."""
        own = rows[rows > 0]
        return int(self.words_of[own].sum(0).argmax()) if len(own) and self.languages else len(self.languages)

    def score(self, hashes: np.ndarray) -> float:
        if self.none:
            return 0.0
        rows = self.rows(hashes)
        z = self.logit(rows) - self.cutoffs[self.language(rows)]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def train(self, docs: Sequence[np.ndarray], truth: np.ndarray, epochs: int = 4, rate: float = 0.05, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        sums = {k: np.full(np.shape(x), 1e-3, np.float32) for k, x in (("e", self.e), ("v", self.v), ("c", self.c))}
        sums |= {("w", i): np.full_like(w, 1e-3) for i, w in enumerate(self.w)} | {("b", i): np.full_like(b, 1e-3) for i, b in enumerate(self.b)}
        weight = np.where(truth == 1, 0.5 / max(truth.mean(), 1e-9), 0.5 / max(1 - truth.mean(), 1e-9))
        for _ in range(epochs):
            for d in rng.permutation(len(docs)):
                rows, most, place = self.pool(docs[d])
                h = np.concatenate([m + b for m, b in zip(most, self.b, strict=True)])
                a = np.maximum(h, 0)
                g = (1 / (1 + np.exp(-np.clip(float(a @ self.v + self.c), -30, 30))) - truth[d]) * weight[d]
                back = np.where(h > 0, g * self.v, 0).astype(np.float32)
                for i, k in enumerate(WIDTHS):
                    gi = back[i * FILTERS : (i + 1) * FILTERS]
                    for j in range(k):
                        r = rows[place[i] + j]
                        ge = gi[:, None] * self.w[i][j].T
                        gw = self.e[r].T * gi
                        sums["w", i][j] += gw * gw
                        self.w[i][j] -= rate * gw / np.sqrt(sums["w", i][j])
                        own = r > 0
                        np.add.at(sums["e"], r[own], ge[own] * ge[own])
                        np.add.at(self.e, r[own], -rate * ge[own] / np.sqrt(sums["e"][r[own]]))
                    sums["b", i] += gi * gi
                    self.b[i] -= rate * gi / np.sqrt(sums["b", i])
                gv = (g * a).astype(np.float32)
                sums["v"] += gv * gv
                self.v -= rate * gv / np.sqrt(sums["v"])
                sums["c"] += np.float32(g * g)
                self.c -= np.float32(rate * g / np.sqrt(sums["c"]))

    def calibrate(self, docs: Sequence[np.ndarray], truth: np.ndarray, langs: Sequence[str | None]) -> None:
        """Word log probabilities by language, then a cutoff of the logit by guessed language."""
        self.languages = sorted({x for x in langs if x is not None})
        counts = np.full((len(self.e), len(self.languages)), 0.1)
        for rows, lang in zip(docs, langs, strict=True):
            if lang is not None:
                np.add.at(counts[:, self.languages.index(lang)], np.unique(rows), 1)
        self.words_of = np.log(counts / counts.sum(0)).astype(np.float32)
        z = np.array([self.logit(d) for d in docs])
        guess = np.array([self.language(d) for d in docs])
        overall = _cutoff(z, truth)
        self.cutoffs = np.array([_cutoff(z[guess == k], truth[guess == k], overall) for k in range(len(self.languages))] + [overall])


def _cutoff(z: np.ndarray, truth: np.ndarray, default: float = 0.0) -> float:
    """Half way between the two logits whose gap gives the best F1; the widest such gap."""
    if not truth.any() or truth.all():
        return default
    order = np.argsort(-z, kind="stable")
    s, hits = z[order], np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + truth.sum())
    gap = np.append(s[:-1] - s[1:], 2.0)
    f1[gap <= 0] = -1
    best = max(range(len(s)), key=lambda i: (round(f1[i], 9), gap[i]))
    return float(s[best] - min(gap[best], 6.0) / 2)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = (MAX_CLEAN, MAX_TOXIC)) -> Net:
    """Learn from labels (doc_id, label) and the texts of docs that have them: pass training rows only."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = agreed_labels(labels, label_col)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = unit_hash("doc_id", F.lit("toxicity"))
    share = F.when(F.col("label") == 1, F.lit(most[1] / max(sizes.get(1, 0), most[1]))).otherwise(F.lit(most[0] / max(sizes.get(0, 0), most[0])))
    sample = cut(known.filter(order < share))
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    rows = labelled_texts(docs, sample, text_col, lang.alias("lang")).select("text", "lang", "label", order.alias("o"))
    schema = T.StructType([T.StructField("h", T.ArrayType(T.IntegerType(), False), False), T.StructField("lang", T.StringType()), T.StructField("label", T.IntegerType(), False), T.StructField("o", T.DoubleType(), False)])

    def scan(batches):
        import pyarrow as pa

        memo: dict[str, int] = {}
        for batch in batches:
            h = pa.array([word_hashes(t, memo) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([h, *batch.columns[1:]], names=schema.names)

    hashed = cut(rows.mapInArrow(scan, schema).withColumn("words", F.size("h")))
    found = sorted(within(hashed, "o", "words", MAX_WORDS).collect(), key=lambda r: (r["o"], len(r["h"])))
    texts, truth, langs = [np.array(r["h"], np.int32) for r in found], np.array([r["label"] for r in found], int), [r["lang"] for r in found]
    return fit(texts, truth, langs)


def fit(texts: Sequence[np.ndarray], truth: np.ndarray, langs: Sequence[str | None]) -> Net:
    first = {t.tobytes(): i for i, t in reversed(list(enumerate(texts)))}  # of equal texts, one
    texts, truth, langs = [texts[i] for i in sorted(first.values())], truth[sorted(first.values())], [langs[i] for i in sorted(first.values())]
    fitted = [i for i in range(len(texts)) if i % 4]
    own = [np.unique(texts[i]) for i in fitted]
    seen, docs = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int32), np.zeros(0, int))
    seen = seen[docs >= LEAST_DOCS]
    with_label = [np.zeros(len(seen)), np.zeros(len(seen))]
    for i, u in zip(fitted, own, strict=True):
        with_label[truth[i]][np.isin(seen, u, assume_unique=True)] += 1
    n1 = int(truth[fitted].sum()) if fitted else 0
    n0 = len(fitted) - n1
    odds = np.log((with_label[1] + 0.5) / (n1 + 1)) - np.log((with_label[0] + 0.5) / (n0 + 1))
    # a log odds counts as far as it exceeds its own error
    sure = np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / (with_label[1] + 0.5) + 1 / (with_label[0] + 0.5)), 0)
    net = Net(seen, np.clip(sure, -2, 4))
    net.none = not n0 or not n1
    if not net.none:
        rows = [net.rows(t) for t in texts]
        net.train([rows[i] for i in fitted], truth[fitted])
        own = [i for i in range(len(rows)) if i % 4 == 0]
        net.calibrate([rows[i] for i in own], truth[own], [langs[i] for i in own])
    return net


def score(df: DataFrame, net: Net, text_col: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """keep columns and the score."""
    spark = df.sparkSession
    bounded_batches(spark)
    kept = [c for c in keep if c.lower() != name]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.DoubleType(), False)])
    shared = spark.sparkContext.broadcast((net, {}))

    def run(batches):
        import pyarrow as pa

        own, memo = shared.value
        for batch in batches:
            found = pa.array([own.score(word_hashes(t, memo)) for t in batch.column(len(kept)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], names=schema.names)

    return df.select(*kept, df[text_col].alias("_text" if "_text" not in kept else "__text")).mapInArrow(run, schema)


def keep(docs: DataFrame, net: Net) -> DataFrame:
    """The documents whose score is below 0.5, with all columns that docs has."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    text = dict(zip(docs.columns, inner, strict=True))["text"]
    out = score(docs.toDF(*inner), net, text, keep=inner, name="toxicity").filter("toxicity < 0.5")
    return out.select(*inner).toDF(*docs.columns)
