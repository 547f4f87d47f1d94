"""Operator 4: language identification.

Character n-grams of one to three lower-cased characters, hashed into buckets,
weighted by TF-IDF; a sparse multinomial logistic regression trained with
follow-the-regularised-leader and elastic-net penalties; probabilities calibrated
by a temperature on rows that the weights weren't trained on.

Document frequencies count all training documents. Weights are trained on a
sample of about MAX_PER_LANGUAGE documents of each language (a hash of the id and
text decides) and of at most the MAX_LANGUAGES most frequent languages, and has at most MAX_ENTRIES n-gram counts,
so what comes to the driver is bounded by that and the buckets.

Cases: a text that is null or has no letter (a character that str.isalpha takes
for one; numerals aren't) is `und` with score 0; with no
training row every text is `und`; texts of any length count whole; rows whose
language is null teach nothing; repeated rows are learned from once and predicted
each; ties go to the language that sorts first; a kept column whose name is that
of an output column gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, cut, unit_hash, within

BUCKETS = 1 << 15
MAX_PER_LANGUAGE = 600
#: Languages that are learned; a column with more distinct values teaches its most frequent ones.
MAX_LANGUAGES = 256
#: N-gram counts of all sampled rows together.
MAX_ENTRIES = 1 << 24
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    h = np.concatenate([one, two, three])
    return np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(17), minlength=BUCKETS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by bucket
    weights: np.ndarray  # bucket, language
    bias: np.ndarray
    temperature: float

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return weigh(gram_counts(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, x = self.features(text)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def fit_weights(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], languages: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, one row at a time; l1 keeps weights at zero that little speaks for."""
    z, n = np.zeros((BUCKETS + 1, languages)), np.zeros((BUCKETS + 1, languages))
    lazy = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 0.1)  # the last is the bias
            zs, ns = z[at], n[at]
            w = lazy(zs, ns)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    w = lazy(z, n)
    return w[:-1], w[-1] * 0.1


def fit_temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        s = s - np.log(np.exp(s).sum(1, keepdims=True))
        doubt = 1 / (len(truth) + 1)  # as if one row more had been mislabelled: no temperature is zero
        return float(-((1 - doubt) * s[np.arange(len(truth)), truth] + doubt * s.mean(1)).mean())

    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    for _ in range(40):
        if loss(a) <= loss(b):
            hi, b, a = b, a, b - r * (b - lo)
        else:
            lo, a, b = a, b, a + r * (hi - a)
    return float(np.exp((lo + hi) / 2))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = MAX_PER_LANGUAGE) -> Model:
    """Learn from the texts and languages of df: pass the training rows only."""
    spark = df.sparkSession
    bounded_batches(spark)
    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ordered = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    sizes = {r["lang"]: r["n"] for r in ordered.limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    # the text is hashed too, so that rows that share an id aren't all drawn or all left out
    order = unit_hash("id", "text", F.lit("language"))
    shares = F.create_map(*(F.lit(x) for lang in languages for x in (lang, per_language / max(sizes[lang], per_language))))
    share: Column = F.coalesce(shares[F.col("lang")], F.lit(0.0))
    marked = known.select("text", "lang", (order < share).alias("learn"), order.alias("o"))

    # one pass: document frequencies of every row, gram counts of the sampled rows
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("o", T.DoubleType()), T.StructField("at", T.ArrayType(T.IntegerType(), False)), T.StructField("n", T.ArrayType(T.LongType(), False))])

    def scan(batches):
        import pyarrow as pa

        df_counts = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for text, lang, learn, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = gram_counts(text)
                at = np.flatnonzero(c)
                df_counts[at] += 1
                df_counts[BUCKETS] += 1
                if learn:
                    rows.append((lang, o, at.astype(np.int32), c[at]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, to_arrow, strict=True)], schema=to_arrow)
        at = np.flatnonzero(df_counts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.float64()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([df_counts[at]], pa.list_(pa.int64()))], schema=to_arrow)

    import pyarrow as pa

    to_arrow = pa.schema([("lang", pa.string()), ("o", pa.float64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    found = cut(marked.mapInArrow(scan, schema))
    counts = found.filter("lang is null").select(F.explode(F.arrays_zip("at", "n")).alias("e")).groupBy(F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n")).collect()
    dfs = np.zeros(BUCKETS + 1)
    for r in counts:
        dfs[r["at"]] = r["n"]
    idf = np.log((1 + dfs[BUCKETS]) / (1 + dfs[:BUCKETS])) + 1
    rows = []
    sample = cut(found.filter("lang is not null").dropDuplicates(["o", "lang"]).withColumn("entries", F.size("at")))
    for r in sorted(within(sample, "o", "entries", MAX_ENTRIES).collect(), key=lambda r: (r["o"], r["lang"], r["n"])):
        c = np.zeros(BUCKETS, np.int64)
        c[r["at"]] = r["n"]
        rows.append((*weigh(c, idf), languages.index(r["lang"])))
    rows.sort(key=lambda r: float(r[1][:8].sum() * 1e6 % 1))  # languages mixed, the same way each time
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    weights, bias = fit_weights([r for i, r in enumerate(rows) if i % 5 != 4], len(languages))
    scores = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), fit_temperature(scores, np.array([y for *_, y in held], int)))


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred and score."""
    spark = df.sparkSession
    bounded_batches(spark)
    kept = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=schema.names)

    return df.select(*kept, df[text_col].alias("_text" if "_text" not in kept else "__text")).mapInArrow(run, schema)
