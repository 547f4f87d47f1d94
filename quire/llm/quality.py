"""Operator 7: quality rules as learned decision lists.

Statistics of a text are built-in column expressions. From labelled statistics,
sequential covering learns rules that reject: a rule grows by the threshold that
raises its FOIL gain most, is pruned on rows that it wasn't grown on, and stands
when it is precise enough there; the rows that it covers leave, and the next rule
is grown on the rest. The list becomes one ordered CASE expression.

The labelled rows are a sample of at most about MAX_LABELLED rows (a hash of the
id decides; labels beyond the bound only lower the share), so only their
statistics, a few numbers each, come to the driver.

Cases: a null text has no words; texts without words have zero statistics and
fail the base rules; a text of any length is one row, whole; labels that are null
or belong to no document are left out, and so are those of one document that
contradict each other; of rows that share a doc_id the least text teaches; with no labelled row the list is empty and
rejects nothing; repeated rows are judged each; extra columns stay as they are,
unless they have a statistic's name, which then replaces them.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import agreed_labels, cut, labelled_texts, unit_hash

SPACE = " \t\n\x0b\x0c\r"
#: Labelled rows that rules are learned from, about.
MAX_LABELLED = 8_000
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeats(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text has twice or more."""

    def counted(grams: Column) -> Column:
        def marked(s: Column) -> Column:
            at = lambda i: F.get(s, i)["g"]
            twin = F.filter(s, lambda e, i: F.coalesce(at(i - 1) == e["g"], F.lit(False)) | F.coalesce(at(i + 1) == e["g"], F.lit(False)))
            starts = F.sort_array(F.transform(twin, lambda e: e["i"]))
            none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end"))
            return F.aggregate(starts, none, step, lambda acc: acc["n"])

        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(ordered, marked))

    def windows(h: Column) -> Column:
        first = F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1))
        return F.transform(first, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashed, lambda h: _let(windows(h), counted)))


def statistics(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    bare = F.trim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)
    long = lambda c, name: c.cast("long").alias(name)
    return F.struct(
        _let(words, lambda w: F.struct(long(F.size(w), "n_words"), long(_repeats(w), "n_repeat_words"))).alias("w"),
        long(F.length(F.regexp_replace(text, "[ \\t-\\r]+", "")), "word_chars"),
        long(F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")), "n_symbols"),
        long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"),
    )


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and the statistics. A generator computes them, so that no filter above repeats the work."""
    kept = [c for c in df.columns if c.lower() not in STATISTICS]
    out = df.select(*kept, F.inline(F.array(statistics(df[text_col]))).alias("_w", "word_chars", "n_symbols", "n_dup_lines"))
    return out.select(*kept, F.col("_w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.n_repeat_words").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


#: What rules look at, in whole numbers: each is its name, its column, and the same from a row's statistics.
def _ratio(a: str, b: str, by: int) -> Column:
    return F.when(F.col(b) > 0, F.expr(f"({a} * {by}) div {b}")).otherwise(F.lit(0)).cast("long")


def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words"),
        "chars_per_100_words": _ratio("word_chars", "n_words", 100),
        "symbols_per_1000_chars": _ratio("n_symbols", "word_chars", 1000),
        "repeated_per_1000_words": _ratio("n_repeat_words", "n_words", 1000),
        "n_dup_lines": F.col("n_dup_lines"),
        "dup_lines_per_1000_words": _ratio("n_dup_lines", "n_words", 1000),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def holds(self, row: dict[str, int]) -> bool:
        return (row[self.feature] >= self.threshold) == self.at_least

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold}"


Rule = tuple[Condition, ...]


def learn(rows: Sequence[tuple[dict[str, int], bool]], max_rules: int = 12, max_conditions: int = 3, cuts: int = 32, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Rules whose conjunction marks rows as bad. rows: features and whether the row is bad.

    A third of the rows, every third in the given order, is kept for pruning.
    """
    names = list(rows[0][0]) if rows else []
    options: list[Condition] = []
    for f in names:
        seen = sorted(r[f] for r, _ in rows)
        of_bad = sorted(r[f] for r, bad in rows if bad)
        at = {v[len(v) * k // cuts] for v in (seen, of_bad) for k in range(cuts) if v} | {v[-1] for v in (seen, of_bad) if v}
        # half way to the next smaller value, so that a gap is split in its middle
        at = {(seen[i - 1] + v + 1) // 2 for v in at if (i := bisect_left(seen, v))} | {seen[-1] + 1}
        options += [Condition(f, up, v) for v in sorted(at) for up in (True, False)]

    # a row set is the bits of an integer, so that a conjunction is one "and"
    def bits(rows_: Sequence[tuple[dict[str, int], bool]]):
        covers = {o: sum(1 << i for i, (r, _) in enumerate(rows_) if o.holds(r)) for o in options}
        return covers, sum(1 << i for i, (_, bad) in enumerate(rows_) if bad), (1 << len(rows_)) - 1

    grow, prune = [x for i, x in enumerate(rows) if i % 3], [x for i, x in enumerate(rows) if i % 3 == 0]
    (g_cov, g_bad, g_left), (p_cov, p_bad, p_left) = bits(grow), bits(prune)
    rules: list[Rule] = []
    while len(rules) < max_rules and (g_left & g_bad).bit_count() >= least:
        rule: list[Condition] = []
        inside = g_left
        while len(rule) < max_conditions and inside & ~g_bad:
            p0, n0 = (inside & g_bad).bit_count(), inside.bit_count()
            best, gain = None, 0.0
            for o in options:
                now = inside & g_cov[o]
                p1 = (now & g_bad).bit_count()
                if p1 >= least and (v := p1 * (math.log2(p1 / now.bit_count()) - math.log2(p0 / n0))) > gain:
                    best, gain = o, v
            if best is None:
                break
            rule.append(best)
            inside &= g_cov[best]

        def worth(conditions: Sequence[Condition]) -> tuple[float, int]:
            now = p_left
            for o in conditions:
                now &= p_cov[o]
            p, n = (now & p_bad).bit_count(), now.bit_count()
            return (p + 1) / (n + 2), p

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule.pop()
        if not rule or worth(rule)[0] < precision:
            break
        rules.append(tuple(rule))
        g, p = g_left, p_left
        for o in rule:
            g, p = g & g_cov[o], p & p_cov[o]
        g_left, p_left = g_left & ~g, p_left & ~p
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that holds, from 1, or 0: the rows that no rule rejects."""
    out = None
    for i, rule in enumerate(rules, 1):
        here = rule[0].column()
        for c in rule[1:]:
            here = here & c.column()
        out = F.when(here, F.lit(i)) if out is None else out.when(here, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MAX_LABELLED) -> list[tuple[dict[str, int], bool]]:
    """Features of a bounded sample of labelled documents, in order of a hash of the id; bad where the label is 0."""
    known = agreed_labels(labels, label_col)
    n = known.count()
    order = unit_hash("doc_id", F.lit("rules"))
    sample = cut(known.filter(order < most / max(n, most)))
    rows = labelled_texts(docs, sample, "text")
    rows = with_statistics(rows).select(F.struct(*(c.alias(k) for k, c in features().items())).alias("f"), "label", order.alias("o"))
    found = rows.collect()
    found.sort(key=lambda r: (r["o"], tuple(r["f"]), r["label"]))
    return [(r["f"].asDict(), r["label"] == 0) for r in found]


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """docs, statistics, base_failed, rule (the first that holds, or 0) and kept."""
    kept = [c for c in docs.columns if c.lower() not in ("base_failed", "rule", "kept")]
    out = with_statistics(docs).select(*(c for c in kept if c.lower() not in STATISTICS), *STATISTICS, base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The documents that pass the base rules and the list, with all columns that docs has."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    text = dict(zip(docs.columns, inner, strict=True))["text"]
    out = with_statistics(docs.toDF(*inner), text).filter(~base_failed() & (verdict(rules) == 0))
    return out.select(*inner).toDF(*docs.columns)
