"""Operator 6: mixing sources to target weights by hierarchical budgeting.

Documents hang on the leaves of a tree of domains, languages and sources. A
budget of tokens goes down the tree by the nodes' weights. What a node can't
hold goes to its siblings first, and to the ancestors' siblings only when the
whole family is full: at each node the budget is poured over the children in
proportion to their weights, none beyond what its subtree can give in the
permitted number of epochs. A leaf then gives whole epochs of its documents and,
of the next epoch, the prefix of a seeded order that fits the rest.

The prefix is found without sorting a leaf: sums by bins of the order's hash give
the bin in which the budget ends, its bins in turn a narrower one, and only that
bin's rows are ordered. Its last
hash is the leaf's threshold, so picking rows is a comparison.

Cases: a null node counts as the empty text; a document without tokens comes
along when its hash is below the threshold; a leaf without any token gives
nothing; rows that agree in id and text share a hash and are taken together or
not at all; extra columns stay out of the way; an empty table gives an empty
table. Shares are rounded down, so fewer tokens than a node has children may be
left over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: A leaf table of at most this many rows is broadcast to the documents; a larger one is joined by Spark's own choice.
MAX_BROADCAST_LEAVES = 100_000
#: Hexadecimal digits of the order's hash by which the budget's end is narrowed down, 256 bins at a time.
_PREFIXES = (2, 4)


def domain_of(source: str = "source") -> Column:
    """d0 to d3 by the number that ends the source's name; other where there is none."""
    digits = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.expr(f"try_cast(regexp_extract(coalesce({source}, ''), '([0-9]{{1,9}})$', 1) as long)") % 4).cast("string")))


def n_words(text: str = "text") -> Column:
    """Words between ASCII white space: the tokens that budgets count."""
    bare = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def pour(parents: list[str], children: DataFrame, node: str, budget: Column) -> DataFrame:
    """children (parents, node, w, cap, budget of the parent) with own: the budget of each child."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")
    order = family.orderBy(F.expr("cast(cap as decimal(18,0)) * 1000000 div w"), node)
    df = children.withColumn("b", budget)
    df = df.withColumn("c_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("w_from", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("full", big("cap") * big("w_from") <= big("w") * big(F.col("b") - F.col("c_before")))
    df = df.withColumn("b_left", F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)))
    df = df.withColumn("w_left", F.sum(F.when(~F.col("full"), F.col("w"))).over(family))
    own = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(w as decimal(18,0)) * cast(b_left as decimal(18,0)) div w_left"))
    return df.withColumn("own", own.cast("long")).drop("b", "c_before", "w_from", "full", "b_left", "w_left")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column) -> DataFrame:
    """leaves (levels, tokens, cap, total) with own: each leaf's budget. weights: level -> node -> a positive integer, 1 if absent."""
    def weight(level: str) -> Column:
        pairs = [F.lit(x) for kv in weights.get(level, {}).items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(1)).cast("long") if pairs else F.lit(1).cast("long")

    given = None
    for d in range(1, len(levels) + 1):
        path = list(levels[:d])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max("total").alias("total")).withColumn("w", weight(path[-1]))
        if given is None:
            poured = pour([], nodes, path[-1], budget)
        else:
            poured = pour(path[:-1], nodes.join(given, path[:-1]), path[-1], F.col("above"))
        given = poured.select(*path, F.col("own").alias("above"))
    return leaves.join(given.withColumnRenamed("above", "own"), list(levels))


def order_hash(seed: int, epoch: Column, doc_id: Column, digest: Column) -> Column:
    """The seeded order of an epoch, as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), digest).cast("binary"))


def plan_leaves(slim: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> DataFrame:
    """levels, whole (epochs that are taken whole) and upto (threshold of the order of the next epoch).

    slim: levels, doc_id, digest, n_tokens. share: numerator and denominator of the budget, as part of all tokens.
    """
    sums = slim.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).first()["total"]
    leaves = cut(sums.withColumn("cap", F.col("tokens") * max_epochs).withColumn("total", F.lit(total).cast("long")))
    budget = F.lit(total * share[0] // share[1]).cast("long")
    own = leaf_budgets(leaves, levels, weights, budget).filter("tokens > 0")
    own = cut(own.select(*levels, F.expr("own div tokens").alias("whole"), F.expr("own % tokens").alias("rest")))
    rows = attach(slim, own, levels).withColumn("h", order_hash(seed, F.col("whole"), F.col("doc_id"), F.col("digest"))).select(*levels, "h", "n_tokens")
    ends = own.select(*levels, F.lit("").alias("prefix"), F.col("rest").alias("room"))
    for digits in _PREFIXES:
        bins = attach(rows, ends, levels).filter(F.col("h").startswith(F.col("prefix")))
        bins = bins.groupBy(*levels, "room", F.substring("h", 1, digits).alias("bin")).agg(F.sum("n_tokens").alias("n"))
        bins = bins.withColumn("cum", F.sum("n").over(Window.partitionBy(*levels).orderBy("bin"))).filter("cum > room")
        ends = cut(bins.groupBy(*levels).agg(F.min(F.struct("bin", F.expr("room - (cum - n)").alias("room"))).alias("e")).select(*levels, F.col("e.bin").alias("prefix"), "e.room"))
    last = attach(rows, ends, levels).filter(F.col("h").startswith(F.col("prefix")))
    by_hash = last.groupBy(*levels, "room", "h").agg(F.sum("n_tokens").alias("n"))
    by_hash = by_hash.withColumn("cum", F.sum("n").over(Window.partitionBy(*levels).orderBy("h"))).filter("cum <= room")
    upto = by_hash.groupBy(*levels).agg(F.max("h").alias("h"))
    found = own.join(ends, list(levels), "left").join(upto, list(levels), "left")
    return cut(found.select(*levels, "whole", F.coalesce("h", "prefix", F.lit("")).alias("upto")))


def attach(rows: DataFrame, leaves: DataFrame, levels: Sequence[str]) -> DataFrame:
    """rows with their leaf's columns; the leaf table is broadcast only when its count is small."""
    few = leaves.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, list(levels))


def take(rows: DataFrame, plan: DataFrame, levels: Sequence[str], seed: int, doc_id: str = "doc_id", digest: str = "digest") -> DataFrame:
    """rows as often as the plan takes them, with epoch from 0."""
    out = attach(rows, plan, levels)
    h = order_hash(seed, F.col("whole"), F.col(doc_id), F.col(digest))
    times = F.col("whole") + F.when(h <= F.col("upto"), 1).otherwise(0)
    out = out.withColumn("epochs", F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>")))
    return out.withColumn("epoch", F.explode("epochs")).drop("epochs", "whole", "upto")


def slim_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the tree's levels, digest of the text and n_tokens."""
    return docs.select(
        "doc_id",
        domain_of("source").alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
        n_words("text").alias("n_tokens"),
    )


LEVELS = ("domain", "lang", "source")


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch of all documents taken."""
    slim = cut(slim_documents(docs))
    plan = plan_leaves(slim, LEVELS, weights, share, max_epochs, seed)
    return take(slim, plan, LEVELS, seed).select("doc_id", *LEVELS, "n_tokens", "epoch")


def mix_documents(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> DataFrame:
    """The documents taken, as often as they are taken, with all columns that docs has."""
    plan = plan_leaves(cut(slim_documents(docs)), LEVELS, weights, share, max_epochs, seed)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, inner, strict=True))
    rows = docs.toDF(*inner).select("*", domain_of(named["source"]).alias("domain"), F.coalesce(named["lang"], F.lit("")).alias("lang"), F.coalesce(named["source"], F.lit("")).alias("source"), F.md5(F.coalesce(named["text"], F.lit("")).cast("binary")).alias("digest"))
    return take(rows, plan, LEVELS, seed, named["doc_id"]).select(*inner).toDF(*docs.columns)
