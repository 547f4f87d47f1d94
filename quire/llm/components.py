"""Connected components of links by repeated contraction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean, cut, hot_keys, spread_join


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of links (a, b: long).

    Every round each node points at the neighbour whose hash of the round is least, or
    itself, pointers are followed once, and links between the nodes pointed at are what
    is left. As the order is another one each round, a component of any shape shrinks
    by a share of its nodes a round; nothing is collected. Links may repeat,
    in either direction; a node linked to itself is a component of its own. A hub's
    links aren't gathered in one task.
    """
    left = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = None
    for turn in count():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        point = left.groupBy("a").agg(F.min(place("b")).alias("least"), F.count(F.lit(1)).alias("n"))
        point = cut(point.select(F.col("a").alias("node"), F.least("least", place("a"))["to"].alias("to"), "n"))
        hubs = hot_keys(point, ["node"])
        named = lambda k: hubs and hubs.toDF(k)  # noqa: E731, B023
        # no more nodes point at a node than are linked to it
        jump = spread_join(point.select("node", "to"), point.select(F.col("node").alias("to"), F.col("to").alias("next")), ["to"], named("to")).select("node", F.col("next").alias("to"))
        jump = cut(jump)
        a, b = jump.toDF("a", "ta"), jump.toDF("b", "tb")
        fewer = cut(spread_join(spread_join(left, a, ["a"], named("a")), b, ["b"], named("b")).filter("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
        clean(point, left)
        if label is None:
            label = jump.toDF("node", "label")
        else:
            old = label
            sizes = cut(label.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
            moved = jump.toDF("label", "to")
            # labels that no link is left of are of components that are done
            every = cut(sizes.select("label").join(moved, "label", "left").select("label", F.coalesce("to", "label").alias("to")))
            label = cut(spread_join(label, every, ["label"], hot_keys(sizes, ["label"])).select("node", F.col("to").alias("label")))
            clean(old, jump, sizes, every)
        left = fewer
        if left.isEmpty():
            clean(left)
            break
    sizes = cut(label.groupBy("label").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    out = cut(spread_join(label, sizes.select("label", "least"), ["label"], hot_keys(sizes, ["label"])).select("node", F.col("least").alias("label")))
    clean(label, sizes)
    return out
