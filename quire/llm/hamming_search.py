"""Operator 9: exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for each dimension, 1 where the number is above zero.
Codes are cut into segments, about as wide as the number of codes has bits. The index
is one table: segment, the value's first bits (its group), code. Radius by radius, an
open query goes to the groups whose bits differ from its own in no more places than
the radius; there a table of the other bits, made for the group's codes, is looked up
at just what is left of the radius, and the full distance of what is found is verified.
A pair that meets in several segments or rounds counts where it meets first, which the
two codes alone tell. Once m segments have been searched to radius r, every code within
m * (r + 1) - 1 has been found; a query is done when its kth verified distance is no
more than that.

Distinct codes are searched, each with its k least ids, which is all that can be
among a query's k nearest; equal queries are searched once. What is shuffled in a round
is the index, an entry for each segment of a code, and the open queries' visits; groups
that many codes have are dealt out in blocks. No code meets a query that it isn't a
candidate of.

Cases: a null vector has no code: it isn't indexed, and as a query has no result;
null or NaN numbers and missing dimensions count as 0; a vector of more dimensions
than the bits is an error, as its code would be that of a prefix; rows with a null id aren't queries and rank last; ties of
distance go to the least id; repeated rows are found each; fewer rows than k are
all returned; columns other than id and vector play no part; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import clean, cut

BITS = 64
#: Segments are no narrower than the one and, as there are LEAST_SEGMENTS, no wider than 16 bits.
LEAST_WIDTH = 8
LEAST_SEGMENTS = 4
#: Codes of a group, about, and at most of one of its blocks; a segment has at least 2 ** LEAST_PREFIX groups.
BLOCK = 1 << 16
LEAST_PREFIX = 3


def code_of(vector: Column) -> Column:
    """The code as a 64-bit number, dimension i at bit i; an error for more dimensions than that."""
    too_long = F.raise_error(F.concat(F.lit("a vector has "), F.size(vector).cast("string"), F.lit(f" dimensions, codes have {BITS} bits")))
    numbers = F.transform(F.when(F.size(vector) > BITS, too_long.cast("array<double>")).otherwise(vector), lambda x: (F.coalesce(x, F.lit(0)) > 0) & ~F.isnan(F.coalesce(x, F.lit(0))))
    bits = F.transform(numbers, lambda on, i: F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(codes: int) -> list[tuple[int, int]]:
    """The first bit and the width of each segment for so many codes."""
    n = max(LEAST_SEGMENTS, round(BITS / max(LEAST_WIDTH, math.log2(max(codes, 2)))))
    edges = [BITS * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def prefix_bits(codes: int) -> int:
    """How many bits of a segment's value name its group."""
    return min(max(LEAST_PREFIX, math.ceil(math.log2(max(codes / BLOCK, 1)))), LEAST_WIDTH)


def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of that width with so many bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def _in_groups(rows: DataFrame, code: str, cuts: list[tuple[int, int]], prefix: int, radius: int | None) -> DataFrame:
    """rows once for each segment, with seg, group and, for a radius, every group that is no farther: left is what remains of it."""
    made = []
    for s, (lo, w) in enumerate(cuts):
        own = F.shiftrightunsigned(F.col(code), lo + w - prefix).bitwiseAND(F.lit((1 << prefix) - 1)).cast("int")
        near = [(0, 0)] if radius is None else [(int(x), radius - j) for j in range(min(radius, prefix) + 1) if radius - j <= w - prefix for x in masks(prefix, j)]
        made += [F.struct(F.lit(s).alias("seg"), own.bitwiseXOR(F.lit(x)).alias("group"), F.lit(left).alias("left")) for x, left in near]
    return rows.select("*", F.inline(F.array(*made)))


def _index(codes: DataFrame, cuts: list[tuple[int, int]], prefix: int) -> tuple[DataFrame, DataFrame]:
    """seg, group, block and code: written; and seg, group, blocks, at most a row for each group: bounded."""
    entries = _in_groups(codes, "code", cuts, prefix, None).drop("left")
    sizes = cut(entries.groupBy("seg", "group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    dealt = entries.join(F.broadcast(sizes), ["seg", "group"])
    return cut(dealt.select("seg", "group", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int").alias("block"), "code")), sizes


def _met(open_: DataFrame, radius: int, index: DataFrame, sizes: DataFrame, cuts: list[tuple[int, int]], prefix: int, k: int) -> DataFrame:
    """query, code and distance of what open queries (query, far: only up to this distance) meet first at this radius."""
    visits = _in_groups(open_, "query", cuts, prefix, radius).join(F.broadcast(sizes), ["seg", "group"])
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(key, ours, theirs):
        import pyarrow as pa

        seg, group, _ = (k.as_py() for k in key)
        lo, width = cuts[seg]
        rest = width - prefix
        codes = np.sort(theirs.column("code").to_numpy().astype(np.int64)).view(np.uint64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        if len(codes) and len(ours):
            value = ((codes >> np.uint64(lo)) & np.uint64((1 << rest) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange((1 << rest) + 1))
            probe = {}
            for query, far, left in zip(ours.column("query").to_pylist(), ours.column("far").to_pylist(), ours.column("left").to_pylist(), strict=True):
                if left not in probe:
                    probe[left] = masks(rest, left)
                at = (query >> lo & ((1 << rest) - 1)) ^ probe[left]
                a, n = start[at], start[at + 1] - start[at]
                total = int(n.sum())
                if not total:
                    continue
                near = codes[order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)]]
                x = near ^ np.uint64(query & (1 << 64) - 1)
                d = np.bitwise_count(x).astype(np.int64)
                fits = d <= (BITS if far is None else far)
                for s, (b, w) in enumerate(cuts):
                    apart = np.bitwise_count((x >> np.uint64(b)) & np.uint64((1 << w) - 1))
                    fits &= apart > radius if s < seg else apart >= radius
                near, d = near[fits], d[fits]
                if len(d) > k:  # of this block no more than the kth nearest, and ties
                    near, d = near[d <= np.partition(d, k - 1)[k - 1]], d[d <= np.partition(d, k - 1)[k - 1]]
                found.append((np.full(len(d), query, np.int64), near.view(np.int64), d.astype(np.int32)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query", "code", "distance"])

    return visits.groupBy("seg", "group", "block").cogroup(index.groupBy("seg", "group", "block")).applyInArrow(search, "query long, code long, distance int")


def nearest_codes(codes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query, code, distance: of the distinct codes those no farther than the kth nearest of each distinct query."""
    n = codes.count()
    cuts, prefix = segments(n), prefix_bits(n)
    index, sizes = _index(codes, cuts, prefix)
    of_query = Window.partitionBy("query")
    none = F.lit(None)
    open_, held, done = wanted.select("query", none.cast("int").alias("far")), None, []
    for radius in range(max(w for _, w in cuts) + 1):
        found = _met(open_, radius, index, sizes, cuts, prefix, k)
        if held is not None:
            found = found.unionByName(held)
        # a row without a code stands for each open query
        found = found.unionByName(open_.select("query", none.cast("long").alias("code"), none.cast("int").alias("distance")))
        found = found.withColumn("i", F.rank().over(of_query.orderBy(F.col("distance").asc_nulls_last()))).filter((F.col("i") <= k) | F.col("code").isNull()).drop("i")
        found = found.withColumn("n", F.count("code").over(of_query)).withColumn("far", F.max("distance").over(of_query))
        covered = len(cuts) * (radius + 1) - 1
        last = radius >= max(w for _, w in cuts)
        found = cut(found.withColumn("whole", (F.col("n") >= k) & (F.col("far") <= covered) | (F.col("n") >= n) | F.lit(last)))
        done.append(found.filter("whole and code is not null").select("query", "code", "distance"))
        left = found.filter("not whole")
        held = left.filter("code is not null").select("query", "code", "distance")
        open_ = left.filter("code is null").select("query", F.when(F.col("n") >= k, F.col("far")).alias("far"))
        if open_.isEmpty():
            break
    clean(index, sizes)
    return reduce(DataFrame.unionByName, done)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and its Hamming distance, for every row of queries."""
    coded = cut(rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), code_of(F.col(vector_col)).alias("code")))
    asked = cut(queries.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), code_of(F.col(vector_col)).alias("query")))
    order = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    held = cut(coded.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k).drop("i"))
    near = nearest_codes(held.select("code").distinct(), asked.select("query").distinct(), k)
    # of a query's codes, those up to the kth nearest: more than k only where distances tie
    ranked = near.join(held.hint("merge"), "code").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", F.col("id").asc_nulls_last())))
    ranked = cut(ranked.filter(F.col("rank") <= k).select("query", "rank", F.col("id").alias("neighbour"), "distance"))
    return asked.join(ranked, "query").select("query_id", "rank", F.col("neighbour").alias(id_col), "distance")
