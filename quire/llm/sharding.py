"""Operator 2: shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring, and a row goes to the shard of the next
point clockwise from its own hash. A shard that is full passes its further rows
on clockwise, so no shard holds more than its capacity. With no slack the
capacities are the equal shares, so counts are at most one apart.

The ring has a fixed number of bins. Spark counts rows by bin, the driver walks
the bins' counts (never rows) around the ring, and the resulting segments of
bins, a table of bounded size, are broadcast to place the rows by their rank
within the bin. Rows that agree in all key columns are counted together before
anything is shuffled, so a hot key is one row until the last step.

Cases: null keys are values like any other; repeated rows get one slot each;
ties of a hash are ordered by the key columns; columns that aren't keys are left
out, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Bins of the ring: bounds what the driver walks and what is broadcast.
BINS = 1 << 16
#: A group of equal rows beyond this is dealt out in pieces of this many.
PIECE = 1 << 13


def ring_points(shards: int, points: int) -> list[tuple[int, int]]:
    """(bin, shard) of all virtual nodes, clockwise. A shard's points don't depend on the number of shards."""
    made = []
    for s in range(shards):
        for v in range(points):
            h = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
            made.append((h, s))
    return [(h * BINS >> 64, s) for h, s in sorted(made)]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """With slack: the rounded-up share of (1 + slack) times the rows. Without: equal shares, the first ones rounded up."""
    if slack > 0:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, points: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, rank after the last, shard, slot of the first) for all rows counted by bin."""
    ring = ring_points(shards, points)
    at = [b for b, _ in ring]
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int, int]] = []

    def put(b: int, lo: int, hi: int, s: int) -> int:
        n = min(hi - lo, room[s])
        if n:
            out.append((b, lo, lo + n, s, used[s]))
            used[s] += n
            room[s] -= n
        return lo + n

    for b in sorted(counts):
        p = bisect_left(at, b) % len(ring)
        lo = put(b, 0, counts[b], ring[p][1])
        if lo < counts[b]:
            over.append((b, lo, counts[b], p))
    skip = list(range(len(ring)))  # the next point clockwise whose shard may have room

    def open_from(p: int) -> int:
        path = []
        while not room[ring[p][1]]:
            path.append(p)
            p = skip[p] if skip[p] != p else (p + 1) % len(ring)
        for q in path:
            skip[q] = p
        return p

    for b, lo, hi, p in over:
        while lo < hi:
            p = open_from(p)
            lo = put(b, lo, hi, ring[p][1])
    return out


def assign(df: DataFrame, keys: Sequence[str], shards: int = 8, points: int = 64, slack: float = 0.0) -> DataFrame:
    """The key columns with shard and slot, a gapless number from 0 within the shard."""
    spark = df.sparkSession
    inner = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(df[k].alias(i) for k, i in zip(keys, inner, strict=True))).groupBy(*inner).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("h", F.xxhash64(*inner)).withColumn("bin", F.shiftrightunsigned("h", 48).cast("int"))
    order = Window.partitionBy("bin").orderBy("h", *inner)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut(rows.select(*inner, "n", "bin", F.coalesce(before, F.lit(0)).alias("r")))

    found = ranked.groupBy("bin").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    segments = walk({x["bin"]: x["n"] for x in found}, shards, points, slack)
    plan = spark.createDataFrame(segments, "b int, lo long, hi long, shard int, slot long")
    first, last = F.greatest("r", "lo"), F.least(F.col("r") + F.col("n"), "hi")
    out = ranked.join(F.broadcast(plan), (F.col("bin") == F.col("b")) & (F.col("lo") < F.col("r") + F.col("n")) & (F.col("hi") > F.col("r")))
    out = out.select(*inner, "shard", (F.col("slot") + first - F.col("lo")).alias("slot"), (last - first).alias("n"))
    if max((x["most"] for x in found), default=0) > PIECE:
        out = out.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
        out = out.select(*inner, "shard", (F.col("slot") + F.col("from")).alias("slot"), F.least(F.col("n") - F.col("from"), F.lit(PIECE)).alias("n")).hint("rebalance")
    if max((x["most"] for x in found), default=0) > 1:
        out = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("slot", F.col("slot") + F.col("i"))
    return out.select(*(F.col(i).alias(k) for i, k in zip(inner, keys, strict=True)), "shard", "slot")
