"""Sharding by minimax contiguous partition over ordered atomic groups.

Groups are equal texts, ordered by a 64-bit hash of the text; a group is never cut. The smallest shard
capacity that lets a greedy left-to-right filling end within the wanted number of shards is found by
binary search, then the order is cut there.

The driver never holds the groups. It works on a histogram of the hash order: cells that a cut could
fall into are refined into finer cells until each holds one group, the others stay coarse.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialise

SHARDS = 24
#: Bits that a refinement adds; at most 2**FIRST_BITS cells are collected at first.
FIRST_BITS = 14
MORE_BITS = 8
#: Cells refined in one pass, and with it at most REFINED * 2**MORE_BITS rows collected.
REFINED = 1024
#: Rows of a slot-numbering bucket, on average.
BUCKET_ROWS = 200_000


class Cell:
    """A range of the hash order: its first position, width in bits, bytes and number of groups."""

    __slots__ = ("bits", "groups", "lo", "size")

    def __init__(self, lo, bits, size, groups):
        self.lo, self.bits, self.size, self.groups = lo, bits, size, groups

    @property
    def whole(self) -> bool:
        return self.groups <= 1 or self.bits >= 64


def greedy(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cut positions of a greedy filling over prefix sums, or None if it takes more than ``shards``."""
    cuts, at = [], 0
    while at < len(sums) - 1:
        if len(cuts) == shards:
            return None
        nxt = bisect_right(sums, sums[at] + capacity) - 1
        if nxt == at:
            return None
        cuts.append(nxt)
        at = nxt
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Binary search over the capacity; returns it with the greedy cuts."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    lo, hi = max([0, *sizes, -(-sums[-1] // shards)]), sums[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(sums, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, greedy(sums, lo, shards) or []


def _histogram(groups: DataFrame, bits: int) -> list[Cell]:
    p = F.shiftrightunsigned("pos", 64 - bits)
    rows = groups.groupBy(p.alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return [Cell(r["p"] << (64 - bits), bits, r["size"], r["n"]) for r in rows]


def _refine(groups: DataFrame, cells: list[Cell]) -> list[Cell]:
    spark, old = groups.sparkSession, cells[0].bits
    bits = min(64, old + MORE_BITS)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keys = spark.createDataFrame([(signed(c.lo),) for c in cells], "cell_lo long")
    mask = F.lit(signed(((1 << old) - 1) << (64 - old)))
    inside = groups.join(F.broadcast(keys), F.col("pos").bitwiseAND(mask) == F.col("cell_lo"))
    p = F.shiftrightunsigned("pos", 64 - bits) if bits < 64 else F.col("pos")
    rows = inside.groupBy(p.alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return [Cell((r["p"] % (1 << 64)) << (64 - bits), bits, r["size"], r["n"]) for r in rows]


def find_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Unsigned positions at which the shards after the first begin.

    ``groups``: ``pos`` (the hash order, distinct), ``size``. With undivided cells as atoms the search
    gives a capacity that is surely feasible; total/shards and the largest group bound it from below.
    A greedy filling's k-th cut moves right with the capacity, so it lies between the cuts of these two
    bounds. Only cells there are refined. The loop ends when none of them holds more than one group: the
    best cuts are then cell borders, and the search over cells is exact.
    """
    cells = sorted(_histogram(groups, FIRST_BITS), key=lambda c: c.lo)
    least = groups.agg(F.max("size")).first()[0] or 0
    while cells:
        sizes = [c.size for c in cells]
        sums = [0]
        for s in sizes:
            sums.append(sums[-1] + s)
        high, cuts = smallest_capacity(sizes, shards)
        low = max(least, -(-sums[-1] // shards))
        doubtful, first_lo, last_hi = set(), 0, 0
        for _ in range(shards):
            a = min(bisect_right(sums, first_lo + low) - 1, len(cells))
            first_lo = sums[a]  # a filling that fits no more of cell a ends at its first position at the least
            b = min(bisect_right(sums, last_hi + high) - 1, len(cells))
            last_hi = sums[b] if b == len(cells) or cells[b].whole else last_hi + high
            doubtful |= {i for i in range(a, min(len(cells), b + 1)) if not cells[i].whole}
            if a == len(cells):
                break
        if high <= low or not doubtful:
            return [cells[i].lo for i in cuts if i < len(cells)]
        coarse = min(cells[i].bits for i in doubtful)
        first = [i for i in sorted(doubtful, key=lambda i: -cells[i].size) if cells[i].bits == coarse][:REFINED]
        gone = set(first)
        cells = [c for i, c in enumerate(cells) if i not in gone] + _refine(groups, [cells[i] for i in first])
        cells.sort(key=lambda c: c.lo)
    return []


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus 8, ``law`` is ``bytes``. A null text has size 8 and is a
    group of its own beside the empty text, for groups are equal texts and null equals none. A group larger than total/shards makes a shard as large as
    itself, for groups are atomic. Slots number a shard's rows from 0 without gaps, in order of a hash
    bucket of doc_id, then doc_id; rows that repeat a doc_id take slots of their own. Fewer groups than
    shards leave the last shards empty, an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
            F.xxhash64("text").alias("pos"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("pos").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    cuts = find_cuts(groups, shards)
    total = groups.agg(F.sum("n")).first()[0] or 0
    flip = -(1 << 63)  # signed comparison in unsigned order
    order = F.col("pos").bitwiseXOR(F.lit(flip))
    place = F.lit(0)
    for c in cuts:
        place = place + (order >= F.lit(c + flip)).cast("int")
    buckets = max(1, -(-total // BUCKET_ROWS), min(64, total // 2000))
    placed = rows.select("doc_id", "size", "text_crc32", place.alias("shard")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op7_sharding(spark, sf_dir):
    return shard(load(spark, sf_dir, "documents"))
