"""Sharding by minimax contiguous partition of ordered atomic group sizes.

Groups are the rows of one text, ordered by the text's hash as an unsigned number.
The smallest shard capacity for which consecutive whole groups fill no more than the
wanted shards is found by binary search with a greedy check, over all groups,
though the driver never holds them all: it sees units, which are ranges of hashes.
A first job sizes ``2**BIN_BITS`` units.  Units where a cut can't fall stay as they
are; those where it may are divided by further jobs until each is one group.  The
cuts are then placed at the group borders nearest to equal shares that keep every
shard within that capacity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

HASH_BITS = 64
BIN_BITS = 16
#: A job that divides units makes at most about so many.
DIVIDED_UNITS = 1 << 16
#: Bins with more rows than 1/4096 of all (64 at least) are numbered in parts.
PART_SHARE = 4096
#: Rows alike in id and text are numbered in runs of so many.
REPEATS = 65_536


class Unit(NamedTuple):
    """Hashes that begin with the leading ``bits`` of ``start``, and the bytes they have."""

    start: int
    bits: int
    bytes: int
    whole: bool  # one group, which can't be divided


def cuts_within(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy ends of consecutive ranges of at most ``capacity``; None if over ``shards``.

    ``sums``: running totals of the ordered sizes, from 0.
    """
    ends, at = [], 0
    while at < len(sums) - 1:
        if len(ends) == shards:
            return None
        end = bisect_right(sums, sums[at] + capacity) - 1
        if end == at:
            return None
        ends.append(end)
        at = end
    return ends


def _least(low: int, high: int, enough: Callable[[int], bool]) -> int:
    while low < high:
        middle = (low + high) // 2
        if enough(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity for which ``sizes`` fall into ``shards`` consecutive ranges."""
    sums = [0, *accumulate(sizes)]
    low = max([0, *sizes, -(-sums[-1] // shards)])
    return _least(low, max(low, sums[-1]), lambda c: cuts_within(sums, c, shards) is not None)


def balanced_cuts(sizes: list[int], shards: int) -> list[int]:
    """Ends of ``shards`` ranges of at most the minimax capacity, each as near as may be
    to its equal share of the total; ranges may be empty."""
    sums = [0, *accumulate(sizes)]
    capacity, n = minimax_capacity(sizes, shards), len(sizes)
    # The earliest end of each range that leaves the rest within capacity.
    earliest = [n] * shards
    for j in range(shards - 1, 0, -1):
        earliest[j - 1] = bisect_left(sums, sums[earliest[j]] - capacity)
    ends, at = [], 0
    for j in range(shards):
        goal = sums[-1] * (j + 1) / shards
        low = max(at, earliest[j])
        high = bisect_right(sums, sums[at] + capacity) - 1
        end = bisect_left(sums, goal)
        if end > 0 and goal - sums[end - 1] <= sums[min(end, n)] - goal:
            end -= 1
        at = min(max(end, low), high, n)
        ends.append(at)
    return ends


def _reach(sums: list[int], units: list[Unit], at: int, capacity: int) -> int:
    """Furthest end of a range from byte ``at``, if units that aren't whole may be cut anywhere."""
    goal = min(at + capacity, sums[-1])
    i = bisect_right(sums, goal) - 1
    return sums[i] if i < len(units) and units[i].whole else goal


def undecided(units: list[Unit], shards: int) -> list[int]:
    """Numbers of the units that a cut may divide: the greedy check's cuts at the smallest
    capacity, and the ends of equal shares."""
    sums = [0, *accumulate(u.bytes for u in units)]
    if not sums[-1]:
        return []
    high = minimax_capacity([u.bytes for u in units], shards)

    def enough(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = _reach(sums, units, at, capacity)
        return at >= sums[-1]

    low = max([-(-sums[-1] // shards), *(u.bytes for u in units if u.whole)])
    low = _least(low, high, enough)
    ranges, least, most = [], 0, 0
    for j in range(1, shards):
        # No capacity between the bounds cuts before ``least`` or after ``most``.
        i = bisect_right(sums, min(least + low, sums[-1])) - 1
        least, most = max(least, sums[i]), min(most + high, sums[-1])
        ranges += [(least, most), (sums[-1] * j // shards,) * 2]
    found = set()
    for first, last in ranges:
        i = max(0, bisect_left(sums, first) - 1)
        while i < len(units) and sums[i] <= last:
            if not units[i].whole and sums[i + 1] >= first:
                found.add(i)
            i += 1
    return sorted(found)


def _unsigned(h: int) -> int:
    return h % (1 << HASH_BITS)


def _sized(rows: DataFrame, found: list[Unit] | None) -> list[Unit]:
    """The units that ``found`` divide into (None: the first ones), in order of hash.

    At most ``2**BIN_BITS`` or about ``DIVIDED_UNITS`` rows come to the driver.
    """
    if found is None:
        parts = rows.withColumn("shift", F.lit(HASH_BITS - BIN_BITS))
    else:
        more = max(1, (DIVIDED_UNITS // len(found)).bit_length() - 1)
        asked = [(u.start >> (HASH_BITS - BIN_BITS), _signed(u.start), _signed(u.start + (1 << (HASH_BITS - u.bits)) - 1), max(0, HASH_BITS - u.bits - more)) for u in found]
        asked = F.broadcast(rows.sparkSession.createDataFrame(asked, "_bin int, _low long, _high long, shift int"))  # the units asked for
        parts = rows.join(asked, (F.col("bin") == F.col("_bin")) & F.col("_x").between(F.col("_low"), F.col("_high")))
    sums = parts.groupBy("shift", F.expr("shiftrightunsigned(_h, shift)").alias("prefix")).agg(
        F.sum("size").alias("bytes"), (F.min("_h") == F.max("_h")).alias("whole")
    )
    return sorted(Unit(_unsigned(r["prefix"]) << r["shift"], HASH_BITS - r["shift"], r["bytes"], r["whole"]) for r in sums.collect())


def _signed(u: int) -> int:
    """An unsigned hash as a signed number in the same order."""
    return u - (1 << (HASH_BITS - 1))


def _thresholds(rows: DataFrame, shards: int) -> list[int]:
    """For each shard with rows but the first, the first hash (signed order) in it or beyond."""
    units = _sized(rows, None)
    while found := undecided(units, shards):
        divided = _sized(rows, [units[i] for i in found])
        gone = set(found)
        units = sorted([u for i, u in enumerate(units) if i not in gone] + divided)
    ends = balanced_cuts([u.bytes for u in units], shards)[:-1]
    return [_signed(units[e].start) for e in ends if e < len(units)]  # shards after the last unit are empty


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to a shard of near equal bytes; equal texts stay together.

    Returns ``doc_id, size, text_crc32, shard, slot``: size is the UTF-8 length plus
    8, slots number each shard's rows gaplessly from 0.  The largest shard is as
    small as whole groups in order of hash allow.  A null text is an empty one.
    Rows alike in id and text, null ids too, are counted and get slots of their own;
    ties are numbered by hash and id.  An empty table gives no rows, and other
    columns aren't read.  A group larger than a shard's share makes the capacity that
    large, as its rows must stay together.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("_each"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
    )
    rows = rows.groupBy("doc_id", "_each", "text_crc32", "_h").agg(F.count("*").alias("_n"))
    flip = F.lit(-(1 << (HASH_BITS - 1)))
    rows = rows.withColumn("size", F.col("_each") * F.col("_n")).withColumn("bin", F.shiftrightunsigned("_h", HASH_BITS - BIN_BITS).cast("int"))
    rows = materialize(rows.withColumn("_x", F.col("_h").bitwiseXOR(flip)), "shard-rows")
    # Every bin's first shard, and the thresholds within it.
    at = _thresholds(rows, shards)
    counts = rows.groupBy("bin").agg(F.sum("_n").alias("n")).collect()  # at most 2**BIN_BITS rows
    share = max(64, sum(b["n"] for b in counts) // PART_SHARE)
    width = 1 << (HASH_BITS - BIN_BITS)
    plan = []
    for b in counts:
        low = _signed(b["bin"] * width)
        first, last = bisect_right(at, low), bisect_right(at, low + width - 1)
        plan.append((b["bin"], first, at[first:last], -(-b["n"] // share)))
    planned = F.broadcast(spark.createDataFrame(plan, "bin int, _first int, _inside array<long>, parts int"))  # as many rows
    rows = rows.join(planned, "bin").withColumn("shard", (F.col("_first") + F.size(F.filter("_inside", lambda t: t <= F.col("_x")))).cast("int"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "_h"), F.col("parts")).cast("int")).drop("parts", "_first", "_inside", "_x")
    rows = materialize(rows, "shard-planned")
    # Slots: whole (shard, bin, part) units are laid out one after another within a shard.
    units = rows.groupBy("shard", "bin", "_part").agg(F.sum("_n").alias("n")).orderBy("shard", "bin", "_part").collect()  # 2**BIN_BITS + 2 * PART_SHARE + shards rows at most
    starts, next_slot = [], {}
    for u in units:
        begin = next_slot.get(u["shard"], 0)
        starts.append((u["shard"], u["bin"], u["_part"], begin))
        next_slot[u["shard"]] = begin + u["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "shard int, bin int, _part int, _at long"))
    before = W.partitionBy("shard", "bin", "_part").orderBy("_h", "doc_id", "_each").rowsBetween(W.unboundedPreceding, -1)
    laid = rows.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(starts, ["shard", "bin", "_part"])
    laid = laid.select("doc_id", F.col("_each").alias("size"), "text_crc32", "shard", "_n", (F.col("_at") + F.col("_before")).alias("_slot"))
    laid = materialize(laid, "shard-slots")
    few = laid.filter(F.col("_n") <= REPEATS).withColumn("_from", F.lit(0).cast("long"))
    # One row may stand for a third of all: its runs are dealt out before they are spread.
    many = laid.filter(F.col("_n") > REPEATS).withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {REPEATS}L)"))).repartition("doc_id", "_from")
    spread = F.explode(F.expr(f"sequence(_slot + _from, _slot + least(_n, _from + {REPEATS}) - 1)"))
    return few.unionByName(many).select("doc_id", "size", "text_crc32", "shard", spread.alias("slot"))
