"""Sharding by minimax contiguous partition.

Rows with one text are an atomic group.  Groups are ordered by their first document; the
shards are runs of groups, cut so that the largest shard is as small as can be.  Its size
is found by binary search: a capacity is feasible if filling shard after shard greedily
takes no more shards than there are.

A greedy step asks the running total of group sizes for its last value up to a limit.
That column stays in Spark.  The driver holds a bounded index of it: the least and the
greatest value of each of at most ``INDEX_CELLS`` cells.  With it a step is known to lie
between two values, so a capacity is known to be feasible, known to be not, or open.
While capacities are open, the cells that their steps can meet are divided again (one
aggregate a round, each round some thirty times finer), until the search is exact.

A group larger than the mean shard would leave other shards empty; such groups (fewer
than shards) come first in the order, each fills a shard, and the search deals out the
rest.  Slots number the rows of a shard in order: range partitions are numbered locally
and shifted by the counts of those before.  Only DataFrame functions are used.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickscope.llm.common import broadcast_checked, materialize

SHARDS = 40
ROW_BYTES = 16
INDEX_CELLS = 1 << 16


def _range_sorted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` stored in order: ``pid`` and, growing within it, ``mid``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("pid", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id()), name)


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` plus the total of ``value`` up to and with each row in ``order`` (a total
    order): local totals of range partitions plus the sums of those before."""
    stored = _range_sorted(df, order, "ordered")
    sums = stored.groupBy("pid").agg(F.sum(value).alias("s"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shifts = materialize(sums.select("pid", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift")), "shifts")
    local = Window.partitionBy("pid").orderBy("mid")  # a range partition is a task's share
    return (stored.withColumn("local", F.sum(value).over(local)).join(broadcast_checked(shifts), "pid")
            .withColumn(out, F.col("local") + F.col("shift")).drop("pid", "mid", "local", "shift"))


class Index:
    """What is known of an ascending column: cells (least, greatest, number of values)."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.starts = [c[0] for c in self.cells]

    def last(self, x: int, sure: bool) -> int:
        """Greatest value <= x: a value known to be there, or (not ``sure``) the greatest it
        could be.  0 if there is none."""
        k = bisect_right(self.starts, x) - 1
        if k < 0:
            return 0
        least, greatest, n = self.cells[k]
        if greatest <= x:
            return greatest
        return least if sure or n == 2 else x

    def greedy(self, capacity: int, shards: int, sure: bool) -> list[int]:
        """The running totals at which shards end, at most one more than ``shards``."""
        ends, total = [], self.cells[-1][1]
        while (not ends or ends[-1] < total) and len(ends) <= shards:
            now = self.last((ends[-1] if ends else 0) + capacity, sure)
            if now <= (ends[-1] if ends else 0):
                return ends + [-1] * (shards + 1)  # a group does not fit
            ends.append(now)
        return ends

    def bounds(self, shards: int, low: int) -> tuple[int, int]:
        """(greatest capacity known to be infeasible, least known to be feasible); ``low``
        is infeasible."""
        out = []
        for sure in (False, True):
            bad, good = low, self.cells[-1][1]
            while good - bad > 1:
                mid = (bad + good) // 2
                if len(self.greedy(mid, shards, sure)) <= shards:
                    good = mid
                else:
                    bad = mid
            out.append(bad if not sure else good)
        return out[0], out[1]

    def windows(self, shards: int, bad: int, good: int) -> list[tuple[int, int]]:
        """The spans of cells that a greedy step of an open capacity can meet."""
        slow, fast = self.greedy(bad + 1, shards, True), self.greedy(good, shards, False)
        spans, last = [], self.cells[-1][1]
        for k in range(shards):
            a = (slow[k - 1] if k and k <= len(slow) else 0 if not k else last) + bad + 1
            b = (fast[k - 1] if k and k <= len(fast) else 0 if not k else last) + good
            i, j = bisect_right(self.starts, min(a, last)) - 1, bisect_right(self.starts, min(b, last)) - 1
            for x in range(max(i, 0), j + 1):
                if self.cells[x][2] > 2 and self.cells[x][0] < self.cells[x][1]:
                    spans.append((self.cells[x][0], self.cells[x][1]))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(set(spans)):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged


def _cells(totals: DataFrame, col: str, spans: list[tuple[int, int]], cells: int) -> list[tuple[int, int, int]]:
    """At most some ``cells`` cells of the values within ``spans``."""
    # equal shares of the cells; two cells at least, so that every round divides
    widths = [max(1, min(-(-(b - a + 1) * len(spans) // cells), (b - a + 2) // 2)) for a, b in spans]
    v, which = F.col(col), None
    for (a, b), w in zip(spans, widths):
        cell = F.struct(F.lit(a).alias("a"), F.floor((v - a) / w).alias("c"))
        which = F.when(v.between(a, b), cell) if which is None else which.when(v.between(a, b), cell)
    found = totals.select(which.alias("cell"), v.alias("v")).where("cell IS NOT NULL").groupBy("cell").agg(
        F.min("v").alias("x"), F.max("v").alias("y"), F.count(F.lit(1)).alias("n"))
    return [(r["x"], r["y"], r["n"]) for r in found.select("x", "y", "n").collect()]


def minimax_cuts(totals: DataFrame, col: str, shards: int, largest: int, cells: int = INDEX_CELLS) -> list[int]:
    """The values of the ascending column at which shards end, the last left out, for the
    least possible largest shard.  ``largest``: the largest group (a capacity's floor)."""
    top = totals.agg(F.max(col)).first()[0]
    if top is None or shards < 2:
        return []
    index = Index(_cells(totals, col, [(1, top)], cells))
    low = max(largest, -(-top // shards)) - 1
    while True:
        bad, good = index.bounds(shards, low)
        spans = index.windows(shards, bad, good) if good - bad > 1 else []
        if not spans:
            return index.greedy(good, shards, True)[:-1]
        outside = [c for c in index.cells if not any(a <= c[0] and c[1] <= b for a, b in spans)]
        index = Index(outside + _cells(totals, col, spans, cells))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    cells: int = INDEX_CELLS) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` for each row of ``df``.

    Size: UTF-8 bytes plus 16.  ``law`` is ``bytes``: shards are nearly equal in size,
    and rows with one text share a shard.  A null text is a text of no bytes (and one
    group with the empty text); null ids come last; repeated rows take a slot each; fewer
    groups than shards leave shards empty; an empty table gives an empty one."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = materialize(df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.sha2(text, 256).alias("key"), F.monotonically_increasing_id().alias("row")), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    groups = materialize(rows.groupBy("key").agg(first, F.sum("size").alias("bytes")), "groups")
    # groups that fill a shard of their own: those over the mean of what is left
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    giants, left = [], shards
    for r in groups.orderBy(F.desc("bytes"), "first").limit(shards - 1).collect():  # a row a shard at most
        if r["bytes"] * left <= total or left < 2:
            break
        giants.append(r["key"])
        total, left = total - r["bytes"], left - 1
    rank = F.array_position(F.array(*map(F.lit, giants)), F.col("key")) if giants else F.lit(0)
    dealt = groups.where(rank == 0)
    sums = materialize(running_total(dealt.select("key", "first", "bytes"), ["first"], "bytes", "total"), "totals")
    largest = sums.agg(F.max("bytes")).first()[0]
    cuts = minimax_cuts(sums, "total", left, largest, cells) if largest else []
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("total"))) if cuts else F.lit(0)
    placed = sums.select("key", "first", (shard + len(giants)).cast("int").alias("shard"))
    if giants:
        placed = placed.unionAll(groups.where(rank > 0).select("key", "first", (rank - 1).cast("int").alias("shard")))
    placed = materialize(placed, "placed")
    of_row = materialize(rows.join(placed, "key").select("id", "size", "crc", "shard", "first", F.col("id").isNull().alias("last"), "row"), "of_row")
    # a group's rows are together; a large group is many range partitions
    ordered = _range_sorted(of_row, ["shard", "first", "last", "id", "row"], "slots")
    counts = ordered.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("low"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # partitions and shards only
    shifts = materialize(counts.select("shard", "pid", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift")), "slot_shifts")
    return ordered.join(broadcast_checked(shifts), ["shard", "pid"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("mid") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
