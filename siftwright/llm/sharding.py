"""Sharding by minimax contiguous partition, with DataFrame operations only.

Rows with equal texts form one atomic group. Groups are put in the order of a text digest, and the order is cut
into contiguous shards so that the largest shard is as small as it can be. A capacity is feasible if greedy filling
needs no more shards than there are; the smallest one is found by binary search. Where a greedy shard ends
is a question about running sizes ("the last group that ends at or before x"). The driver answers it
from a digest of at most RESOLUTION intervals of the running size, and only intervals in which
an answer is still open are looked at again, RESOLUTION times finer. So neither groups nor rows come to the driver.

At the cuts the capacity leaves room; each shard takes the feasible cut nearest to an equal part of what is left.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import pin, text_or_empty

SHARDS = 16
RESOLUTION = 1 << 13
#: Parts that a group's rows are dealt to, so that a group with a third of all rows is no single task's.
SALTS = 256
GROUPS_PER_BUCKET, MAX_BUCKETS = 4096, 1 << 16


class Ends:
    """Running sizes at group ends, known as intervals that hold no other ends than their first and last."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups, self.total = groups, total
        self.known: list[int] = [0]
        self.open: set[tuple[int, int]] = set()
        if total:
            self.look([(0, total)])

    def look(self, spans: list[tuple[int, int]]) -> None:
        """Learn the ends in (low, high] of each span: all of them, or the outermost of each of many slices."""
        spans = sorted(set(spans))
        room = max(2, RESOLUTION // len(spans))
        slot = F.lit(None).cast("string")
        width = {s: max(1, -(-(s[1] - s[0]) // room)) for s in spans}
        for low, high in spans:
            inside = (F.col("end") > low) & (F.col("end") <= high)
            slot = F.when(inside, F.concat(F.lit(f"{low}:"), F.floor((F.col("end") - low - 1) / width[low, high]).cast("string"))).otherwise(slot)
        reach = (F.col("end") > min(s[0] for s in spans)) & (F.col("end") <= max(s[1] for s in spans))
        found = self.groups.filter(reach).groupBy(slot.alias("slot")).agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n")).filter("slot is not null").collect()
        self.open -= set(spans)
        for r in found:
            self.known += [r["low"], r["high"]]
            if r["n"] > 2:
                self.open.add((r["low"], r["high"]))
        self.known = sorted(set(self.known))

    def bounds(self, x: int) -> tuple[int, int]:
        """The last end at or before x lies between these two."""
        at = bisect.bisect_right(self.known, min(x, self.total)) - 1
        low = self.known[at]
        if at + 1 < len(self.known) and (low, self.known[at + 1]) in self.open:
            return low, min(x, self.known[at + 1] - 1)
        return low, low

    def before(self, x: int) -> int:
        """The last end at or before x, looked up if need be."""
        while True:
            low, high = self.bounds(x)
            if low == high:
                return low
            self.look([self._span(low)])

    def after(self, x: int) -> int:
        """The first end after x."""
        self.before(x)
        at = bisect.bisect_right(self.known, x)
        return self.known[min(at, len(self.known) - 1)]

    def _span(self, low: int) -> tuple[int, int]:
        return low, self.known[bisect.bisect_right(self.known, low)]

    def walk(self, capacity: int, shards: int, low: bool) -> tuple[bool, list[int]]:
        """Greedy filling with each open answer taken as low or as high as it may be; also which spans were open."""
        at, starts = 0, []
        for _ in range(shards):
            a, b = self.bounds(at + capacity)
            if a != b:
                starts.append(a)
            at = a if low else b
            if at >= self.total:
                break
        return at >= self.total, starts


def smallest_capacity(ends: Ends, shards: int) -> int:
    """Binary search between capacities known to fail and known to do, with closer looks until they meet."""
    bad, good = -(-ends.total // shards) - 1, ends.total
    while True:
        lo, hi = bad, good  # the least capacity that surely does
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ends.walk(mid, shards, True)[0] else (mid, hi)
        good = hi
        lo, hi = bad, good  # the greatest one that surely fails
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ends.walk(mid, shards, False)[0] else (mid, hi)
        bad = lo
        if good - bad <= 1:
            return good
        looks = set()
        for c in (bad + 1, (bad + good) // 2, good):
            for low in (True, False):
                looks |= set(ends.walk(c, shards, low)[1])
        ends.look([ends._span(x) for x in looks])


def cut_points(ends: Ends, shards: int) -> tuple[int, list[int]]:
    """The capacity and where each shard ends; shards may be empty when there are fewer groups."""
    if not ends.total:
        return 0, [0] * shards
    capacity = smallest_capacity(ends, shards)
    least = [ends.total]  # from the back: the earliest end that leaves no more than fits into the later shards
    for _ in range(shards - 1):
        x = least[-1] - capacity
        least.append(0 if x <= 0 else x if ends.before(x) == x else ends.after(x))
    least = least[::-1]
    at, cuts = 0, []
    for k in range(shards):
        want = at + -(-(ends.total - at) // (shards - k))
        below = ends.before(want)
        above = below if below == want else ends.after(want)
        pick = below if want - below <= above - want else above
        # a shard takes one group at least while there are any
        at = max(min(pick, ends.before(at + capacity)), least[k], ends.after(at))
        cuts.append(at)
    return capacity, cuts


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot, capacity) for every row of `docs`.

    size is the UTF-8 length plus 1, 1 for a null text. Equal texts stay together; null and empty texts are one
    group and crc32 of a null text is null. Slots count the rows of a shard from 0 in group and id order; among repeated rows the order
    does not matter. Extra columns are not read; an empty table gives no rows.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"),
    ).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = pin(rows)
    atoms = pin(rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    buckets = min(MAX_BUCKETS, max(1, atoms.count() // GROUPS_PER_BUCKET))
    # the first two bytes of a digest are evenly spread, so ranges of them hold equally many groups
    head = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    atoms = atoms.withColumn("bucket", F.floor(head * buckets / 65536).cast("int"))
    of_bucket = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = atoms.groupBy("bucket").agg(F.sum("n").alias("n_"), F.sum("bytes").alias("bytes_")).select(
        "bucket", F.coalesce(F.sum("n_").over(of_bucket), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes_").over(of_bucket), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("bucket").orderBy("digest", "salt").rowsBetween(Window.unboundedPreceding, 0)
    placed = atoms.withColumn("n_to", F.sum("n").over(inside)).withColumn("bytes_to", F.sum("bytes").over(inside))
    placed = pin(placed.join(F.broadcast(offsets), "bucket").select(
        "digest", "salt", (F.col("rows_before") + F.col("n_to") - F.col("n")).alias("row_from"), (F.col("bytes_before") + F.col("bytes_to")).alias("end"), "n"))
    groups = pin(placed.groupBy("digest").agg(F.max("end").alias("end"), F.max(F.col("row_from") + F.col("n")).alias("row_to")))
    total = groups.agg(F.max("end")).first()[0] or 0
    capacity, cuts = cut_points(Ends(groups.select("end"), total), shards)
    number = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        number = F.when(F.col("end") <= cuts[k], F.lit(k)).otherwise(number)
    sharded = groups.select("digest", "row_to", number.cast("int").alias("shard"))
    last = {r["shard"]: r["row_to"] for r in sharded.groupBy("shard").agg(F.max("row_to").alias("row_to")).collect()}  # one row per shard
    start, first = 0, []
    for k in range(shards):
        first.append(start)
        start = max(start, last.get(k, start))
    begin = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in first]), F.col("shard") + 1)
    where = placed.select("digest", "salt", "row_from").join(sharded.select("digest", "shard"), "digest")
    order = Window.partitionBy("digest", "salt").orderBy("id")
    numbered = rows.withColumn("nth", F.row_number().over(order) - 1)
    out = numbered.join(where, ["digest", "salt"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("row_from") + F.col("nth") - begin).cast("bigint").alias("slot"), F.lit(capacity).cast("bigint").alias("capacity"))
