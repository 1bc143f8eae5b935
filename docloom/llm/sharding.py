"""Minimax contiguous sharding (operator 4).

Rows with equal texts form an atomic group.  The groups stand in the order of
their smallest key, and the smallest shard capacity is sought that lets them be
cut into at most ``shards`` contiguous runs: binary search over the capacity,
each capacity checked greedily (every shard takes groups until the next does not
fit).

The driver never sees the groups.  It holds group ends (running totals of
bytes) at a limited resolution, ``MAX_BLOCKS`` per round: a first round over all
of them, then rounds over the few ranges in which a greedy cut can fall.  A
capacity is surely feasible when the known ends alone suffice, surely not when
even a cut anywhere in the unknown ranges does not; the rounds end when both
searches give the same capacity, which is then exact.

The cuts are made under that capacity, each as near to an even share of what is
left as the capacity allows in front and behind, so that an oversized group
does not leave other shards empty.

Sizes are UTF-8 bytes plus one, and ``slot`` numbers the rows of a shard without
gaps, from a distributed total order, so neither a shard nor a hot group is
gathered in a task.

Defined results: a null text counts as empty; null keys come last; repeated rows
are rows of their group; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import with_row_index
from docloom.session import cut_lineage

SHARDS = 16
MAX_BLOCKS = 16_384


class GroupEnds:
    """Running totals at which groups end, known as closely as asked for.

    ``ends[i]`` are known ends; ``whole[i]`` says that no other end lies between
    ``ends[i]`` and ``ends[i + 1]``."""

    def __init__(self, table: DataFrame, total: int, max_blocks: int = MAX_BLOCKS):
        self.table, self.total, self.max_blocks = table, total, max_blocks
        self.ends, self.whole = [0, total], [False]
        self.refine([(0, total)])

    def gap(self, x: int) -> int:
        return min(max(bisect_right(self.ends, x) - 1, 0), len(self.whole) - 1)

    def refine(self, gaps: list[tuple[int, int]]) -> None:
        """Look closer into the given gaps between known ends, in one job."""
        width = max(1, sum(b - a for a, b in gaps) // self.max_blocks)
        end = F.col("end")
        which = F.coalesce(*[F.when((end > a) & (end < b), F.lit(i)) for i, (a, b) in enumerate(gaps)])
        rows = (
            self.table.filter((end > gaps[0][0]) & (end < gaps[-1][1]))
            .withColumn("gap", which)
            .filter("gap is not null")
            .groupBy("gap", F.floor(end / width).alias("block"))
            .agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n"))
            .collect()
        )  # at most max_blocks rows and two more per gap
        found: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r["low"]):
            found.setdefault(r["gap"], []).append((int(r["low"]), int(r["high"]), r["n"] <= 2))
        ends, whole = [], []
        asked = {a: i for i, (a, _) in enumerate(gaps)}
        for i, end in enumerate(self.ends):
            ends.append(end)
            if i == len(self.whole):
                break
            if end not in asked:
                whole.append(self.whole[i])
                continue
            for low, high, complete in found.get(asked[end], []):
                whole.append(True)  # nothing between two blocks that have ends
                ends.append(low)
                if high > low:
                    whole.append(complete)
                    ends.append(high)
            whole.append(True)
        self.ends, self.whole = ends, whole

    def floor_bounds(self, x: int) -> tuple[int, int]:
        """Lower and upper bound of the greatest end <= x."""
        if x >= self.total:
            return self.total, self.total
        i = self.gap(x)
        return self.ends[i], self.ends[i] if self.whole[i] else x

    def _settle(self, x: int) -> int:
        while not self.whole[i := self.gap(x)] and self.ends[i] != x:
            self.refine([(self.ends[i], self.ends[i + 1])])
        return self.gap(x)

    def floor(self, x: int) -> int:
        """The greatest end <= x."""
        if x >= self.total:
            return self.total
        i = self._settle(x)  # may replace self.ends
        return self.ends[i]

    def ceil(self, x: int) -> int:
        """The smallest end >= x."""
        if x <= 0:
            return 0
        i = self._settle(x)
        return self.ends[i] if self.ends[i] == x else self.ends[i + 1]


def _greedy(ends: GroupEnds, capacity: int, shards: int, upper: bool) -> list[int]:
    """Positions after each shard by known ends only, or (``upper``) at best."""
    at, cuts = 0, []
    for _ in range(shards):
        at = ends.floor_bounds(at + capacity)[1 if upper else 0]
        cuts.append(at)
    return cuts


def _least_capacity(ends: GroupEnds, low: int, shards: int, upper: bool) -> int:
    high = ends.total
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, mid, shards, upper)[-1] >= ends.total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_capacity(ends: GroupEnds, largest: int, shards: int) -> int:
    """Smallest capacity for which the greedy check needs at most ``shards`` runs."""
    low = max(largest, -(-ends.total // shards))
    while True:
        least, sure = _least_capacity(ends, low, shards, True), _least_capacity(ends, low, shards, False)
        if least == sure:
            return sure
        near, far = [0, *_greedy(ends, least, shards, False)], [0, *_greedy(ends, sure, shards, True)]
        open_gaps = set()
        for a, b in zip(near, far[:-1]):
            for i in range(ends.gap(a + least), ends.gap(min(b + sure, ends.total)) + 1):
                if not ends.whole[i]:
                    open_gaps.add((ends.ends[i], ends.ends[i + 1]))
        ends.refine(sorted(open_gaps))


def balanced_cuts(ends: GroupEnds, capacity: int, shards: int) -> list[int]:
    """``shards - 1`` ends to cut at, no shard over ``capacity``, sizes as even as the groups allow."""
    behind = [ends.total] * (shards + 1)
    for j in range(shards - 1, 0, -1):  # the earliest cut that leaves a feasible rest
        behind[j] = ends.ceil(behind[j + 1] - capacity)
    at, cuts = 0, []
    for j in range(1, shards):
        share = at + (ends.total - at) / (shards - j + 1)
        below = ends.floor(int(share))
        above = ends.ceil(int(-(-share // 1)))
        nearest = below if share - below <= above - share else above
        at = min(max(nearest, behind[j], at), max(ends.floor(at + capacity), behind[j]))
        cuts.append(at)
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)`` for every row of ``docs``."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = cut_lineage(
        docs.select(
            key, (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("_g")
        )
    )
    first = rows.groupBy("_g").agg(F.min(key).alias("_first"))
    placed = cut_lineage(rows.join(first, "_g").select(key, "size", "text_crc32", "_g", "_first"))
    indexed = cut_lineage(with_row_index(placed, ["_first", "_g", key], "_row", {"_end": "size"}))
    groups = indexed.groupBy("_g").agg(F.max("_end").alias("end"), F.sum("size").alias("bytes"))
    groups = cut_lineage(groups.sortWithinPartitions("end"))  # lookups by a range of ends skip row groups
    about = groups.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
    cuts: list[int] = []
    if about["total"]:
        ends = GroupEnds(groups, int(about["total"]), max_blocks)
        cuts = balanced_cuts(ends, minimax_capacity(ends, int(about["largest"]), shards), shards)
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(F.col("_end") > cut, 1).otherwise(0)
    out = indexed.withColumn("shard", number.cast("int"))
    begins = out.groupBy("shard").agg(F.min("_row").alias("_begin"))  # a row per shard
    out = out.join(F.broadcast(begins), "shard")
    return out.select(key, "size", "text_crc32", "shard", (F.col("_row") - F.col("_begin")).alias("slot"))
