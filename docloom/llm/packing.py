"""Variable-capacity best-fit packing of documents into sequences (operator 6).

Several sequence lengths are permitted.  A sequence of ``c`` tokens costs
``bin_cost + c + c * c / attention``: a fixed share, its length, and the part that
grows with the square of the length.  Documents are packed best-fit decreasing:
the longest piece first, each into the fullest open bin that holds it.  When none
does, a bin is opened.  Its size is chosen by the contents it can expect: for each
permitted size, the piece and, longest first, what is left of all lengths and
still fits; the size with the least cost per token of these contents wins, so long
bins are opened where long pieces need them or where their rests can be filled,
short ones elsewhere.  At the end every bin is downsized to the smallest permitted
size that holds its contents.

Pieces of equal length are interchangeable, so the packing is decided on the
histogram of lengths, at most ``max(capacities)`` counts whatever the table's
size: a group of equal bins takes as many pieces per bin as fit, as the bins one
after the other would.  The result is one rule per (length, range of ranks).
Pieces are then ranked inside their length by a distributed total order and
take their bin from the rules; no bin, length or source is gathered in a task.

A document longer than the largest capacity is cut into full pieces and a
rest.  The length is the number of words plus ``separator`` for each piece, or
any other column given by the caller.

Defined results: a very long text is cut into as many pieces as it needs; a null or
empty text has length 0 and is one piece of the
separator alone; repeated rows are packed each; ties go by key; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import with_row_index, words
from docloom.session import cut_lineage

CAPACITIES = (512, 1024, 2048, 4096)
SEPARATOR = 1
BIN_COST = 64
ATTENTION = 8192  # length at which the square part of the cost is as large as the length


def pieces(docs: DataFrame, capacities: Sequence[int], key: str = "doc_id", text: str = "text", length: Column | None = None, separator: int = SEPARATOR) -> DataFrame:
    """``(key, piece, start, stop, size)``: the parts of every document, in units of
    its length; ``size`` counts the separator."""
    room = max(capacities) - separator
    n = F.size(words(text)).cast("long") if length is None else F.coalesce(length.cast("long"), F.lit(0))
    rows = docs.select(F.col(key), n.alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / room) - 1, F.lit(0)).cast("long")
    rows = rows.select(key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * room
    stop = F.least(start + room, F.col("_n"))
    return rows.select(key, "piece", start.alias("start"), stop.alias("stop"), (stop - start + separator).alias("size"))


# ----------------------------------------------------------------------------------
# the packing plan, from the histogram


def cost(capacity: int, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    """What one sequence of ``capacity`` tokens costs."""
    return bin_cost + capacity + capacity * capacity / attention


def expected_fill(capacity: int, piece: int, count: int, lengths: Sequence[int], counts: Sequence[int]) -> int:
    """Contents of a new bin: as many of ``count`` pieces as fit, then, longest first,
    what fits of the shorter ``lengths`` (ascending, with ``counts``)."""
    room = capacity - min(count, capacity // piece) * piece
    at = len(lengths)
    while room and at:
        at = bisect.bisect_right(lengths, room, 0, at) - 1
        if at >= 0:
            room -= min(counts[at], room // lengths[at]) * lengths[at]
        at = max(at, 0)
    return capacity - room


def open_size(piece: int, count: int, lengths: Sequence[int], counts: Sequence[int], capacities: Sequence[int], bin_cost: float, attention: float) -> int:
    """Permitted size >= piece with the least cost per token it can expect to hold (ties: the smaller)."""
    fits = [c for c in sorted(capacities) if c >= piece]
    return min(fits, key=lambda c: (cost(c, bin_cost, attention) / expected_fill(c, piece, count, lengths, counts), c))


def plan(histogram: Sequence[tuple[int, int]], capacities: Sequence[int], bin_cost: float = BIN_COST, attention: float = ATTENTION) -> tuple[list[tuple], list[tuple]]:
    """``(rules, bins)`` from ``(size, count)``.

    A rule ``(size, rank, first_bin, per_bin, offset)`` says: from that rank on,
    pieces of that size go ``per_bin`` to a bin, starting with ``first_bin``, at
    ``offset`` in it.  ``bins`` lists ``(first, count, used, capacity)`` runs."""
    sizes = sorted((s, n) for s, n in histogram if n > 0)[::-1]
    shorter, of_shorter = [s for s, _ in sizes[::-1]], [n for _, n in sizes[::-1]]
    groups: dict[int, list[list[int]]] = {}  # room left -> runs [first bin, count, used]
    rooms: list[int] = []  # the keys of groups, ascending
    rules, done, next_bin = [], [], 0

    def put(room: int, run: list[int]) -> None:
        if room <= 0:
            done.append((*run, run[2]))
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        heapq.heappush(groups[room], run)  # of equal rooms, the bin opened first

    for size, count in sizes:
        rank = 0
        shorter.pop()
        of_shorter.pop()
        most = max(capacities) // size  # with so many left or more, the choice does not depend on how many
        while count:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # open bins for what is left, as many as the size needs
                capacity = open_size(size, count, shorter, of_shorter, capacities, bin_cost, attention)
                full = max(1, (count - most) // (capacity // size) + 1)
                first, room, used = next_bin, capacity, 0
                run = [first, full, used]
                next_bin += full
            else:
                room = rooms[at]
                run = heapq.heappop(groups[room])
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            first, bins, used = run
            per_bin = room // size
            full = min(bins, count // per_bin)
            if full:
                rules.append((size, rank, first, per_bin, used))
                put(room - per_bin * size, [first, full, used + per_bin * size])
                rank += full * per_bin
                count -= full * per_bin
            if full < bins:
                rest = [first + full, bins - full, used]
                if 0 < count < per_bin:  # the last bin takes what is left
                    rules.append((size, rank, rest[0], per_bin, used))
                    put(room - count * size, [rest[0], 1, used + count * size])
                    count = 0
                    rest = [rest[0] + 1, rest[1] - 1, used]
                if rest[1]:
                    put(room, rest)
    for runs in groups.values():
        done += [(*run, run[2]) for run in runs]
    allowed = sorted(capacities)
    bins = [(first, n, used, allowed[bisect.bisect_left(allowed, used)]) for first, n, used, _ in done if used]
    return rules, sorted(bins)


PACKED = "piece long, start long, stop long, size long, bin_id long, capacity int, offset long, bin_used long"


def pack(
    docs: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    key: str = "doc_id",
    text: str = "text",
    length: Column | None = None,
    separator: int = SEPARATOR,
    bin_cost: float = BIN_COST,
    attention: float = ATTENTION,
) -> DataFrame:
    """One row per piece: its document and part, its bin, the bin's (downsized)
    capacity and filled length, and the piece's offset in the bin."""
    if not capacities or min(capacities) <= separator:
        raise ValueError("every capacity must be larger than the separator")
    spark = docs.sparkSession
    parts = cut_lineage(pieces(docs, capacities, key, text, length, separator))
    histogram = [(int(r["size"]), int(r["n"])) for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    rules, bins = plan(histogram, capacities, bin_cost, attention)  # at most max(capacities) sizes
    before, total = {}, 0
    for size, n in sorted(histogram):
        before[size] = total
        total += n
    rules.sort(key=lambda r: before[r[0]] + r[1])
    rule_at = np.array([before[r[0]] + r[1] for r in rules], dtype=np.int64)
    rule_cols = np.array([r[2:] for r in rules], dtype=np.int64).reshape(-1, 3)
    bin_cols = np.array(bins, dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((rule_at, rule_cols, bin_cols))  # grows with the capacities, not the table
    key_field = docs.schema[key]
    ranked = with_row_index(parts, ["size", key, "piece"], "_rank")
    schema = T.StructType([key_field, *T._parse_datatype_string(PACKED).fields])

    def place(batches):
        at, cols, runs = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column(5).to_numpy().astype(np.int64)
            size = batch.column(4).to_numpy().astype(np.int64)
            rule = np.searchsorted(at, rank, side="right") - 1
            first, per_bin, used = cols[rule].T
            step = rank - at[rule]
            bin_id = first + step // per_bin
            run = np.searchsorted(runs[:, 0], bin_id, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(bin_id),
                    pa.array(runs[run, 3].astype(np.int32)),
                    pa.array(used + step % per_bin * size),
                    pa.array(runs[run, 2]),
                ],
                names=schema.names,
            )

    return ranked.select(key, "piece", "start", "stop", "size", "_rank").mapInArrow(place, schema)
