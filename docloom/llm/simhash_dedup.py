"""SimHash near-duplicate groups by bit-sliced comparison (operator 1).

A document's fingerprint has bit i set when more than half of its shingle
hashes have it.  Documents whose fingerprints differ in at most ``radius``
bits are linked; a group is a connected component of links.

How the links are found
* Equal fingerprints are one node, so exact copies never meet each other.
* The 64 bits are cut into ``radius + 2`` blocks.  Two fingerprints within the
  radius agree in at least two whole blocks, so every such pair shares a
  bucket of at least one (block, block) table: no link is lost.
* A bucket is dealt into cells of at most about ``cell`` fingerprints and each
  pair of cells is one unit of work, so a hot bucket spreads over many tasks.
* Inside a unit the fingerprints stand vertically: 64 bit planes, one bit per
  lane, 64 lanes to a word.  For a query fingerprint the planes are compared
  one by one and a carry-save counter of three planes (saturating) counts the
  differing bits of 64 lanes at once; a (query, word) block whose lanes have
  all passed the radius is abandoned.
* A unit emits a spanning forest of its links, at most one edge per
  fingerprint, so a tight group of thousands emits thousands of edges and not
  millions.  Connectivity, and with it the group, is the same.

Defined results: a null or empty text, or one of white space only, has the
fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; repeated rows repeat their result; a null doc_id is
never a component's id unless the component has no other (then it is null).
Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import anti_join_ids, components
from docloom.session import cut_lineage

# Fixed values of the contract ---------------------------------------------------
SHINGLE_WORDS = 3
RADIUS = 3
HASH_SEED = 42
BITS = 64
# ---------------------------------------------------------------------------------
CELL = 1024  # fingerprints of a bucket compared against each other in one unit
SLICE_BLOCKS = 1 << 16  # (query, word) blocks compared at once in a task (a few MB)
HASH_BLOCK = 1 << 16  # shingles hashed at once

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def text_fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import xxhash

    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lens + 1) - 1
    n = max(1, len(parts) - shingle_words + 1)
    starts = (ends - lens)[:n].tolist()
    stops = ends[-n:].tolist()
    counts = np.zeros((8, 8), dtype=np.int64)
    for lo in range(0, n, HASH_BLOCK):
        cut = [joined[i:j] for i, j in zip(starts[lo : lo + HASH_BLOCK], stops[lo : lo + HASH_BLOCK])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(HASH_SEED)), np.uint64, len(cut))
        octets = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        counts += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * counts.ravel() > n).astype(np.uint64)  # byte k of a little-endian long holds bits 8k..8k+7
    return int((bits << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(key, fp)``: the fingerprint of every whole text as a signed bigint."""
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.fromiter(
                (text_fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------------------------
# links


def _block_masks(radius: int) -> list[int]:
    """Masks of the block pairs; ``radius + 2`` blocks of nearly equal width."""
    edges = np.linspace(0, BITS, radius + 3).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _comparison_units(nodes: DataFrame, radius: int, cell: int) -> DataFrame:
    """``(band, bucket, i, j, fp, side)``: buckets of at least two fingerprints, dealt
    into units.  Unit (i, i) holds cell i; unit (i, j) holds cells i and j."""
    bands = F.array(
        *[F.struct(F.lit(n).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for n, m in enumerate(_block_masks(radius))]
    )
    rows = nodes.select("fp", F.explode(bands).alias("b")).select("fp", "b.band", "b.bucket")
    sizes = rows.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    cells = F.ceil(F.col("size") / F.lit(cell)).cast("int")
    dealt = rows.join(sizes, ["band", "bucket"]).select(
        "band", "bucket", "fp", cells.alias("n"), F.pmod(F.xxhash64("fp"), cells).cast("int").alias("c")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return dealt.select("band", "bucket", "fp", "c", other.alias("o")).select(
        "band", "bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp"
    )


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words) vertical bit planes of uint64 ``values``, padded to whole words."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # (lanes, 64)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _surviving(values, planes, query, word, lanes, radius):
    """Lanes of the (query, word) blocks within ``radius``.  ``lanes`` marks the
    lanes that count.  Returns the blocks left and their lane masks."""
    width = int(radius + 1).bit_length()
    over = ~lanes
    counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(width)]
    for plane in range(BITS):
        ask = np.where((values[query] >> np.uint64(plane)) & np.uint64(1), _FULL, np.uint64(0))
        carry = planes[plane, word] ^ ask
        for k in range(width):  # carry-save add of one bit plane
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if plane % 4 == 3:
            over |= _above(counters, radius)
            alive = np.flatnonzero(over != _FULL)
            if len(alive) < len(query):  # abandon the blocks that are wholly over
                query, word, over = query[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
            if not len(query):
                break
    return query, word, ~over


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``: a bitwise comparison from the top plane."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], _FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n nodes by the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def group_links(values: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links of the groups ``values[starts[g]:starts[g+1]]``: for every
    value the index of the smallest value's place it is connected to."""
    n = len(values)
    planes = _planes(values)
    ends = np.append(starts[1:], n)
    label = np.arange(n)
    begin = np.repeat(starts, ends - starts)
    end = np.repeat(ends, ends - starts)
    place = np.arange(n)
    first, last = (place + 1) // 64, (end - 1) // 64  # only lanes after the query: each pair once
    blocks = np.where(place + 1 < end, last - first + 1, 0)
    total = np.cumsum(blocks)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + SLICE_BLOCKS, side="right")))
        count = blocks[lo:hi]
        query = np.repeat(place[lo:hi], count)
        word = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[lo:hi], count)
        from_lane = np.clip(query + 1 - word * 64, 0, 63).astype(np.uint64)
        to_lane = np.clip(end[query] - word * 64, 1, 64).astype(np.uint64)
        lanes = (_FULL << from_lane) & (_FULL >> (np.uint64(64) - to_lane))
        query, word, near = _surviving(values, planes, query, word, lanes, radius)
        if len(query):
            hits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hits)
            a, b = query[row], word[row] * 64 + lane
            label = _least_label(n, np.concatenate([place, a]), np.concatenate([label, b]))
        lo = hi
    del begin
    return label


def links(nodes: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints ``nodes (fp)``
    lying within ``radius`` of each other, directly or through others."""
    units = _comparison_units(nodes, radius, cell)
    by = ["band", "bucket", "i", "j"]
    units = units.repartition(*by).sortWithinPartitions(*by)

    def run(batches):
        held: list[np.ndarray] = []  # the columns of the unit that may go on in the next batch

        def links_of(cols):
            values = cols[4].view(np.uint64)
            change = np.flatnonzero((np.diff(np.stack(cols[:4]), axis=1) != 0).any(axis=0)) + 1
            label = group_links(values, np.concatenate(([0], change)), radius)
            odd = np.flatnonzero(label != np.arange(len(label)))
            if len(odd):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[4][odd]), pa.array(cols[4][label[odd]])], names=["a", "b"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.flatnonzero((np.diff(np.stack(cols[:4]), axis=1) != 0).any(axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from links_of([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]  # at most two cells
        if held:
            yield from links_of(held)

    return units.select(*by, "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    cell: int = CELL,
) -> DataFrame:
    """``(key, fp, component_id)`` for every row of ``docs``: its fingerprint and
    the smallest key of the documents reachable by links of at most ``radius``
    differing bits."""
    fps = cut_lineage(fingerprints(docs, key, text, shingle_words))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes.select("fp"), radius, cell))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = grouped.join(ids, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(key, "fp", "component_id")


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the
    smallest key.  A key on several rows is one document (it stays when any of
    its rows is its group's smallest); rows with a null key stay."""
    groups = near_duplicates(docs, key, text, **options)
    dropped = groups.groupBy(key).agg(F.max(F.col(key) == F.col("component_id")).alias("stays")).filter("not stays")
    return anti_join_ids(docs, dropped, key)
