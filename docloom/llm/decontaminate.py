"""Benchmark decontamination by SimHash windows (operator 10; DataFrame functions only).

A document contains a benchmark item when one of its windows of as many words
as the item has a weighted-shingle similarity of at least ``threshold``: the
sum of the smaller over the sum of the larger counts of their word shingles.

1. Both multisets of shingles, of ``w`` and ``m``, must share ``t (w + m) / (1 + t)``
   of them, so a window needs as many shingles that the benchmark has.  The
   document shingles are joined with the benchmark's (its size is checked before
   it is broadcast), and the hits of a document, positions and hashes only, give
   the starts of the windows that hold enough of them.
2. Every such window, and every item, gets a 64-bit SimHash: bitwise carry-save
   counters over the shingle hashes, compared with half their number.  A window's
   is taken over its hits: a shingle that no item has cannot be shared.
3. Fingerprints of the same size are joined by multi-index blocks: of 8 blocks
   two fingerprints within the radius differ by at most ``radius // 8`` bits in
   one, so an item is filed in each block under every value that near to its own,
   and none is missed.  A pair is taken at its first such block.
4. The exact weighted-shingle similarity decides.

At the threshold of 0.8 about 11 % of the shingles differ, which flips about 10
of the 64 bits with a deviation of 3 (7 where no item has the shingles that
differ); the default radius of 23 is more than four deviations away.

Words are lower-cased runs of letters and digits.  An item of fewer words than
a shingle is one shingle.  A document shorter than an item is one window.

Defined results: an item or document without a word matches nothing; null texts
have no word; a very long text is cut into shingles like any other, and only its
hits leave its row; repeated rows and ties give one row per (document id, item id)
with the best similarity and the earliest window; null ids are kept as they
are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import anti_join_ids
from docloom.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 23
BITS = 64
BLOCKS = 8
MAX_BROADCAST_SHINGLES = 1_000_000  # rows of the benchmark side that are broadcast at most
MAX_BROADCAST_FILED = 2_000_000  # rows of the block index that are broadcast at most


def _words(text: str) -> Column:
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def _shingle_hashes(word_col: str, k: int) -> Column:
    """64-bit hashes of the ``k``-word shingles of an array of words, in order, made by doubling:
    a hash of 2w words is the hash of two neighbouring hashes of w words."""
    m = F.greatest(F.size(word_col) - (k - 1), F.lit(0))

    def part(col, offset: int, extra: int) -> Column:
        return F.slice(col, F.lit(offset + 1), m + extra)

    if k == 1:
        return F.transform(part(word_col, 0, 0), lambda w: F.xxhash64(w))
    width, runs = 1, F.col(word_col)
    while 2 * width <= k:
        extra = k - 2 * width
        runs = F.zip_with(part(runs, 0, extra), part(runs, width, extra), lambda a, b: F.xxhash64(a, b))
        width *= 2
    for i in range(width, k):
        runs = F.zip_with(part(runs, 0, 0), part(word_col, i, 0), lambda h, w: F.xxhash64(h, w))
    return runs


def simhash(hashes: str, planes: int) -> Column:
    """SimHash of an array of hashes (repeats count): bit set where more than half
    have it.  ``planes`` bit planes count up to ``2**planes - 1`` hashes."""
    names = [f"p{i}" for i in range(planes)]
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])

    def add(planes_so_far, h):
        carry, new = h, []
        for n in names:
            new.append(planes_so_far[n].bitwiseXOR(carry).alias(n))
            carry = planes_so_far[n].bitwiseAND(carry)
        return F.struct(*new)

    half = F.floor(F.size(hashes) / 2).cast("long")

    def more_than_half(p):
        above, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for i in reversed(range(planes)):
            t = -F.shiftright(half, i).bitwiseAND(F.lit(1).cast("long"))  # all ones where the bit of half is set
            above = above.bitwiseOR(equal.bitwiseAND(p[names[i]]).bitwiseAND(F.bitwise_not(t)))
            equal = equal.bitwiseAND(F.bitwise_not(p[names[i]].bitwiseXOR(t)))
        return above

    return F.aggregate(F.col(hashes), zero, add, more_than_half)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _block_bits(radius: int) -> list[range]:
    """The bits of each block: ``BLOCKS`` blocks, fewer for a radius below that."""
    n = min(BLOCKS, radius + 1)
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [range(lo, hi) for lo, hi in zip(edges, edges[1:])]


def _block_masks(radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in bits)) for bits in _block_bits(radius)]


def _filed(fp: str, radius: int) -> Column:
    """One struct ``(block, value)`` for every value that an item is filed under."""
    blocks = _block_bits(radius)

    def places(i: int, bits: range, mask: int) -> Column:
        near = [c for n in range(radius // len(blocks) + 1) for c in itertools.combinations(bits, n)]
        flips = F.array(*[F.lit(_signed(sum(1 << b for b in flip))) for flip in near])
        own = F.col(fp).bitwiseAND(F.lit(mask))
        return F.transform(flips, lambda f: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(f).alias("value")))

    return F.concat(*[places(i, bits, mask) for i, (bits, mask) in enumerate(zip(blocks, _block_masks(radius)))])


def _overlap(a: str, b: str) -> Column:
    """Sum of the smaller counts of the hashes of two arrays."""
    both = F.array_intersect(a, b)
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        both,
        F.lit(0),
        lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return F.when(distinct, F.size(both)).otherwise(counted)


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``(item, n, k, m, hashes)``: size in words, words per shingle, shingles and their hashes."""
    rows = benchmark.select(F.col(item).alias("_item"), _words(text).alias("_w")).filter(F.size("_w") > 0)
    rows = rows.select("_item", "_w", F.size("_w").alias("n"), F.least(F.size("_w"), F.lit(k)).alias("k"))
    hashes = F.when(F.col("k") == k, _shingle_hashes("_w", k))
    for short in range(1, k):
        hashes = hashes.when(F.col("k") == short, _shingle_hashes("_w", short))
    return rows.select("_item", "n", "k", (F.col("n") - F.col("k") + 1).alias("m"), hashes.alias("_ih"))


def _hits(docs: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Positions and hashes of the documents' ``k``-word shingles that the benchmark
    has, one row per item size."""
    rows = docs.select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_row"), _words(text).alias("_w"))
    rows = rows.select("_doc", "_row", _shingle_hashes("_w", k).alias("_h"))
    # outer: an inner explode adds a filter on the array, pushed below the projection that makes it
    each = rows.select("_doc", "_row", F.size("_h").alias("_all"), F.posexplode_outer("_h").alias("_p", "_x"))
    hit = each.join(wanted.filter(F.col("k") == k), F.col("_x") == F.col("_s"))
    return hit.select("_doc", "_row", "n", "k", "m", "_all", "_p", "_x")


def _windows(hits: DataFrame, threshold: float) -> DataFrame:
    """Item-sized windows with as many hits as the threshold asks for, each once: a
    window belongs to its first hit.  ``_wh`` holds the hashes of its hits."""
    ids = ["_doc", "_row", "n", "k", "m", "_all"]
    # at most the text's own shingles; a repeated row adds none
    rows = hits.groupBy(*ids).agg(F.sort_array(F.collect_set(F.struct("_p", "_x"))).alias("_hit"))
    rows = rows.withColumn("_width", F.least("m", "_all"))  # a shorter document is one window
    needed = F.ceil((F.col("_width") + F.col("m")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    rows = rows.withColumn("_need", F.greatest(needed, F.lit(1)).cast("int")).filter("size(_hit) >= _need")

    def position(i):
        return F.get(F.col("_hit"), i)["_p"]

    def run(i):
        low = F.greatest(position(i + F.col("_need") - 1) - F.col("_width") + 1, F.coalesce(position(i - 1) + 1, F.lit(0)), F.lit(0))
        return F.struct(i.alias("at"), low.alias("low"), F.least(position(i), F.col("_all") - F.col("_width")).alias("high"))

    firsts = F.sequence(F.lit(0), F.greatest(F.size("_hit") - F.col("_need"), F.lit(0)))
    runs = F.filter(F.transform(firsts, run), lambda r: r["low"] <= r["high"])
    made = rows.select("*", F.explode_outer(runs).alias("_run")).filter("_run.low is not null")
    made = made.select("*", F.explode_outer(F.sequence("_run.low", "_run.high")).alias("_start"))
    inside = F.filter(F.slice("_hit", F.col("_run.at") + 1, F.col("_width")), lambda h: h["_p"] < F.col("_start") + F.col("_width"))
    return made.select("_doc", "n", "k", "m", "_width", "_start", F.transform(inside, lambda h: h["_x"]).alias("_wh"))


def candidates(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """The rows of ``windows (n, _fp, ...)`` with ``_no`` of the ``items (_no, n, _ifp)``
    of their size within the radius: each pair once, found in the block index."""
    masks, flips = _block_masks(radius), radius // len(_block_bits(radius))
    per_item = sum(math.comb(len(bits), i) for bits in _block_bits(radius) for i in range(flips + 1))
    filed = items.select("_no", F.col("n").alias("_in"), "_ifp", F.explode(_filed("_ifp", radius)).alias("_f"))
    filed = filed.select("_no", "_in", "_ifp", F.col("_f.block").alias("_iblock"), F.col("_f.value").alias("_ivalue"))
    if items.count() * per_item <= MAX_BROADCAST_FILED:
        filed = F.broadcast(filed)
    cut = [F.struct(F.lit(i).alias("block"), F.col("_fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)]
    asked = windows.select("*", F.explode(F.array(*cut)).alias("_b"))
    same = (F.col("n") == F.col("_in")) & (F.col("_b.block") == F.col("_iblock")) & (F.col("_b.value") == F.col("_ivalue"))
    differ = F.col("_fp").bitwiseXOR(F.col("_ifp"))
    first = F.coalesce(*[F.when(F.bit_count(differ.bitwiseAND(F.lit(m))) <= flips, F.lit(i)) for i, m in enumerate(masks)])
    pairs = asked.join(filed, same).filter((F.bit_count(differ) <= radius) & (first == F.col("_iblock")))
    return pairs.select(*windows.columns, "_no")


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """``(key, item, similarity, start_word, n_words)``: one row for every document and
    item it contains, with the best window."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    items = benchmark_items(benchmark, item, item_text, k)
    items = cut_lineage(items.withColumn("_no", F.monotonically_increasing_id()))
    wanted = items.select("n", "k", "m", F.explode("_ih").alias("_s")).distinct()
    about = items.agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("shingles"), F.max("m").alias("most"), F.collect_set("k").alias("ks")).first()
    small = (about["shingles"] or 0) <= MAX_BROADCAST_SHINGLES
    lengths = sorted(about["ks"] or [k])  # at most k values
    hits = None
    for length in lengths:
        part = _hits(docs, F.broadcast(wanted) if small else wanted, key, text, length)
        hits = part if hits is None else hits.unionByName(part)
    planes = max(1, int(about["most"] or 1).bit_length())
    # written: read below with a filter on the fingerprint, which would compute it twice
    windows = cut_lineage(_windows(hits, threshold).withColumn("_fp", simhash("_wh", planes)))
    pairs = candidates(windows, items.withColumn("_ifp", simhash("_ih", planes)), radius)
    about_item = items.select(F.col("_no").alias("_ino"), "_item", "_ih")
    near = pairs.join(F.broadcast(about_item) if small else about_item, F.col("_no") == F.col("_ino"))
    near = near.withColumn("_common", _overlap("_wh", "_ih"))
    similarity = F.col("_common") / (F.col("_width") + F.col("m") - F.col("_common"))
    found = near.withColumn("_sim", similarity).filter(F.col("_sim") >= threshold)
    best = found.groupBy("_doc", "_item").agg(
        F.max(F.struct(F.col("_sim").alias("s"), (-F.col("_start")).alias("at"), (F.col("_width") + F.col("k") - 1).alias("w"))).alias("_b")
    )
    return best.select(
        F.col("_doc").alias(key),
        F.col("_item").alias(item),
        F.round("_b.s", 9).alias("similarity"),
        (-F.col("_b.at")).cast("long").alias("start_word"),
        F.col("_b.w").cast("long").alias("n_words"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item (a null key stays)."""
    found = contaminations(docs, benchmark, key, text, **options)
    return anti_join_ids(docs, found.filter(F.col(key).isNotNull()).select(key).distinct(), key)
