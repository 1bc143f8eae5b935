"""Phrase collocations by direct-address tiling (operator 13).

Phrases of 2 to 4 words that occur at least ``least`` times in a language are
scored by their weakest cut, phrases that live inside a longer one are dropped,
and each language keeps its best.

1. Texts are lower-cased, split and dictionary-coded in Arrow, a few megabytes to a
   chunk, of which a part of fixed size is held as strings at a time; a longer text is cut at a delimiter and looks ahead by the words a phrase
   may still need.  Every later step works on chunks of codes.
2. Words are counted over all chunks' dictionaries, and those that occur often enough
   for a candidate get an id by falling frequency.
3. Pairs (left id, right id) are counted in square tiles of ``TILE`` ids a side.  Since ids
   are frequency ranks, a few tiles at the origin are dense: those are counted by
   ``bincount`` into a direct-address table; all others as sorted coordinates.  The tiles
   are dealt to a fixed number of shares (those at the origin to shares of their own, in
   pieces) and tasks send one row per share: tiles grow with the square of the vocabulary,
   rows only with the pairs.  Shares are added up the same way.
4. Frequent pairs are ranked again and are the left ids of the next level: a triple is
   a pair and a word, a phrase of four a triple and a word.  A chunk asks for the ids of
   its own phrases share by share, one row per share; a bit table of fixed size keeps phrases that cannot be frequent
   out of it (a false positive costs a row, never a wrong count).

Every part of a frequent phrase is at least as frequent, so the levels hold every
count that a score needs.

Defined results: a null or empty text has no words; a null language is ``und``;
repeated rows count again; texts of any length are counted whole; ties go by the
contract's order down to the phrase; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import with_row_index
from docloom.session import cut_lineage

# Fixed values of the contract ---------------------------------------------------
LEAST = 30
MOST_WORDS = 4
SCALE = 2_000_000
TOP = 2000
INSIDE = (100, 80)
SEPARATORS = r".,;:!?\x0A-\x0D"
# ---------------------------------------------------------------------------------
CHUNK = 16 << 20  # bytes of text in one chunk
PART = 1 << 20  # bytes of text coded at once
TILE_BITS = 11
TILE = 1 << TILE_BITS
CELL_BITS = 2 * TILE_BITS
HEAD = 8  # tiles a side that may be dense; their cells are sent in pieces
PIECE_BITS = 17
DENSE = TILE * TILE // 16  # occurrences that make a tile dense
ROW_CELLS = 4096  # cells in one row
MERGE_CELLS = 1 << 18  # sparse cells added up at once
FEW = 64  # rows of cells made Python objects at once
BATCH_BYTES = "4m"  # an Arrow batch of cells or of coded chunks, one row at least
SHARES = 512  # shares that the tiles away from the origin are dealt to
SHARE_PLACES = 1 << 22  # places of the corpus for which there is a share when those would be more
COUNTED = 1 << 20  # pairs of a task counted at once, 8 bytes each
SHARE = 1 << 19  # places or cells for which arrays are made beside those held
FILTER_BITS = 25  # log2 of the bits of the fixed table of frequent phrases

_RUN = f"[{SEPARATORS}]+"
_DELIMITER = re.compile(f"[ \t{SEPARATORS}]")
_AHEAD = re.compile(f"(?:[ \t]+[^ \t{SEPARATORS}]+){{0,{MOST_WORDS - 1}}}")


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), dtype=kind) if n else np.zeros(0, kind)


def _pack_cells(code: np.ndarray) -> bytes:
    """Ascending cell codes by their steps."""
    return _pack(np.diff(code, prepend=0))


def _unpack_cells(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, np.int64), dtype=np.int64)


# ---------------------------------------------------------------------------------
# words


def code_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``(words, codes)``: the distinct words of the texts and the places they stand at, -1 where a piece ends.
    Strings of a part of the texts are held at a time, and 4 bytes a place of all."""
    parts = [_code_part(part) if whole else _open_end(*_code_part(part)) for part, whole in _parts(texts)]
    if len(parts) == 1:
        return parts[0]
    coded = pa.concat_arrays([words for words, _ in parts]).dictionary_encode()
    number, at = np.append(coded.indices.to_numpy(zero_copy_only=False), -1).astype(np.int32), 0
    for words, codes in parts:
        np.take(np.append(number[at : at + len(words)], np.int32(-1)), codes, out=codes, mode="wrap")  # -1 is the last one
        at += len(words)
    return coded.dictionary, np.concatenate([codes for _, codes in parts])


def _parts(texts: pa.Array):
    """``(texts, whole)``: at most ``PART`` bytes of texts each; a longer text is cut at delimiters, and only its last part is whole."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PART, side="right")))
        if int(ends[hi - 1]) - before > PART:
            text, done = texts[lo].as_py(), 0
            for part, _ in _segments(text, PART):
                done += len(part)
                yield pa.array([part]), done == len(text)
        else:
            yield texts.slice(lo, hi - lo), True
        lo = hi


def _open_end(words: pa.Array, codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What is cut off a text ends no piece."""
    return words, codes[:-1]


def _code_part(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``code_words`` of a part of the texts."""
    flat = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=_RUN, replacement=" . ")
    flat = pc.replace_substring(pc.binary_join_element_wise(flat, " .", ""), pattern="\t", replacement=" ")
    coded = pc.split_pattern(flat, pattern=" ").flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    # a delimiter is no word, so it can stand for the end of a piece
    is_word = ~np.isin(np.arange(len(words)), [pc.index(words, x).as_py() for x in (".", "")])
    number = np.where(is_word, np.cumsum(is_word) - 1, -1).astype(np.int32)
    empty = pc.index(words, "").as_py()
    return words.filter(pa.array(is_word)), number[codes[codes != empty]]


def _segments(text: str, size: int):
    """``(segment, words it may look ahead to)`` of a long text, cut at delimiters."""
    at = 0
    while at < len(text):
        cut = _DELIMITER.search(text, at + size)
        stop = cut.start() if cut else len(text)
        yield text[at:stop], _AHEAD.match(text, stop).group()
        at = stop


def _chunks(docs: DataFrame, lang: str, text: str, size: int) -> DataFrame:
    """``(chunk, lang, words, counts, own, n, codes)``: coded texts of one language; phrases start
    in the first ``own`` of ``n`` places."""

    def row(chunk, tongue, texts, ahead=""):
        words, codes = code_words(texts)
        own = len(codes)
        if ahead:  # the segment's last place ends a piece; the words it looks ahead to go there
            own -= 1
            words, codes = code_words(pa.array([texts[0].as_py() + ahead]))
        here = codes[:own]
        counts = np.bincount(here[here >= 0], minlength=len(words))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
        values = [[chunk], [tongue], *lists, [own], [len(codes)], [_pack(codes)]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(values, _CHUNK_ARROW)], schema=_CHUNK_ARROW)

    def run(batches):
        numbers = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            tongues, texts = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(texts):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
                if int(ends[hi - 1]) - before > size:  # one long text
                    for part, ahead in _segments(texts[lo].as_py(), size):
                        yield row(next(numbers), tongues[lo].as_py(), pa.array([part]), ahead)
                else:
                    of, which = texts.slice(lo, hi - lo), tongues.slice(lo, hi - lo).dictionary_encode()
                    for k, tongue in enumerate(which.dictionary.to_pylist()):
                        yield row(next(numbers), tongue, of.filter(pc.equal(which.indices, k)))
                lo = hi
            _give_back()

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _CHUNK)


_CHUNK = "chunk long, lang string, words array<string>, counts array<long>, own int, n int, codes binary"
_CHUNK_ARROW = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("own", pa.int32()), ("n", pa.int32()), ("codes", pa.binary())]
)


# ---------------------------------------------------------------------------------
# pairs in tiles


def count_cells(code: np.ndarray, across: int) -> tuple[np.ndarray, np.ndarray]:
    """``(code, n)`` of the pairs with these cell codes, by ascending code, tiles numbered ``across`` to a row:
    tiles near the origin that have enough pairs by a direct-address table, the others as sorted coordinates."""
    head, sizes = np.empty(len(code), np.int8), np.zeros(HEAD * HEAD + 1, np.int64)
    for part in _slices(len(code)):
        top, side = np.divmod(code[part] >> CELL_BITS, across)
        head[part] = np.where((top < HEAD) & (side < HEAD), top * HEAD + side, HEAD * HEAD)
        sizes += np.bincount(head[part], minlength=HEAD * HEAD + 1)
    dense = np.flatnonzero(sizes[:-1] >= DENSE)
    sparse, n = _runs(code[~np.isin(head, dense)])
    codes, counts, at = [], [], 0
    for t in dense:  # ascending, as their numbers are
        first = (t // HEAD * across + t % HEAD) << CELL_BITS
        table = np.bincount(code[head == t] - first, minlength=TILE * TILE)
        some = np.flatnonzero(table)
        cut = np.searchsorted(sparse, first)
        codes += [sparse[at:cut], some + first]
        counts += [n[at:cut], table[some]]
        at = cut
    return np.concatenate([*codes, sparse[at:]]), np.concatenate([*counts, n[at:]])


def tile_cells(left: np.ndarray, right: np.ndarray, across: int):
    """``(tile, cell, n)`` of the pairs, sorted: ``count_cells`` with tile and cell apart."""
    code, n = count_cells(_cell_codes(left, right, across), across)
    return code >> CELL_BITS, code & (TILE * TILE - 1), n


def _shares_of(code: np.ndarray, across: int, shares: int) -> np.ndarray:
    """The share that each cell is dealt to: a tile's, or that of a piece of a tile at the origin."""
    tile = code >> CELL_BITS
    top, side = np.divmod(tile, across)
    piece = (top * HEAD + side) << (CELL_BITS - PIECE_BITS) | (code & (TILE * TILE - 1)) >> PIECE_BITS
    mixed = (tile.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return np.where((top < HEAD) & (side < HEAD), shares + piece, (mixed % np.uint64(shares)).astype(np.int64))


def _cells_in_rows(code: np.ndarray, across: int, shares: int = SHARES, **values: np.ndarray):
    """``_share_rows`` of ascending codes, a bounded part of them at a time."""
    for part in _slices(len(code)):
        yield from _share_rows(code[part], across, shares, **{k: x[part] for k, x in values.items()})


def _share_rows(code: np.ndarray, across: int, shares: int, **values: np.ndarray):
    """Rows ``(share, first, size, cells, ...)`` of ascending codes, a row for the cells of many tiles; a value stands beside each cell."""
    share = _shares_of(code, across, shares)
    order = np.argsort(share, kind="stable")  # codes of a share stay ascending
    share, code, values = share[order], code[order], {k: x[order] for k, x in values.items()}
    starts = np.flatnonzero(np.diff(share, prepend=-1))
    sizes = np.diff(np.append(starts, len(code)))
    more = -(-sizes // ROW_CELLS)  # large shares take several rows
    starts = np.repeat(starts, more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)) * ROW_CELLS
    for lo in range(0, len(starts), 1 << 12):
        at = starts[lo : lo + (1 << 12)]
        end = starts[lo + len(at)] if lo + len(at) < len(starts) else len(code)
        spans = list(zip(at.tolist(), np.append(at[1:], end).tolist()))
        packed = [_pack_cells(code[a:b]) for a, b in spans]
        lists = [pa.array(packed)] + [pa.array([_pack(x[a:b]) for a, b in spans], pa.binary()) for x in values.values()]
        size = pa.array([b - a for a, b in spans], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(share[at]), pa.array(code[at]), size, *lists], names=["share", "first", "size", "cells", *values])


def add_up(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their total counts."""
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    del order
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    return cell[starts], np.add.reduceat(n, starts, dtype=np.int64)


def _merge(rows: DataFrame, across: int, shares: int, least: int) -> DataFrame:
    """``(left, right, f)`` of the pairs that occur ``least`` times or more."""

    def run(batches):
        codes, counts, size, held, most = [], [], 0, [], 4 * MERGE_CELLS

        def totals():
            """Sums of what is held; a code lies in one share."""
            code, n = np.concatenate(codes), np.concatenate(counts)
            codes.clear()
            counts.clear()
            if len(held) == 1 and held[0] >= shares and size >= DENSE >> CELL_BITS - PIECE_BITS:  # a piece of a tile at the origin
                first = code.min() >> PIECE_BITS << PIECE_BITS
                code -= first
                table = np.zeros(1 << PIECE_BITS, np.int64)
                np.add.at(table, code, n)
                some = np.flatnonzero(table)
                return some + first, table[some]
            return add_up(code, n)

        def out(code, n):
            code, n = code[n >= least], n[n >= least]
            cols = [*_pairs_of(code, across), n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["left", "right", "f"])

        for batch in _few(batches):
            for share, first, k, cell, n in zip(*(c.to_pylist() for c in batch.columns)):
                if not held or held[-1] != share:
                    if size >= MERGE_CELLS:
                        yield out(*totals())
                        codes, counts, size, held, most = [], [], 0, [], 4 * MERGE_CELLS
                    held.append(share)
                elif size >= most:  # a large share: codes before those of all rows to come have their sums
                    code, total = totals()
                    done = (code < first) | (_shares_of(code, across, shares) != share)
                    yield out(code[done], total[done])
                    codes, counts, held, size = [code[~done]], [total[~done]], [share], len(code) - done.sum()
                    most = max(4 * MERGE_CELLS, 2 * size)
                codes.append(_unpack_cells(cell, k))
                counts.append(_unpack(n, k, np.int32))
                size += k
        if held:
            yield out(*totals())

    rows = rows.repartition("share").sortWithinPartitions("share", "first")
    return rows.mapInArrow(run, "left long, right long, f long")


def _ranked(pairs: DataFrame) -> DataFrame:
    """``(id, left, right, f)``, ids by falling frequency."""
    order = ["_down", "left", "right"]
    return with_row_index(pairs.withColumn("_down", -F.col("f")), order, "id").select("id", "left", "right", "f")


# ---------------------------------------------------------------------------------
# phrases of the chunks


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bit_table(pairs: DataFrame) -> np.ndarray:
    """A bit for each frequent pair; 2^FILTER_BITS bits whatever the corpus (4 MB)."""

    def run(batches):
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], names=["w", "b"])

    words = pairs.select("left", "right").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    found = words.toArrow()  # at most one row per 32 bits
    table[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return table


def _starts(words: np.ndarray, syms: np.ndarray, first: int, stop: int, k: int) -> np.ndarray:
    """Places from ``first`` to ``stop`` where a phrase of ``k`` words goes on to a word, both its parts
    of k words frequent."""
    n = max(first, min(stop, len(words) - k))
    at = np.flatnonzero((syms[first:n] >= 0) & (words[first + k : n + k] >= 0)) + first
    return at if k == 1 else at[syms[at + 1] >= 0]


def _symbols(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids, and the ids of the phrases of ``k`` words by the place they start at."""
    words = _unpack(row["words"], row["n"], np.int32)
    if k == 1:
        return words, words.astype(np.int64)
    syms = np.full(len(words), -1, np.int64)
    syms[_unpack(row["at"], row["m"], np.int32)] = _unpack(row["ids"], row["m"], np.int64)
    return words, syms


@contextmanager
def _small_batches(spark):
    """Python tasks get Arrow batches of ``BATCH_BYTES``: a task, and its executor's JVM, hold a batch whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _few(batches):
    """Batches cut to ``FEW`` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, FEW):
            yield batch.slice(lo, FEW)
    _give_back()


def _rows(batches):
    """One row at a time: a row holds a whole chunk's codes."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.slice(r, 1).to_pylist()[0]
    _give_back()


def _give_back() -> None:
    """A worker lives on between tasks; what Arrow holds unused goes back to the system."""
    pa.default_memory_pool().release_unused()


def _word_ids(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(chunk, own, n, words, m, at, ids)``: chunks as word ids, -1 for words that are not frequent."""
    each = chunks.select("chunk", "lang", F.posexplode("words").alias("i", "word")).join(vocab.select("lang", "word", "id"), ["lang", "word"])
    lists = each.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("i", "id")).alias("found"))  # at most a chunk's words
    joined = chunks.join(lists, F.col("chunk") == F.col("of"), "left").select("chunk", "own", "n", "codes", F.size("words").alias("v"), "found.i", "found.id")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, own, n, codes, v = (batch.column(c)[r].as_py() for c in range(5))
                lut = np.full(v + 1, -1, np.int32)  # the last one stands for the end of a piece
                if batch.column(5)[r].is_valid:
                    lut[batch.column(5)[r].values.to_numpy()] = batch.column(6)[r].values.to_numpy()
                words = lut[_unpack(codes, n, np.int32)]
                yield pa.RecordBatch.from_pylist([dict(chunk=chunk, own=own, n=n, words=_pack(words), m=0, at=b"", ids=b"")], schema=_CODED_ARROW)
        _give_back()

    return joined.mapInArrow(run, _CODED)


_CODED = "chunk long, own int, n int, words binary, m int, at binary, ids binary"
_CODED_ARROW = pa.schema([("chunk", pa.int64()), ("own", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("m", pa.int32()), ("at", pa.binary()), ("ids", pa.binary())])


def _count_pairs(coded: DataFrame, k: int, n_words: int, least: int) -> DataFrame:
    """Frequent phrases of ``k`` + 1 words as ``(left, right, f)``."""
    across = (n_words >> TILE_BITS) + 1
    # a share's cells stay bounded; up to two billion places the number of shares is fixed
    shares = max(SHARES, (coded.agg(F.sum("own")).first()[0] or 0) // SHARE_PLACES)

    def counted(held):
        code = np.concatenate(held)
        held.clear()
        code, n = count_cells(code, across)
        return _cells_in_rows(code, across, shares, counts=n.astype(np.int32))

    def run(batches):
        held, size = [], 0  # a task's share is counted about a million at a time
        for row in _rows(batches):
            words, syms = _symbols(row, k)
            for part in _slices(row["own"]):
                at = _starts(words, syms, part.start, min(part.stop, row["own"]), k)
                held.append(_cell_codes(syms[at], words[at + k].astype(np.int64), across))
                size += len(at)
                if size >= COUNTED:
                    yield from counted(held)
                    size = 0
        if size:
            yield from counted(held)

    return _merge(coded.mapInArrow(run, "share long, first long, size int, cells binary, counts binary"), across, shares, least)


def _tiled(left: np.ndarray, right: np.ndarray, across: int):
    """``(order, tile, cell)`` of distinct pairs, sorted by tile and cell."""
    tile = (left >> TILE_BITS) * across + (right >> TILE_BITS)
    cell = ((left & (TILE - 1)) << TILE_BITS) | (right & (TILE - 1))
    order = np.lexsort((cell, tile))
    return order, tile[order], cell[order]


def _answers(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``(of, size, cells, ids)``: the asked cells that are known.  Rows of a share meet, its
    known cells first."""
    fields = [("of", pa.int64()), ("size", pa.int32()), ("cells", pa.binary()), ("ids", pa.binary())]

    def run(batches):
        share, cells, ids, parts = None, None, None, []
        for batch in _few(batches):
            out = []
            for at, of, k, packed, packed_ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at != share:
                    share, cells, ids, parts = at, None, None, []
                if of < 0:
                    parts.append((_unpack_cells(packed, k), _unpack(packed_ids, k, np.int64)))
                    continue
                if not parts:
                    continue
                if cells is None:
                    cells, ids = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(cells)
                    cells, ids = cells[order], ids[order]
                here = _unpack_cells(packed, k)
                place = np.minimum(np.searchsorted(cells, here), len(cells) - 1)
                hit = cells[place] == here
                if hit.any():
                    out.append((of, int(hit.sum()), _pack_cells(here[hit]), _pack(ids[place[hit]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    rows = known.unionByName(asked).repartition("share").sortWithinPartitions("share", "of")
    return rows.select("share", "of", "size", "cells", "ids").mapInArrow(run, "of long, size int, cells binary, ids binary")


def _next_level(coded: DataFrame, k: int, ranked: DataFrame, n_words: int) -> DataFrame:
    """The chunks with the ids of their phrases of ``k`` + 1 words."""
    across = (n_words >> TILE_BITS) + 1
    columns = coded.columns
    bits = coded.sparkSession.sparkContext.broadcast(_bit_table(ranked))  # of fixed size

    def places(row):
        words, syms = _symbols(row, k)
        found = [(np.zeros(0, np.int64),) * 3]
        for part in _slices(row["n"]):
            at = _starts(words, syms, part.start, min(part.stop, row["n"]), k)
            left, right = syms[at], words[at + k].astype(np.int64)
            slot = _slots(left, right)
            maybe = (bits.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
            found.append((at[maybe], left[maybe], right[maybe]))
        return words, *(np.concatenate(x) for x in zip(*found))

    def ask(batches):
        for row in _rows(batches):
            left, right = places(row)[2:]
            if len(left):
                code = _cell_codes(left, right, across)
                del left, right
                for part in _cells_in_rows(_distinct(code), across):
                    yield part.append_column("of", pa.array(np.full(part.num_rows, row["chunk"])))

    def tell(batches):
        for batch in batches:
            if batch.num_rows:
                ids, left, right = (batch.column(i).to_numpy() for i in range(3))
                code = _cell_codes(left, right, across)
                order = np.argsort(code)
                yield from _cells_in_rows(code[order], across, ids=ids[order])

    asked = coded.mapInArrow(ask, "share long, first long, size int, cells binary, of long")
    known = ranked.select("id", "left", "right").mapInArrow(tell, "share long, first long, size int, cells binary, ids binary")
    found = _answers(known.withColumn("of", F.lit(-1).cast("long")), asked.withColumn("ids", F.lit(None).cast("binary")))
    lists = found.groupBy("of").agg(F.collect_list(F.struct("size", "cells", "ids")).alias("found"))  # at most a chunk's places
    joined = coded.join(lists, F.col("chunk") == F.col("of")).select(*columns, "found")

    def answer(batches):
        for batch in batches:
            for r, row in enumerate(_rows([batch.select(columns)])):
                words, at, left, right = places(row)
                rows_found = batch.column("found")[r].values
                lens = rows_found.field(0).to_numpy()
                code = np.concatenate([_unpack_cells(x, n) for x, n in zip(rows_found.field(1).to_pylist(), lens)])
                ids = np.concatenate([_unpack(x, n, np.int64) for x, n in zip(rows_found.field(2).to_pylist(), lens)])
                ids = _look_up(left, right, *_pairs_of(code, across), ids)
                at, ids = at[ids >= 0], ids[ids >= 0]
                near = np.zeros(len(words) + 2 * MOST_WORDS, dtype=bool)  # words that a longer phrase can still use
                near[at + k + 1] = True
                words = np.where(near[: len(words)], words, np.int32(-1))
                yield pa.RecordBatch.from_pylist(
                    [{**row, "words": _pack(words), "m": len(at), "at": _pack(at.astype(np.int32)), "ids": _pack(ids)}], schema=_CODED_ARROW
                )

    return joined.mapInArrow(answer, _CODED)


def _cell_codes(left: np.ndarray, right: np.ndarray, across: int) -> np.ndarray:
    """Tile and cell of each pair in one number."""
    tile = (left >> TILE_BITS) * across + (right >> TILE_BITS)
    return (tile << CELL_BITS) | ((left & (TILE - 1)) << TILE_BITS) | (right & (TILE - 1))


def _pairs_of(code: np.ndarray, across: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``(left, right)`` of cell codes."""
    (top, side), cell = np.divmod(code >> CELL_BITS, across), code & (TILE * TILE - 1)
    return (top << TILE_BITS) | (cell >> TILE_BITS), (side << TILE_BITS) | (cell & (TILE - 1))


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and how often each occurs; ``code`` is sorted in place."""
    code.sort()
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    starts = np.flatnonzero(new)
    return code[starts], np.diff(starts, append=len(code))


def _distinct(code: np.ndarray) -> np.ndarray:
    """The distinct codes, ascending; ``code`` is sorted in place."""
    return _runs(code)[0]


def _slices(n: int):
    """Slices of ``SHARE`` that cover ``n``."""
    return (slice(lo, lo + SHARE) for lo in range(0, n, SHARE))


def _look_up(left, right, known_left, known_right, ids) -> np.ndarray:
    """The id of each pair, -1 where it is not known."""
    lefts, rank = np.unique(known_left, return_inverse=True)
    width = np.int64(max(int(known_right.max(initial=0)), int(right.max(initial=0))) + 1)
    key = rank * width + known_right
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    found = np.empty(len(left), np.int64)
    for part in _slices(len(left)):
        place = np.minimum(np.searchsorted(lefts, left[part]), len(lefts) - 1)
        want = place * width + right[part]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        found[part] = np.where((lefts[place] == left[part]) & (key[at] == want), ids[at], -1)
    return found


# ---------------------------------------------------------------------------------
# scores


def _cut(k: int, a: str, left: str, right: str) -> Column:
    """Score of the cut after ``k`` words; exact beyond 64 bits."""
    score = F.expr(f"cast({SCALE} as decimal(20,0)) * {a} div (cast({left} as decimal(20,0)) + {right})")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases."""
    chunks = cut_lineage(_chunks(docs, lang, text, chunk))
    counted = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", "x.words", "x.counts")
    vocabulary = cut_lineage(counted.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")))
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = vocabulary.filter(F.col("f") >= least).withColumn("_down", -F.col("f"))
    vocab = cut_lineage(with_row_index(frequent, ["_down", "lang", "word"], "id").select("id", "lang", "word", "f"))
    n_words = vocab.count()
    if n_words >= 1 << 31:
        raise ValueError("more frequent words than a 32-bit id can tell apart")

    levels = []
    with _small_batches(docs.sparkSession):
        coded = cut_lineage(_word_ids(chunks, vocab))
        for k in range(1, MOST_WORDS):
            levels.append(cut_lineage(_ranked(_count_pairs(coded, k, n_words, least))))
            if k + 1 < MOST_WORDS:
                coded = cut_lineage(_next_level(coded, k, levels[-1], n_words))
    two, three, four = levels

    word = lambda i: vocab.select(F.col("id").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 1 else []))
    said = lambda first, i: F.concat(F.col(first), F.lit(" "), F.col(f"word{i}")).alias("phrase")
    two = two.withColumnsRenamed({"left": "w1", "right": "w2", "f": "f12"}).join(word(1), "w1").join(word(2), "w2")
    two = cut_lineage(two.select("id", "lang", "w1", "w2", "f12", "f1", "f2", said("word1", 2)))
    pair = lambda i, j: two.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{j}"), F.col("f12").alias(f"f{i}{j}"))
    three = three.withColumnsRenamed({"left": "pair", "right": "w3", "f": "f123"}).join(
        two.select(F.col("id").alias("pair"), "lang", "w1", "w2", "f1", "f12", "phrase"), "pair"
    )
    three = three.join(word(3), "w3").join(pair(2, 3), ["w2", "w3"])
    three = cut_lineage(three.select("id", "lang", "w1", "w2", "w3", "f123", "f1", "f3", "f12", "f23", said("phrase", 3)))
    four = four.withColumnsRenamed({"left": "triple", "right": "w4", "f": "f1234"}).join(
        three.select(F.col("id").alias("triple"), "lang", "w1", "w2", "w3", "f1", "f12", "f123", "phrase"), "triple"
    )
    triple = three.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("f123").alias("f234"))
    four = four.join(word(4), "w4").join(pair(3, 4), ["w3", "w4"]).join(triple, ["w2", "w3", "w4"])
    four = cut_lineage(four.select("lang", "w1", "w2", "w3", "w4", "f1234", "f1", "f4", "f12", "f34", "f123", "f234", said("phrase", 4)))

    def scored(df, n, a, *cuts):
        best = F.array_min(F.array(*[_cut(i + 1, a, x, y) for i, (x, y) in enumerate(cuts)]))
        ids = F.array(*[F.col(f"w{i + 1}") for i in range(n)])
        return df.select("lang", ids.alias("ids"), "phrase", F.col(a).alias("a"), best.alias("best"))

    all_ = scored(two, 2, "f12", ("f1", "f2")).union(scored(three, 3, "f123", ("f1", "f23"), ("f12", "f3")))
    all_ = all_.union(scored(four, 4, "f1234", ("f1", "f234"), ("f12", "f34"), ("f123", "f4")))
    part = lambda df, a, *ws: df.select(F.array(*ws).alias("ids"), F.col(a).alias("longer"))
    parts = part(three, "f123", "w1", "w2").union(part(three, "f123", "w2", "w3"))
    for ws in (("w1", "w2"), ("w2", "w3"), ("w3", "w4"), ("w1", "w2", "w3"), ("w2", "w3", "w4")):
        parts = parts.union(part(four, "f1234", *ws))
    longest = parts.groupBy("ids").agg(F.max("longer").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    inside = F.coalesce(wide("longer", INSIDE[0]) >= wide("a", INSIDE[1]), F.lit(False))
    kept = all_.join(longest, "ids", "left").filter(~inside)
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
