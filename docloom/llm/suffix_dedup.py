"""Repeated-substring removal by merged Burrows-Wheeler transforms (operator 7).

Every byte covered by a ``length``-byte string that also starts earlier (in a
document of smaller id, or further left in the same one) is removed; strings
are judged on the input and never cross documents.

1. Each ``length``-byte window is assigned to its anchor, the ``GRAM``-byte gram
   of least hash in it (the leftmost one of several).  The choice depends on the
   window's bytes alone, so equal windows have equal anchors at equal offsets.
   The windows of one anchor occurrence are consecutive; their bytes are its
   context, and contexts are all that the next steps compare.
2. Occurrences meet by anchor.  Equal contexts are one string with a first
   occurrence; all others are repeats throughout and need no comparison.  Equality is told
   by a 124-bit polynomial hash whose bases are drawn for each run: whatever the texts hold,
   two different contexts are taken for one with a chance below 10^-27.  Repeats are
   combined in the map tasks already, so a third of all rows being copies
   is one row per task.  Anchors that occur once are dropped, and so are contexts that share
   neither the gram left of the anchor nor the one right of it with another context.
3. The distinct contexts of an anchor that has several are fetched and indexed: shards
   of contexts get their own Burrows-Wheeler transform, and the transforms are
   merged by iterative interleave refinement (Holt and McMillan, 2014): in round
   h the interleave of all suffixes is known to depth h; stepping every suffix
   back by its LF map and dealing stably by the character before gives depth
   h + 1.  Block borders mark where the common prefix ends, so after ``length``
   rounds the blocks are the repeated intervals of common prefix ``length`` or
   more.  Only suffixes that follow a window are taken, in blocks of those that lie alike about
   their anchor, and those alone in their block leave the rounds.  Nothing is sorted again.
4. In a block all but the earliest window are repeats.  Repeated runs are
   gathered per document and cut out.

An anchor with more than ``MAX_CONTEXTS`` such contexts is not one unit of work.  It goes
on in parts, contexts that share the gram on one side, each merged in the same way; what
is still too many after that shares 64 bytes and more, and is split down to whole windows, which are
dealt by their 128-bit digest and the earliest found by an aggregate with map-side combine.

A very long text is handled ``PIECE`` bytes at a time when it is scanned, and is held once when
its contexts are fetched and when its runs are cut out.

Defined results: a null or empty text, or one shorter than ``length``, loses
nothing; rows that repeat a doc_id are one document (a repeated row is judged
like its twin, not against it); null ids come after all others and are one
document; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import cut_lineage

LENGTH = 100  # fixed value of the contract
GRAM = 32
PIECE = 1 << 19  # bytes of text handled at once; windows overlap pieces, so nothing is lost at the seams
COMBINE = 1 << 18  # occurrences combined at once in a map task
SHARD_BYTES = 1 << 15  # contexts of one Burrows-Wheeler transform
MERGE_BYTES = 1 << 18  # contexts merged at once in a task (whole anchors)
MAX_CONTEXTS = 4096  # of an anchor, or of a part of it, that are merged in one task
MOST_HELD = 1 << 18  # contexts of one anchor that are sifted together
SHAPE_BITS = 15
NO_ID = (1 << 63) - 1  # stands for a null id

_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S = np.uint64


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes at every place (the last GRAM - 1 places left out)."""
    n = len(data) - GRAM + 1
    loads = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = loads[:n] * _MUL[0]
    for i in range(1, GRAM // 8):
        h ^= h >> _S(32)
        h += loads[8 * i : 8 * i + n]
        h *= _MUL[i]
    h ^= h >> _S(29)
    return h


def _anchored(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, key: tuple[int, ...]):
    """Anchor occurrences of the texts ``data[begins[i]:ends[i]]``: ``(anchor hash, two context
    hashes, hashes of the gram left and right of the anchor, first window, shape)`` per occurrence.
    A gram beyond the context is 0; the shape holds the anchor's offset and the number of windows."""
    none = (*[np.zeros(0, _S)] * 5, np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < length:
        return none
    h = _gram_hashes(data)
    places = _S(21)  # low bits hold the place, so the least key is the leftmost least hash
    low = (h >> places << places) | np.arange(len(h), dtype=_S)
    span, want = 1, length - GRAM + 1
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if want > span:
        low = np.minimum(low[: -(want - span)], low[want - span :])
    at = (low & ((_S(1) << places) - _S(1))).astype(np.int64)
    inside = np.zeros(len(at) + 2, dtype=bool)
    for a, b in zip(begins, ends):
        if b - a >= length:
            inside[a + 1 : b - length + 2] = True
    moved = np.concatenate(([True], at[1:] != at[:-1], [True]))
    here = inside[1:-1]
    first = np.flatnonzero(here & (moved[:-1] | ~inside[:-2]))
    last = np.flatnonzero(here & (moved[1:] | ~inside[2:]))
    if not len(first):
        return none
    stop, place = last + length, at[first]
    left, right = place - GRAM, place + GRAM
    beside = [
        np.where(left >= first, h[np.maximum(left, 0)] | _S(1), _S(0)),
        np.where(right + GRAM <= stop, h[np.minimum(right, len(h) - 1)] | _S(1), _S(0)),
    ]
    return h[place], *context_hashes(data, first, stop, key), *beside, first, (place - first) << SHAPE_BITS | (last - first + 1)


# Fixed value: the Mersenne prime of the context hashes
PRIME = (1 << 31) - 1
HASHES = 4


def draw_key() -> tuple[int, ...]:
    """Bases of the context hashes, drawn anew for each run."""
    return tuple(secrets.randbelow(PRIME - 2) + 2 for _ in range(HASHES))


@functools.lru_cache(maxsize=HASHES)  # workers live longer than a run's key
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse to the powers 0 to 2^bits - 1, modulo PRIME."""
    out = []
    for x in (base, pow(base, -1, PRIME)):
        table = np.ones(1, _S)
        for i in range(bits):
            table = np.concatenate((table, table * _S(pow(x, 1 << i, PRIME)) % _S(PRIME)))
        out.append(table.astype(np.uint32))
    return out[0], out[1]


def context_hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray, key: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """124-bit hashes of ``data[first:stop]`` as two longs: the polynomials of the bytes at the four
    bases of ``key``.  Two different contexts of n bytes at most are hashed alike by at most
    (n / 2^31)^4 of all keys, whatever their bytes, and the key is not known when the texts are."""
    one_up = data.astype(_S) + _S(1)  # so that no byte is without weight
    bits = max(PIECE.bit_length(), len(data).bit_length())  # one table for all pieces
    parts = []
    for base in key:
        power, inverse = _powers(base, bits)
        total = np.concatenate((np.zeros(1, _S), np.cumsum(one_up * power[: len(data)])))
        parts.append((total[stop] - total[first]) % _S(PRIME) * inverse[first] % _S(PRIME))
    return (parts[0] << _S(31)) | parts[1], (parts[2] << _S(31)) | parts[3]


ROW = "anchor long, c1 long, c2 long, left long, right long, doc long, start long, shape int, repeat boolean"


def _occurrences(docs: DataFrame, text: str, length: int, key: tuple[int, ...]) -> DataFrame:
    """Anchor occurrences of every whole text, combined within the task: ``repeat`` rows are
    known not to be the first of their context."""
    names = [f.split()[0] for f in ROW.split(", ")]

    def texts(batches):
        """``(doc, start in the document, bytes)`` pieces of at most about PIECE bytes."""
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (body.as_py() or "").encode("utf-8", "surrogatepass")
                for lo in range(0, max(1, len(data) - length + 1), PIECE):
                    part = data[lo : lo + PIECE + length - 1]
                    if len(part) >= length:
                        yield doc, lo, part

    def combined(parts):
        anchor, c1, c2, left, right, doc, start, shape = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, doc, c2, c1, anchor))
        cols = [x[order] for x in (anchor, c1, c2, left, right, doc, start, shape)]
        same = [cols[i][1:] == cols[i][:-1] for i in (0, 1, 2, 5, 6)]
        twin = np.concatenate(([False], np.all(same, axis=0)))  # the same place of a repeated row
        again = np.concatenate(([False], np.all(same[:3], axis=0)))[~twin]
        cols = [c[~twin] for c in cols]
        # a known repeat is not compared any more: spread it
        cols[0] = np.where(again, (cols[1] + cols[5].astype(_S) + cols[6].astype(_S)) * _MUL[0], cols[0])
        for lo in range(0, len(again), 1 << 16):
            c = [x[lo : lo + (1 << 16)] for x in cols]
            longs = [pa.array(x.view(np.int64)) for x in c[:7]]
            yield pa.RecordBatch.from_arrays(
                [*longs, pa.array(c[7].astype(np.int32)), pa.array(again[lo : lo + (1 << 16)])], names=names
            )

    def run(batches):
        held, n_held, parts, size = [], 0, [], 0

        def flush():
            data = np.frombuffer(b"".join(p[2] for p in parts) + bytes(GRAM), dtype=np.uint8)
            lens = np.array([len(p[2]) for p in parts])
            ends = np.cumsum(lens)
            begins = ends - lens
            *hashes, first, shape = _anchored(data, begins, ends, length, key)
            which = np.searchsorted(begins, first, side="right") - 1
            doc = np.array([p[0] for p in parts], dtype=np.int64)[which]
            start = first - begins[which] + np.array([p[1] for p in parts], dtype=np.int64)[which]
            return *hashes, doc, start, shape

        for part in texts(batches):
            if parts and size + len(part[2]) > PIECE:
                held.append(flush())
                n_held += len(held[-1][0])
                parts, size = [], 0
                if n_held >= COMBINE:
                    yield from combined(held)
                    held, n_held = [], 0
            parts.append(part)
            size += len(part[2])
        if parts:
            held.append(flush())
        if held:
            yield from combined(held)

    return docs.select("_doc", text).mapInArrow(run, ROW)


EVENT = "candidate boolean, anchor long, left long, right long, doc long, start long, size long, lead int"


def _near(anchor: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Contexts that share the gram beside their anchor with another one."""
    order = np.lexsort((beside, anchor))
    a, b = anchor[order], beside[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (b[1:] != 0)
    out = np.zeros(len(order), dtype=bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return out


def _meet(rows: DataFrame, length: int) -> DataFrame:
    """Occurrences by anchor: repeats of a context become removed runs; first occurrences
    of contexts that may share a window with another one become candidates.

    Windows shared by two contexts lie alike about the anchor, so they hold the
    gram left of it or the one right of it: contexts that share neither are left out."""
    names = [f.split()[0] for f in EVENT.split(", ")]

    def out(anchor, left, right, doc, start, shape, candidate=True):
        size = (shape & ((1 << SHAPE_BITS) - 1)).astype(np.int64) + (length - 1)
        cols = [np.full(len(doc), candidate), anchor, left, right, doc, start, size, (shape >> SHAPE_BITS).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def run(batches):
        before = None  # (anchor, c1, c2, doc, start) of the last row
        held = None  # first occurrences of the last anchor's contexts
        hot = None  # the anchor of which there are too many to hold: all its contexts are candidates

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            again = batch.column(8).to_numpy(zero_copy_only=False)
            if again.any():
                yield out(*(cols[i][again] for i in (0, 3, 4, 5, 6, 7)), candidate=False)
                cols = [c[~again] for c in cols]
            here = [cols[i] for i in (0, 1, 2, 5, 6)]
            if not len(here[0]):
                continue
            same = [np.concatenate(([before is not None and x[0] == b], x[1:] == x[:-1])) for x, b in zip(here, before or here)]
            before = tuple(x[-1] for x in here)
            twin = np.all(same, axis=0)  # the same place of a repeated row
            new = ~np.all(same[:3], axis=0)
            rest = ~new & ~twin
            if rest.any():
                yield out(*(cols[i][rest] for i in (0, 3, 4, 5, 6, 7)), candidate=False)
            firsts = [cols[i][new] for i in (0, 3, 4, 5, 6, 7)]
            firsts = firsts if held is None else [np.concatenate(x) for x in zip(held, firsts)]
            if not len(firsts[0]):
                continue
            last = firsts[0] == firsts[0][-1]
            if last.sum() > MOST_HELD:
                hot = firsts[0][-1]
            all_ = firsts[0] == hot if hot is not None else np.zeros(len(last), dtype=bool)
            some = all_ | (~last & (_near(firsts[0], firsts[1]) | _near(firsts[0], firsts[2])))
            if some.any():
                yield out(*(x[some] for x in firsts))
            held = [x[last & ~all_] for x in firsts]
        if held is not None:
            some = _near(held[0], held[1]) | _near(held[0], held[2])
            yield out(*(x[some] for x in held))

    order = ["anchor", "c1", "c2", "doc", "start"]
    return rows.repartition("anchor").sortWithinPartitions(*order).mapInArrow(run, EVENT)


# ---------------------------------------------------------------------------------
# Burrows-Wheeler transforms and their merge


def shard_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform of a few strings, each with a terminator of its own: the
    character before each sorted suffix (0 for the string's start), the LF map, and the
    suffix array (place in the strings laid end to end, one terminator each)."""
    text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    n = len(text)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    key = text.astype(np.int64) + len(strings)
    key[ends] = np.arange(len(strings))
    _, rank = np.unique(key, return_inverse=True)
    width = 1
    while True:  # prefix doubling; terminators are distinct, so it ends with the longest string
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] + 1
        both = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(both)
        step = np.concatenate(([0], (np.diff(both[order]) != 0).astype(np.int64)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            break
    previous = order - 1  # -1 at the very first place
    char = text[previous]
    is_start = np.zeros(n, dtype=bool)
    is_start[starts] = True
    lf = rank[previous]
    lf[is_start[order]] = -1
    return char, lf, order


def repeated_windows(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES, anchors=None, leads=None):
    """``(string, offset, block)`` of every window of ``length`` bytes that occurs at least twice
    in the strings; equal windows have equal blocks.  With each string's anchor and the anchor's offset,
    only windows that lie alike about equal anchors are brought together."""
    chars, lfs, places, base, at = [], [], [], 0, 0
    while at < len(strings):
        stop, size = at, 0
        while stop < len(strings) and (stop == at or size + len(strings[stop]) <= shard_bytes):
            size += len(strings[stop]) + 1
            stop += 1
        char, lf, order = shard_bwt(strings[at:stop])
        chars.append(char)
        lfs.append(np.where(lf < 0, -1, lf + base))
        places.append(order + base)
        base += len(order)
        at = stop
    char, lf, place = np.concatenate(chars), np.concatenate(lfs), np.concatenate(places)
    lens = np.array([len(s) for s in strings])
    begins = np.concatenate(([0], np.cumsum(lens + 1)))
    # rows of the shard transforms in merged order: the suffixes that windows end at, the only ones to grow into windows
    windows = np.maximum(0, lens - length + 1)
    string = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    row = np.empty(base, dtype=np.int64)
    row[place] = np.arange(base)
    src = row[begins[string] + offset + length]
    block = np.zeros(len(src), dtype=np.int64)
    if anchors is not None:
        anchor, lead = anchors[string], leads[string] - offset
        order = np.lexsort((lead, anchor))
        src, anchor, lead = src[order], anchor[order], lead[order]
        border = np.ones(len(src) + 1, dtype=bool)
        border[1:-1] = (anchor[1:] != anchor[:-1]) | (lead[1:] != lead[:-1])
        shared = ~(border[:-1] & border[1:])
        src, block = src[shared], np.cumsum(border[:-1])[shared]
    for _ in range(length):
        ahead = lf[src]
        alive = ahead >= 0  # at the start of its string a suffix cannot grow
        src, block = src[alive], block[alive]
        letter = char[src]
        deal = np.argsort(letter, kind="stable")
        src, block, letter = lf[src[deal]], block[deal], letter[deal]
        border = np.ones(len(src) + 1, dtype=bool)  # where the common prefix is shorter than the depth
        border[1:-1] = (letter[1:] != letter[:-1]) | (block[1:] != block[:-1])
        shared = ~(border[:-1] & border[1:])
        src, block = src[shared], np.cumsum(border[:-1])[shared]
        if not len(src):
            break
    where = place[src]
    string = np.searchsorted(begins, where, side="right") - 1
    return string, where - begins[string], block


def _later_runs(string, at, block, doc, start, length):
    """Runs ``(string, first, last + length)`` of windows that occur earlier elsewhere."""
    if not len(block):
        return string, at, at
    order = np.lexsort((start[string] + at, doc[string], block))
    string, at, block = string[order], at[order], block[order]
    spot, of = start[string] + at, doc[string]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], block[1:] != block[:-1])), np.arange(len(block)), 0))
    later = (of != of[first]) | (spot != spot[first])  # a context may come with both parts of its anchor
    string, at = string[later], at[later]
    order = np.lexsort((at, string))
    string, at = string[order], at[order]
    if not len(at):
        return string, at, at
    cut = (string[1:] != string[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.concatenate(([0], np.flatnonzero(cut) + 1))
    last = np.concatenate((np.flatnonzero(cut), [len(at) - 1]))
    return string[first], at[first], at[last] + length


CONTEXT = "anchor long, doc long, start long, body binary, lead int"
RUN = "doc long, start long, size long"


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Removed runs of the first occurrences, by merged transforms, whole anchors at a time."""

    def runs(cols):
        doc, start, strings = np.array(cols[1]), np.array(cols[2]), cols[3]
        string, at, block = repeated_windows(strings, length, anchors=np.array(cols[0]), leads=np.array(cols[4]))
        string, first, stop = _later_runs(string, at, block, doc, start, length)
        if len(string):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[string]), pa.array(start[string] + first), pa.array(stop - first)], names=["doc", "start", "size"]
            )

    def run(batches):
        held, size = [[], [], [], [], []], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= MERGE_BYTES and row[0] != held[0][-1]:
                    yield from runs(held)
                    held, size = [[], [], [], [], []], 0
                for col, x in zip(held, row):
                    col.append(x)
                size += len(row[3])
        if held[0]:
            yield from runs(held)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, RUN)


def _compare_large(contexts: DataFrame, length: int) -> DataFrame:
    """Removed runs of anchors with very many contexts: windows dealt by their digest."""

    def windows(batches):
        for batch in batches:
            for doc, start, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                n = len(body) - length + 1
                digests = b"".join(hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(n))
                halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([doc] * n, pa.int64()), pa.array(np.arange(start, start + n))],
                    names=["w1", "w2", "doc", "start"],
                )

    # a window may come from both parts of its anchor
    rows = cut_lineage(contexts.mapInArrow(windows, "w1 long, w2 long, doc long, start long").distinct())
    first = rows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = rows.join(first, ["w1", "w2"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return again.select("doc", "start", F.lit(length).cast("long").alias("size"))


def _fetch(texts: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """The bytes of the candidates, one pass over the documents that have some."""
    # at most the document's own anchors
    lists = wanted.groupBy(F.col("doc").alias("_of")).agg(F.collect_list(F.struct("anchor", "start", "size", "lead")).alias("_want"))
    joined = texts.join(lists, texts["_doc"] == lists["_of"]).select("_doc", text, "_want")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                doc, want = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["anchor"] for w in want], pa.int64()),
                        pa.array([doc] * len(want), pa.int64()),
                        pa.array([w["start"] for w in want], pa.int64()),
                        pa.array([data[w["start"] : w["start"] + w["size"]] for w in want], pa.binary()),
                        pa.array([w["lead"] for w in want], pa.int32()),
                    ],
                    names=["anchor", "doc", "start", "body", "lead"],
                )

    return joined.mapInArrow(run, CONTEXT)


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``(doc, start, size)``: byte runs covered by strings of ``length`` bytes that start
    earlier; they may overlap.  A null key is ``NO_ID``."""
    if not GRAM + 8 <= length < 1 << SHAPE_BITS:
        raise ValueError(f"length must be at least {GRAM + 8} and below {1 << SHAPE_BITS}")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_doc"), text)
    events = cut_lineage(_meet(_occurrences(texts, text, length, draw_key()), length))
    contexts, parts = events.filter("candidate"), []
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("gram")) for i, c in enumerate(("left", "right"))])
    # an anchor with too many contexts goes on in parts, by the gram left and the gram right of it
    for split in (True, False):
        many = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_contexts).select("anchor")
        many = cut_lineage(many)
        parts.append(_compare(_fetch(texts, contexts.join(many, "anchor", "left_anti"), text), length))
        if many.isEmpty():
            break
        contexts = contexts.join(many, "anchor", "left_semi")
        if split:
            by_side = contexts.select("*", F.explode(sides).alias("s")).filter("s.gram <> 0")
            contexts = by_side.withColumn("anchor", F.xxhash64("anchor", "s.i", "s.gram")).drop("s")
    else:  # parts that stay too many share 64 bytes and more: split on, down to whole windows
        parts.append(_compare_large(_fetch(texts, contexts, text), length))
    runs = events.filter("not candidate").select("doc", "start", "size")
    return functools.reduce(DataFrame.union, parts, runs)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept)`` for every row; ``kept`` are the remaining bytes."""
    runs = cut_lineage(repeated_runs(docs, key, text, length, **options))
    # at most the document's own anchors
    lists = runs.groupBy(F.col("doc").alias("_of")).agg(F.collect_list(F.struct("start", "size")).alias("_runs"))
    rows = docs.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_doc"), text)
    joined = rows.join(lists, rows["_doc"] == lists["_of"], "left").select(key, text, "_runs")
    schema = T.StructType(
        [docs.schema[key], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary").fields]
    )

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for body, cuts in zip(batch.column(1), batch.column(2)):
                data = (body.as_py() or "").encode("utf-8", "surrogatepass")
                left, at, removed, spans = [], 0, 0, 0
                end = -1
                for c in sorted((c["start"], c["start"] + c["size"]) for c in cuts.as_py() or []):
                    a, b = c[0], min(c[1], len(data))
                    if a > end:  # a maximal run begins
                        left.append(data[at:a])
                        spans += 1
                        removed += b - a
                        end = b
                    elif b > end:
                        removed += b - end
                        end = b
                    at = end
                left.append(data[at:])
                n_bytes.append(len(data))
                n_removed.append(removed)
                n_spans.append(spans)
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.binary())],
                names=schema.names,
            )

    return joined.mapInArrow(run, schema)
