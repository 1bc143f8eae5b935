"""Chunking jobs (P5-P9): documents -> overlapping chunks -> keyed chunk rows.

Two chunkers share one output shape, ``chunked struct<chunked_text
array<string>, chunker_status string>`` per document:

* ``windows``: fixed character windows, a native ``sequence``/``substring``
  expression (no Python, stays in code generation).
* ``recursive``: separators tried in order, greedy packing with overlap.  It
  runs as one Arrow-batched ``mapInArrow`` node over the partitions.

Neither shuffles: chunking is a narrow, per-row map.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import chunk_key

# Separators tried in order; "" cuts between characters.
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")
DEFAULT_CHUNK_SIZE = 1024
DEFAULT_CHUNK_OVERLAP = 512
SUCCESS = "SUCCESS"

CHUNKED_TYPE = T.StructType(
    [
        T.StructField("chunked_text", T.ArrayType(T.StringType()), True),
        T.StructField("chunker_status", T.StringType(), True),
    ]
)


def check_chunk_params(size: int, overlap: int) -> None:
    """Reject impossible settings on the driver, before any job starts."""
    if size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    if overlap < 0 or overlap >= size:
        raise ValueError(f"chunk overlap must be in [0, size), got {overlap} for size {size}")


# --------------------------------------------------------------------------
# Length units


def char_length(text: str) -> int:
    return len(text)


def word_length(text: str) -> int:
    """Whitespace-separated words."""
    return len(text.split())


LENGTH_UNITS: dict[str, Callable[[str], int]] = {"chars": char_length, "words": word_length}


# --------------------------------------------------------------------------
# Recursive splitter: a small per-document helper, run inside Arrow tasks.


def _split_keep(text: str, sep: str, offset: int) -> list[tuple[int, str]]:
    """Split on ``sep``; the separator starts the following piece.  Pieces
    carry their offset in the whole text."""
    if sep == "":
        return [(offset + i, ch) for i, ch in enumerate(text)]
    out, pos = [], offset
    for i, part in enumerate(text.split(sep)):
        piece = part if i == 0 else sep + part
        out.append((pos, piece))
        pos += len(piece)
    return out


def _pieces(text: str, offset: int, separators: Sequence[str], size: int, length) -> list[tuple[int, str]]:
    for i, sep in enumerate(separators):
        if sep == "" or sep in text:
            chosen, rest = sep, separators[i + 1 :]
            break
    else:  # no separator occurs and "" is absent: the text is one piece
        return [(offset, text)]
    out: list[tuple[int, str]] = []
    for start, part in _split_keep(text, chosen, offset):
        if not part:
            continue
        if length(part) > size and rest:
            out.extend(_pieces(part, start, rest, size, length))
        else:
            out.append((start, part))
    return out


def _pack(pieces: list[tuple[int, str]], size: int, overlap: int, length) -> list[tuple[int, int]]:
    """Greedy packing; returns (start, end) spans of the chunks."""
    spans: list[tuple[int, int]] = []
    window: deque[tuple[int, int, int]] = deque()  # (start, end, length)
    total = 0
    for start, piece in pieces:
        n = length(piece)
        if window and total + n > size:
            spans.append((window[0][0], window[-1][1]))
            # keep the longest suffix that fits the overlap and leaves room
            while window and (total > overlap or total + n > size):
                total -= window.popleft()[2]
        window.append((start, start + len(piece), n))
        total += n
    if window:
        spans.append((window[0][0], window[-1][1]))
    return spans


def split_recursive_spans(
    text: str | None,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    separators: Sequence[str] = DEFAULT_SEPARATORS,
    length: Callable[[str], int] = char_length,
) -> list[tuple[int, int]]:
    """Character spans ``[start, end)`` of the chunks of one text (after
    trimming surrounding whitespace; empty chunks dropped)."""
    if not text:
        return []
    out = []
    for start, end in _pack(_pieces(text, 0, tuple(separators), size, length), size, overlap, length):
        chunk = text[start:end]
        lead = len(chunk) - len(chunk.lstrip())
        trail = len(chunk) - len(chunk.rstrip())
        if end - trail > start + lead:
            out.append((start + lead, end - trail))
    return out


def split_recursive(
    text: str | None,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    separators: Sequence[str] = DEFAULT_SEPARATORS,
    length: Callable[[str], int] = char_length,
) -> list[str]:
    """Chunks of one text under the contract of SURVEY §2.3.1."""
    return [text[s:e] for s, e in split_recursive_spans(text, size, overlap, separators, length)]


TEXT_AT_ONCE = 1 << 20  # bytes of text that a task holds as Python strings, or one longer text


def _recursive_batches(text_col: str, size, overlap, separators, length):
    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes.astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + TEXT_AT_ONCE, side="right")))
                part = batch.slice(lo, hi - lo)
                arrays, statuses = [], []
                for text in part.column(text_col).to_pylist():
                    try:
                        arrays.append(split_recursive(text, size, overlap, separators, length))
                        statuses.append(SUCCESS)
                    except Exception as exc:  # a failing document is reported, not fatal
                        arrays.append([])
                        statuses.append(f"ERROR: {exc}")
                chunked = pa.StructArray.from_arrays(
                    [pa.array(arrays, type=pa.list_(pa.string())), pa.array(statuses, type=pa.string())],
                    names=["chunked_text", "chunker_status"],
                )
                yield pa.RecordBatch.from_arrays(
                    list(part.columns) + [chunked], names=list(part.schema.names) + ["chunked"]
                )
                lo = hi

    return run


# --------------------------------------------------------------------------
# Public operators


def chunk_documents(
    docs: DataFrame,
    text_col: str = "text",
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    method: str = "recursive",
    separators: Sequence[str] = DEFAULT_SEPARATORS,
    length: str | Callable[[str], int] = "chars",
) -> DataFrame:
    """Add ``chunked struct<chunked_text array<string>, chunker_status>`` per row.

    ``method="windows"`` is native Spark; ``"recursive"`` runs the splitter in
    an Arrow-batched ``mapInArrow`` (one plan node, never evaluated twice).
    """
    check_chunk_params(size, overlap)
    if method == "windows":
        if length != "chars":
            raise ValueError("window chunks are measured in characters")
        return docs.withColumn("chunked", window_chunks(text_col, size, overlap))
    if method != "recursive":
        raise ValueError(f"unknown chunk method {method!r}")
    length_fn = LENGTH_UNITS[length] if isinstance(length, str) else length
    schema = T.StructType(docs.schema.fields + [T.StructField("chunked", CHUNKED_TYPE, True)])
    return docs.mapInArrow(_recursive_batches(text_col, size, overlap, tuple(separators), length_fn), schema)


def window_chunks(text_col: str, size: int, overlap: int):
    """Native fixed windows: starts 1, 1+step, ... (step = size - overlap); a
    start after the first is kept only while it still adds new text
    (``start + overlap <= length``).  Null or empty text gives no chunk."""
    check_chunk_params(size, overlap)
    text = F.col(text_col)
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(overlap), F.lit(1)), F.lit(size - overlap))
    chunks = F.when(
        n > 0, F.transform(starts, lambda s: text.substr(s, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))
    return F.struct(chunks.alias("chunked_text"), F.lit(SUCCESS).alias("chunker_status"))


def window_rows(
    docs: DataFrame,
    text_col: str = "text",
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    path_col: str = "path",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Window chunks straight to rows ``(path, *keep, chunk_index, chunked_text,
    chunk_id)``: the window starts are exploded first and each row cuts its
    own substring, so no array of chunk texts is built (and none is evaluated
    twice by the filter Catalyst infers for ``explode``)."""
    check_chunk_params(size, overlap)
    text = F.col(text_col)
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(overlap), F.lit(1)), F.lit(size - overlap))
    cols = [F.col(path_col)] + [F.col(c) for c in keep]
    return (
        docs.filter(n > 0)
        .select(*cols, text.alias("_text"), F.posexplode(starts).alias("chunk_index", "_start"))
        .select(*cols, "chunk_index", F.col("_text").substr(F.col("_start"), F.lit(size)).alias("chunked_text"))
        .withColumn("chunk_id", chunk_key("chunked_text"))
    )


def words(text_col: str):
    """Whitespace-separated words of a text (empty strings dropped)."""
    return F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")


def word_window_rows(
    docs: DataFrame,
    text_col: str = "text",
    size: int = 200,
    overlap: int = 50,
    path_col: str = "path",
) -> DataFrame:
    """P6, native form: windows of ``size`` words (step ``size - overlap``,
    same tail rule as the character windows), joined by one space:
    ``(path, chunk_index, chunked_text, chunk_id)``."""
    check_chunk_params(size, overlap)
    w = words(text_col)
    n = F.size(F.col("_words"))
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(overlap), F.lit(1)), F.lit(size - overlap))
    return (
        docs.select(F.col(path_col), w.alias("_words"))
        .filter(n > 0)
        .select(path_col, "_words", F.posexplode(starts).alias("chunk_index", "_s"))
        .select(
            path_col,
            F.col("chunk_index").cast("long").alias("chunk_index"),
            F.array_join(F.slice("_words", F.col("_s"), F.lit(size)), " ").alias("chunked_text"),
        )
        .withColumn("chunk_id", chunk_key("chunked_text"))
    )


def chunk_errors(chunked: DataFrame) -> DataFrame:
    """Documents whose chunker failed (A4 companion)."""
    return chunked.filter(F.col("chunked.chunker_status") != SUCCESS)


def chunk_rows(
    chunked: DataFrame,
    path_col: str = "path",
    keep: Sequence[str] = (),
    with_ordinal: bool = False,
) -> DataFrame:
    """Successful documents -> one row per chunk ``(path, chunked_text,
    chunk_id)``; ``with_ordinal`` adds the 0-based ``chunk_index``.  ``explode``
    drops documents with no chunks."""
    ok = chunked.filter(F.col("chunked.chunker_status") == SUCCESS)
    cols = [F.col(path_col)] + [F.col(c) for c in keep]
    if with_ordinal:
        exploded = ok.select(*cols, F.posexplode("chunked.chunked_text").alias("chunk_index", "chunked_text"))
    else:
        exploded = ok.select(*cols, F.explode("chunked.chunked_text").alias("chunked_text"))
    return exploded.withColumn("chunk_id", chunk_key("chunked_text"))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """One row per ``chunk_id`` (equal texts share a key); the smallest path
    wins.  A hash aggregate with map-side partial ``min``, so a key repeated in
    a third of all rows is collapsed before the shuffle."""
    return chunks.groupBy("chunk_id").agg(
        F.min("path").alias("path"), F.min("chunked_text").alias("chunked_text")
    )


def dedup_batches(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, path, chunked_text)`` with one row per key and Arrow batch, as ``dedup_chunks`` chooses it: what
    is dealt by key afterwards holds a key repeated in a third of all rows a few times per task only."""
    cols = ["chunk_id", "path", "chunked_text"]

    def run(batches):
        for batch in batches:
            met = pa.Table.from_batches([batch]).group_by("chunk_id").aggregate([("path", "min"), ("chunked_text", "min")])
            yield from met.select(["chunk_id", "path_min", "chunked_text_min"]).rename_columns(cols).to_batches()

    rows = chunks.select(*cols)
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
