import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import chunk
from docloom.operators.chunk import split_recursive, split_recursive_spans, word_length


def _covered(text, spans):
    """Spans are in order, and every non-space character lies in one."""
    starts = [a for a, _ in spans]
    if starts != sorted(starts):
        return False
    covered = [False] * len(text)
    for a, b in spans:
        for i in range(a, b):
            covered[i] = True
    return all(c or ch.isspace() for c, ch in zip(covered, text))


words = st.text(alphabet=st.sampled_from(list("abcdé xyz\n\t.")), min_size=0, max_size=600)


@settings(max_examples=150, deadline=None)
@given(text=words, size=st.integers(5, 120), overlap_frac=st.floats(0, 0.9))
def test_recursive_invariants(text, size, overlap_frac):
    overlap = int(size * overlap_frac)
    if overlap >= size:
        overlap = size - 1
    chunks = split_recursive(text, size, overlap)
    spans = split_recursive_spans(text, size, overlap)
    assert chunks == [text[a:b] for a, b in spans]
    assert all(0 < len(c) <= size for c in chunks)
    assert all(c == c.strip() for c in chunks)
    assert _covered(text, spans)
    for (a1, b1), (a2, b2) in zip(spans, spans[1:]):
        assert max(0, b1 - a2) <= overlap  # neighbours overlap at most `overlap`


@settings(max_examples=60, deadline=None)
@given(text=words, size=st.integers(3, 40))
def test_recursive_words_unit(text, size):
    spans = split_recursive_spans(text, size, size // 3, length=word_length)
    assert all(word_length(text[a:b]) <= size for a, b in spans)
    assert _covered(text, spans)


def test_separators_in_order_and_overlap():
    text = "para one is here.\n\npara two is here.\n\npara three."
    assert split_recursive(text, 20, 0) == ["para one is here.", "para two is here.", "para three."]
    out = split_recursive("a b c d e f g h", 7, 4)
    assert out[0] == "a b c d"
    for a, b in zip(out, out[1:]):
        assert a[-1] in b  # neighbours share text


def test_long_word_is_cut_at_size():
    assert split_recursive("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_blank_lines_form_feed_null_and_empty():
    assert split_recursive(None) == []
    assert split_recursive("") == []
    assert split_recursive("   \n\n  ") == []
    assert split_recursive("a\fb\n\nc", 3, 0) == ["a\fb", "c"]


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, 12), (-1, 0)])
def test_bad_parameters_raise_on_driver(spark, size, overlap):
    df = spark.createDataFrame([("p", "text")], "path string, text string")
    with pytest.raises(ValueError):
        chunk.chunk_documents(df, "text", size, overlap)


def test_window_tail_rule_and_ordinal(spark):
    df = spark.createDataFrame([("p", "abcdefghij"), ("q", "abc"), ("r", None), ("s", "")], "path string, text string")
    rows = chunk.window_rows(df, "text", 4, 2).orderBy("path", "chunk_index").collect()
    got = [(r.path, r.chunk_index, r.chunked_text) for r in rows]
    # starts 1,3,5,7 (7 + 2 <= 10 keeps 7; 9 + 2 > 10 drops 9)
    assert got == [("p", 0, "abcd"), ("p", 1, "cdef"), ("p", 2, "efgh"), ("p", 3, "ghij"), ("q", 0, "abc")]


def test_window_struct_form_equals_rows(spark):
    df = spark.createDataFrame([("p", "abcdefghij")], "path string, text string")
    a = chunk.chunk_rows(chunk.chunk_documents(df, "text", 4, 2, method="windows")).collect()
    b = chunk.window_rows(df, "text", 4, 2).drop("chunk_index").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_recursive_job_matches_helper_and_reports_errors(spark):
    texts = [("a", "one two three four five six"), ("b", None), ("c", "x" * 30)]
    df = spark.createDataFrame(texts, "path string, text string")
    out = chunk.chunk_documents(df, "text", 10, 3).orderBy("path").collect()
    for (path, text), row in zip(texts, out):
        assert row.chunked.chunker_status == "SUCCESS"
        assert row.chunked.chunked_text == split_recursive(text, 10, 3)

    def boom(_text):
        raise RuntimeError("no")

    bad = chunk.chunk_documents(df, "text", 10, 3, length=boom)
    errs = chunk.chunk_errors(bad).collect()
    assert len(errs) == 2 and all(r.chunked.chunker_status.startswith("ERROR: ") for r in errs)
    assert chunk.chunk_rows(bad).count() == 0  # failures never reach the chunk table


def test_chunk_rows_key_and_explode(spark):
    df = spark.createDataFrame([("p", "abcdefghij"), ("q", "")], "path string, text string")
    rows = chunk.chunk_rows(chunk.chunk_documents(df, "text", 4, 2, method="windows"), with_ordinal=True).collect()
    assert {r.path for r in rows} == {"p"}
    import hashlib

    assert all(r.chunk_id == hashlib.md5(r.chunked_text.encode()).hexdigest() for r in rows)


def test_equal_chunks_in_two_documents_dedup_to_smallest_path(spark):
    df = spark.createDataFrame([("b/2.txt", "same text"), ("a/1.txt", "same text"), ("c/3.txt", "other")],
                               "path string, text string")
    rows = chunk.window_rows(df, "text", 100, 10)
    assert rows.count() == 3
    uniq = {r.chunked_text: r.path for r in chunk.dedup_chunks(rows).collect()}
    assert uniq == {"same text": "a/1.txt", "other": "c/3.txt"}


def test_word_pattern_is_whitespace():
    assert word_length("a  b\tc\nd") == 4
    assert re.fullmatch(r"\S+", "word")


def test_recursive_chunks_hold_a_bounded_piece_of_a_batch(spark, monkeypatch):
    """a task turns a bounded piece of an Arrow batch into Python strings, not the whole batch."""
    import pyarrow as pa

    texts = ["word " * 400, None, "", "x" * 5000] * 20
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(texts))], "text": pa.array(texts, pa.string())})
    monkeypatch.setattr(chunk, "TEXT_AT_ONCE", 6000)
    out = list(chunk._recursive_batches("text", 100, 20, chunk.DEFAULT_SEPARATORS, len)([batch]))
    assert len(out) > 10 and all(sum(len(t or "") for t in b.column("text").to_pylist()) <= 7000 for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(len(texts))]
    assert all(r["chunked"]["chunked_text"] == chunk.split_recursive(t, 100, 20) for r, t in zip(rows, texts))
