"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import edges, make_docs  # noqa: F401

from docloom.llm import collocations


def plain(rows, least, top=2000):
    """Rows (lang, text), every phrase counted by itself."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {}
    candidates = {(lang, ws): a for (lang, ws), a in f.items() if len(ws) > 1 and a >= least}
    for (lang, ws), a in candidates.items():
        cuts = [(2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        found[lang, ws] = min(cuts)
    for (lang, ws), b in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                if 100 * b >= 80 * f[lang, ws[i : i + m]]:
                    found.pop((lang, ws[i : i + m]), None)
    out = []
    for lang in n:
        best = sorted((-s, -candidates[lang, ws], " ".join(ws).encode(), lf, r) for (x, ws), (s, _, lf, r) in found.items() if x == lang)
        out += [(lang, i + 1, p.decode(), -a, lf, r, n[lang], -s) for i, (s, a, p, lf, r) in enumerate(best[:top])]
    return sorted(out)


def text(rnd, n, vocab):
    words = []
    while len(words) < n:
        words += rnd.choice([["new", "york", "city"], ["of", "the"], ["New", "york"], ["a", "b", "a", "b"], ["é", "漢字"], [rnd.choice(vocab)], [rnd.choice(vocab)]])
    return "".join(w + rnd.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " - ", "\x0b", " "]) for w in words)


@pytest.mark.parametrize("chunk", [collocations.CHUNK, 700, 40])
def test_equals_plain_counting(spark, make_docs, chunk):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["Ünder", "X.y", "über-all"]
    rows = [(rnd.choice(["en", "de", None]), text(rnd, rnd.randint(1, 400), vocab)) for _ in range(60)]
    rows += [("en", "x " * 300), ("en", rows[0][1]), ("en", rows[0][1])]  # overlapping and repeated
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    want = plain(rows, 6)
    assert sorted(map(tuple, collocations.collocations(docs, least=6, chunk=chunk).collect())) == want
    assert len(want) > 100 and max(len(r[2].split(" ")) for r in want) == 4
    few = collocations.collocations(docs, least=6, top=5, chunk=chunk).collect()
    assert sorted(map(tuple, few)) == plain(rows, 6, 5)


def test_tiles_count_dense_and_sparse(monkeypatch):
    rnd = np.random.default_rng(0)
    left = np.concatenate([rnd.integers(0, 50, 400_000), rnd.integers(0, 100_000, 50_000)])
    right = np.concatenate([rnd.integers(0, 3000, 400_000), rnd.integers(0, 100_000, 50_000)])
    across = (100_000 >> collocations.TILE_BITS) + 1
    tile, cell, n = collocations.tile_cells(left, right, across)
    got = {}
    for t, c, k in zip(tile.tolist(), cell.tolist(), n.tolist()):
        a = (t // across << collocations.TILE_BITS) | (c >> collocations.TILE_BITS)
        b = (t % across << collocations.TILE_BITS) | (c & (collocations.TILE - 1))
        assert (a, b) not in got
        got[a, b] = k
    assert got == Counter(zip(left.tolist(), right.tolist()))
    assert (np.diff(tile) >= 0).all()


def test_dense_tiles_are_added_up_over_tasks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(collocations, "MERGE_CELLS", 8)
    monkeypatch.setattr(collocations, "DENSE", 4)
    rnd = random.Random(1)
    rows = [("en", " ".join(rnd.choice("abcdefgh") for _ in range(60))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(6)
    assert sorted(map(tuple, collocations.collocations(docs, least=3).collect())) == plain(rows, 3)


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000)], "a long, x long, y long")
    got = df.select(collocations._cut(1, "a", "x", "y").alias("c")).first().c
    assert got.score == 2_000_000 * 9_000_000_000_000_000_000 // (9_100_000_000_000_000_000 + 9_200_000_000_000_000_000)


def test_edges(edges, make_docs):
    rows = [(r.lang, r.text) for r in edges.collect()]
    for c in ("chunk", "words", "counts", "own", "n", "codes", "id", "rank", "phrase", "left", "top"):
        edges = edges.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, collocations.collocations(edges, least=2).collect())) == plain(rows, 2)
    assert collocations.collocations(make_docs([])).count() == 0
    assert collocations.collocations(make_docs([(1, None), (2, "")])).count() == 0


def test_long_text(make_docs):
    long = "alpha beta gamma " * 200_000 + "z" * 3_000_000 + " alpha beta"
    out = collocations.collocations(make_docs([(1, long), (2, "alpha beta")]), chunk=1 << 18)
    assert sorted(map(tuple, out.collect())) == plain([("en", long), ("en", "alpha beta")], 30)


def test_rows_of_chunks_are_made_one_at_a_time():
    """op13: a task holds the codes of one chunk as Python objects, and asks for distinct cells in one sorted array."""
    import pyarrow as pa

    made = []

    class Batch:
        num_rows = 3

        def slice(self, at, n):
            made.append((at, n))
            return pa.RecordBatch.from_pydict({"a": [at] * n})

    rows = collocations._rows([Batch()])
    assert next(rows) == {"a": 0} and made == [(0, 1)]
    left, right = np.array([5000, 3, 5000, 3]), np.array([7, 9000, 7, 2])
    code = collocations._distinct(collocations._cell_codes(left, right, 6))
    _, tile, cell = collocations._tiled(np.array([3, 3, 5000]), np.array([2, 9000, 7]), 6)
    assert list(code >> collocations.CELL_BITS) == list(tile) and list(code & (collocations.TILE**2 - 1)) == list(cell)


def test_counting_holds_little_beside_its_pairs():
    """Pairs of a task's share are counted in a few times their own bytes: 8 a pair."""
    import tracemalloc

    rnd, across = np.random.default_rng(3), 60
    left, right = rnd.zipf(1.3, 2_000_000) % 100_000, rnd.zipf(1.3, 2_000_000) % 100_000
    code = collocations._cell_codes(left, right, across)
    want, times = np.unique(code, return_counts=True)
    tracemalloc.start()
    got, n = collocations.count_cells(code, across)
    rows = sum(r.num_rows > 0 for r in collocations._cells_in_rows(got, across, counts=n.astype(np.int32)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and np.array_equal(n, times) and rows
    assert most < 8 * code.nbytes


def test_rows_of_cells_do_not_grow_with_the_tiles():
    """op13: the same number of pairs makes about as many rows when they lie in many more tiles."""
    rnd = np.random.default_rng(11)
    made = {}
    for ids in (20_000, 400_000):
        across = (ids >> collocations.TILE_BITS) + 1
        left, right = rnd.integers(0, ids, 200_000), rnd.integers(0, ids, 200_000)
        code, n = collocations.count_cells(collocations._cell_codes(left, right, across), across)
        rows = list(collocations._cells_in_rows(code, across, counts=n.astype(np.int32)))
        made[ids] = sum(r.num_rows for r in rows)
        back = [collocations._unpack_cells(c, k) for r in rows for c, k in zip(r.column("cells").to_pylist(), r.column("size").to_pylist())]
        assert np.array_equal(np.sort(np.concatenate(back)), code)
        a, b = collocations._pairs_of(code, across)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(left.tolist(), right.tolist()))
        for r in rows:  # a tile's cells meet in one share
            for share, c, k in zip(r.column("share").to_pylist(), r.column("cells").to_pylist(), r.column("size").to_pylist()):
                assert (collocations._shares_of(collocations._unpack_cells(c, k), across, collocations.SHARES) == share).all()
    assert made[400_000] < 2 * made[20_000]


@pytest.mark.parametrize("merge_cells", [4, 64])
def test_shares_larger_than_a_merge_are_added_up(spark, make_docs, monkeypatch, merge_cells):
    monkeypatch.setattr(collocations, "MERGE_CELLS", merge_cells)
    monkeypatch.setattr(collocations, "ROW_CELLS", 8)
    monkeypatch.setattr(collocations, "SHARES", 2)
    monkeypatch.setattr(collocations, "HEAD", 0)
    monkeypatch.setattr(collocations, "COUNTED", 64)
    rnd = random.Random(2)
    rows = [("en", " ".join(f"w{int(rnd.paretovariate(0.7)) % 50}" for _ in range(80))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    assert sorted(map(tuple, collocations.collocations(docs, least=3).collect())) == plain(rows, 3)


def test_texts_are_coded_in_parts(monkeypatch):
    """op13: a chunk is coded as before when its texts are cut to parts, also inside a text."""
    import pyarrow as pa

    rnd = random.Random(5)
    vocab = ["Ünder", "X.y", "über-all", "w1", "w2"]
    for texts in ([text(rnd, rnd.randint(0, 60), vocab) for _ in range(40)], ["", "", ""], ["a b", "", "z" * 500 + " a", "a b. " * 90], [text(rnd, 900, vocab)], ["A\tb ", " . ", "c"]):
        whole = collocations.code_words(pa.array(texts))
        for size in (1, 7, 100, 1000):
            with monkeypatch.context() as m:
                m.setattr(collocations, "PART", size)
                words, codes = collocations.code_words(pa.array(texts))
            assert words.equals(whole[0]) and np.array_equal(codes, whole[1])
        assert codes.dtype == np.int32


def test_coding_holds_few_strings_beside_its_texts():
    """op13: the strings of one part are held, not those of a whole chunk."""
    import pyarrow as pa

    rnd = random.Random(6)
    texts = pa.array([" ".join(f"w{int(rnd.paretovariate(0.9)) % 5000}" for _ in range(1000)) for _ in range(2000)])
    before = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(before)
    pa.set_memory_pool(pool)
    try:
        collocations.code_words(texts)
        held = pool.max_memory()
    finally:
        pa.set_memory_pool(before)
    assert texts.nbytes > 5 * collocations.PART and held < texts.nbytes


def test_batches_of_cells_are_small(spark):
    """op13: a task is sent a few megabytes at a time and makes Python objects of a few rows."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    df = spark.range(0, 3000, 1, 1).select(F.expr("repeat(cast(id % 10 as string), 8000)").alias("cells"))

    def largest(batches):
        yield pa.RecordBatch.from_pydict({"b": [max(b.nbytes for b in batches)]})

    with pytest.raises(KeyError), collocations._small_batches(spark):
        assert df.mapInArrow(largest, "b long").first().b < 6 << 20
        raise KeyError
    assert spark.conf.get(key) == before
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    few = list(collocations._few([batch, batch.slice(0, 0)]))
    assert [v for b in few for v in b.column(0).to_pylist()] == list(range(1000)) and max(b.num_rows for b in few) <= collocations.FEW


def test_cells_of_a_share_are_added_up_in_little():
    """op13: a share's cells are summed in a few times their own bytes, 12 a cell."""
    import tracemalloc

    rnd = np.random.default_rng(9)
    cell, n = rnd.integers(0, 1 << 40, 1_000_000), rnd.integers(1, 9, 1_000_000).astype(np.int32)
    cell[::2] = cell[1::2]
    tracemalloc.start()
    got, total = collocations.add_up(cell, n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total.dtype == np.int64 and total.sum() == n.sum() and np.array_equal(got, np.unique(cell))
    assert most < 3 * (cell.nbytes + n.nbytes)
