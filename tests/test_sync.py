"""Change log and document sync: added, changed, deleted and late documents, replays and cut-off rewrites."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import changelog, chunk
from docloom.streaming import sync

DOCS = "path string, text string, stamp long"
LONG = "shared words " * 200


def state(s):
    return {r.chunk_id: (r.path, r.n_refs, sum(r.vector)) for r in s.vectors().collect()}


def expected(spark, docs):
    """The table that the newest documents give, chunked and grouped at once."""
    rows = chunk.window_rows(spark.createDataFrame(docs, "path string, text string"), "text").select("path", "chunk_id", "chunked_text").distinct().collect()
    want = {}
    for r in rows:
        path, n, _ = want.get(r.chunk_id, (r.path, 0, 0))
        want[r.chunk_id] = (min(path, r.path), n + 1, float(len(r.chunked_text.split())))
    return want


def test_documents_come_change_and_go(spark, tmp_path):
    s = sync.VectorSync(spark, str(tmp_path / "s"), "long", buckets=4)
    s.apply(spark.createDataFrame([("a", LONG, 1), ("b", LONG, 1), ("c", "only here", 1), (None, "x", 1)], DOCS), 0)
    assert state(s) == expected(spark, [("a", LONG), ("b", LONG), ("c", "only here")])
    one = s.version()
    # a is gone, b stays, c is parsed again, d is new, and an old version of c comes late
    s.apply(spark.createDataFrame([("a", None, 2), ("c", "now other words", 3), ("c", "between", 2), ("d", "fresh", 2)], DOCS), 1)
    s.apply(spark.createDataFrame([("c", "late", 2), ("d", "fresh", 2), ("d", "fresh", 2)], DOCS), 2)
    assert state(s) == expected(spark, [("b", LONG), ("c", "now other words"), ("d", "fresh")])
    got = {(r.change_type, r.old and r.old.path, r.new and r.new.path) for r in s.changes_since(one).collect()}
    assert got == {("update", "a", "b"), ("delete", "c", None), ("insert", None, "c"), ("insert", None, "d")}
    assert s.changes_since(s.version()).count() == 0
    # a comes back, everything else goes
    s.apply(spark.createDataFrame([("a", LONG, 9), ("b", "", 9), ("c", None, 9), ("d", None, 9)], DOCS), 3)
    assert state(s) == expected(spark, [("a", LONG)])
    s.apply(spark.createDataFrame([("a", None, 10)], DOCS), 4)
    assert state(s) == {}


def test_replay_and_reopen_change_nothing(spark, tmp_path):
    base = str(tmp_path / "s")
    s = sync.VectorSync(spark, base, "long", buckets=4)
    first = spark.createDataFrame([("a", LONG, 1), ("b", "two", 1)], DOCS)
    s.apply(first, 0)
    want = state(s)
    s = sync.VectorSync(spark, base, "long", buckets=99)  # the stored bucket count holds
    assert s.buckets == 4
    s.apply(first, 0)
    assert state(s) == want and changelog.versions(spark, s.key_log) == [0]
    s.apply(spark.createDataFrame([], DOCS), 1)
    assert state(s) == want


@pytest.mark.parametrize("step, when", [("_write_refs", "lost"), ("_write_vectors", "lost"), ("_write_vectors", "after")])
def test_a_cut_off_batch_is_finished_by_its_replay(spark, tmp_path, monkeypatch, step, when):
    s = sync.VectorSync(spark, str(tmp_path / "s"), "long", buckets=2)
    s.apply(spark.createDataFrame([("a", LONG, 1), ("b", "two", 1), ("c", "three", 1)], DOCS), 0)
    real = getattr(s, step)

    def cut(log):
        if when == "after":
            real(log)
        if when == "lost":  # folders removed, nothing written in their place
            for name in ("vectors",) if step == "_write_vectors" else ("refs_by_path", "refs_by_key"):
                schema = sync.VECTORS if name == "vectors" else s.refs_schema
                spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("bucket").parquet(f"{s.base}/{name}")
        raise OSError("driver lost")

    monkeypatch.setattr(s, step, cut)
    batch = spark.createDataFrame([(p, None if p == "b" else f"{p} again", 2) for p in "abcdefgh"], DOCS)
    with pytest.raises(OSError):
        s.apply(batch, 1)
    again = sync.VectorSync(spark, s.base, "long")
    again.apply(batch, 1)
    assert state(again) == expected(spark, [(p, f"{p} again") for p in "acdefgh"])
    again.apply(spark.createDataFrame([("a", None, 3)], DOCS), 2)
    assert state(again) == expected(spark, [(p, f"{p} again") for p in "cdefgh"])


def test_uncommitted_version_is_invisible(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("k", "insert", None, 1)], "k string, change_type string, old int, new int")
    assert changelog.append_version(rows, path, 0) and not changelog.append_version(rows, path, 0)
    rows.write.parquet(f"{path}/version=1")
    assert changelog.versions(spark, path) == [0] and changelog.read_changes(spark, path).count() == 1
    assert changelog.read_changes(spark, path, since=0) is None
    assert changelog.append_version(rows.limit(0), path, 1) and changelog.read_changes(spark, path).count() == 1


def test_net_changes(spark):
    log = spark.createDataFrame(
        [("gone", "insert", None, 1, 1), ("gone", "delete", 1, None, 2), ("up", "update", 1, 2, 1), ("up", "update", 2, 3, 3),
         ("back", "delete", 5, None, 1), ("back", "insert", None, 5, 2), ("del", "update", 7, 8, 1), ("del", "delete", 8, None, 2),
         ("new", "insert", None, 4, 2), ("new", "update", 4, 6, 3)],
        "k string, change_type string, old int, new int, version int",
    )
    got = {(r.k, r.change_type, r.old, r.new) for r in changelog.net_changes(log, "k").collect()}
    assert got == {("up", "update", 1, 3), ("del", "delete", 7, None), ("new", "insert", None, 6)}


def test_a_batch_writes_the_vector_table_once(spark, tmp_path):
    """Rows go straight to their buckets."""
    s = sync.VectorSync(spark, str(tmp_path / "s"), "long", buckets=2)
    s.apply(spark.createDataFrame([("a", LONG, 1), ("b", "other", 1)], DOCS), 0)
    s.apply(spark.createDataFrame([("a", None, 2), ("b", "new " * 300, 2), ("c", LONG, 2)], DOCS), 1)
    assert state(s) == expected(spark, [("b", "new " * 300), ("c", LONG)])
    assert not (tmp_path / "s/_staged/vectors").exists()
