from pyspark.sql import functions as F

from docloom.operators import changes


def frames(spark):
    old = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c")], "chunk_id string, path string")
    new = spark.createDataFrame([("k1", "a"), ("k2", "B"), ("k4", "d")], "chunk_id string, path string")
    return old, new


def test_change_types(spark):
    old, new = frames(spark)
    got = {(r.chunk_id, r.change_type, r.path) for r in changes.table_changes(old, new, "chunk_id").collect()}
    assert got == {("k2", "update", "B"), ("k3", "delete", "c"), ("k4", "insert", "d")}


def test_null_values_compare_null_safely(spark):
    old = spark.createDataFrame([("k1", None)], "chunk_id string, path string")
    new = spark.createDataFrame([("k1", None)], "chunk_id string, path string")
    assert changes.table_changes(old, new, "chunk_id").count() == 0


def test_apply_gives_new_snapshot_and_is_idempotent(spark):
    old, new = frames(spark)
    delta = changes.table_changes(old, new, "chunk_id")
    once = changes.apply_changes(old, delta, "chunk_id")
    twice = changes.apply_changes(once, delta, "chunk_id")
    assert sorted(once.collect()) == sorted(new.collect())
    assert sorted(twice.collect()) == sorted(new.collect())


def test_upsert_buckets_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = [(f"k{i}", f"p{i}") for i in range(40)]
    changes.write_bucketed(spark.createDataFrame(rows, "chunk_id string, path string"), path, "chunk_id", 8)
    delta = spark.createDataFrame(
        [("k1", "insert", "P1"), ("k2", "delete", None), ("new", "insert", "pn")],
        "chunk_id string, change_type string, path string",
    )
    touched = changes.upsert_buckets(delta, path, "chunk_id", 8)
    assert 1 <= touched <= 3
    got = {r.chunk_id: r.path for r in spark.read.parquet(path).collect()}
    want = {k: v for k, v in rows if k != "k2"}
    want.update({"k1": "P1", "new": "pn"})
    assert got == want
    changes.upsert_buckets(delta, path, "chunk_id", 8)  # replay: same table
    assert {r.chunk_id: r.path for r in spark.read.parquet(path).collect()} == want


def test_emptied_bucket_is_removed(spark, tmp_path):
    path = str(tmp_path / "v")
    changes.write_bucketed(spark.createDataFrame([("only", "p")], "chunk_id string, path string"), path, "chunk_id", 4)
    delta = spark.createDataFrame([("only", "delete", "p"), ("x", "insert", "q")], "chunk_id string, change_type string, path string")
    changes.upsert_buckets(delta, path, "chunk_id", 4)
    assert [r.chunk_id for r in spark.read.parquet(path).collect()] == ["x"]
