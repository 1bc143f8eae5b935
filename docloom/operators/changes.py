"""Change sets and keyed upserts (S7, S8) for syncing a chunk table into a
vector table without a transactional table format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

INSERT, UPDATE, DELETE = "insert", "update", "delete"
FILES_PER_BUCKET = 8  # tasks (and files) that write one bucket
CODEC = "zstd"  # of the stored tables


def table_changes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that differ between two snapshots keyed by ``key``:
    ``(key, change_type, *columns)`` with the new values for inserts and
    updates and the old values for deletes.  Equal rows are dropped.
    One full outer join on the key; values compare null-safely."""
    cols = [c for c in (columns or new.columns) if c != key]
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in cols], F.lit(True).alias("_in_old"))
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_in_new"))
    j = o.join(n, key, "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    change = (
        F.when(F.col("_in_old").isNull(), F.lit(INSERT))
        .when(F.col("_in_new").isNull(), F.lit(DELETE))
        .when(~same, F.lit(UPDATE))
    )
    out = j.withColumn("change_type", change).filter(F.col("change_type").isNotNull())
    values = [
        F.when(F.col("change_type") == DELETE, F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c) for c in cols
    ]
    return out.select(key, "change_type", *values)


def apply_changes(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The target after the change set: rows whose key changed are removed
    (``left_anti``), inserts and updates are added (``unionByName``).
    Applying the same change set twice gives the same table."""
    cols = target.columns
    kept = target.join(changes.select(key), key, "left_anti")
    upserts = changes.filter(F.col("change_type") != DELETE).select(*cols)
    return kept.unionByName(upserts)


def key_bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def key_bucket_file(key: str):
    """Second half of a bucket's distribution: a bucket is written by several tasks, as several files."""
    return F.pmod(F.xxhash64(F.lit("file"), F.col(key)), F.lit(FILES_PER_BUCKET)).cast("int")


def dealt(df: DataFrame, key: str, buckets: int, bucket_by: str | None = None) -> DataFrame:
    """``df`` with ``bucket`` and ``_file``, each row in the task that writes it."""
    placed = df.withColumn("bucket", key_bucket(bucket_by or key, buckets)).withColumn("_file", key_bucket_file(key))
    return placed.repartition("bucket", "_file")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, bucket_by: str | None = None) -> None:
    """Write a keyed table partitioned by a hash bucket of its key (or of ``bucket_by``)."""
    placed = dealt(df, key, buckets, bucket_by).drop("_file")
    placed.write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(path)


def _file_system(spark, path: str):
    """The Hadoop path and file system of ``path`` (any store Spark can write)."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark, path: str) -> bool:
    """True when a table was committed at ``path``.  Asks the file system only, so a table
    that cannot be read is not mistaken for one that is not there."""
    root, fs = _file_system(spark, path)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "_SUCCESS")
    if not fs.exists(root):
        return False
    return fs.exists(marker) or len(fs.listStatus(root)) > 0


def overwrite_buckets(rows: DataFrame, path: str) -> None:
    """Make dealt ``rows`` the content of their buckets; the others stay.  The new files are moved
    in when all are written, so ``rows`` may be read from ``path``."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", CODEC)
        .partitionBy("bucket")
        .parquet(path)
    )


def drop_buckets(spark, path: str, buckets: Sequence[int]) -> None:
    """Remove the folders of ``buckets``, which are left without rows."""
    if buckets:
        root, fs = _file_system(spark, path)
        for b in buckets:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"bucket={b}"), True)


def replace_buckets(rows: DataFrame, path: str, key: str, buckets: list[int]) -> None:
    """Make ``rows`` (with ``bucket``, not read from ``path``) the content of ``buckets``;
    the others stay, and a bucket without rows loses its folder."""
    written = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most one row per bucket
    overwrite_buckets(rows.repartition("bucket", key_bucket_file(key)), path)
    drop_buckets(rows.sparkSession, path, [b for b in buckets if b not in written])


def upsert_buckets(changes: DataFrame, path: str, key: str, buckets: int, bucket_by: str | None = None, schema: str | None = None) -> int:
    """Apply a change set to a bucketed parquet table in place, rewriting only
    the touched buckets (dynamic partition overwrite).

    The change set and the new version of the touched buckets are written
    first, so neither is computed twice and the job never reads and overwrites
    the same files at once.  A touched bucket left with no rows has its folder
    removed.  Returns the number of touched buckets.  Replaying the same change
    set gives the same table.  ``bucket_by`` names the column of the bucket when it
    is not the key; ``schema`` (DDL with ``bucket int``) reads a table that may be empty.
    """
    spark = changes.sparkSession
    changes = cut_lineage(changes.withColumn("bucket", key_bucket(bucket_by or key, buckets)))
    touched_ids = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())  # at most `buckets` rows
    if not touched_ids:
        return 0
    target = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    cols = [c for c in target.columns if c != "bucket"]
    current = target.filter(F.col("bucket").isin(touched_ids))  # partition pruning
    kept = current.join(changes.select(key), key, "left_anti")
    upserts = changes.filter(F.col("change_type") != DELETE).select(*cols, "bucket")
    replace_buckets(cut_lineage(kept.unionByName(upserts)), path, key, touched_ids)
    return len(touched_ids)
