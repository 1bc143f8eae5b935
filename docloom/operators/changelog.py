"""A versioned, append-only change log (S7 for tables that are kept in step).

``{path}/version=N`` holds the change rows of version N, ``{path}/_commits/N`` is
written after them.  Readers see committed versions only, so a version left half
written by a lost driver is invisible and is written again.  A consumer that has
applied version N reads what came after it, never a whole snapshot of the table.

A change row carries its key, ``change_type`` and the values before (``old``) and
after (``new``) as structs; ``old`` is null for an insert, ``new`` for a delete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.changes import CODEC, DELETE, INSERT, UPDATE, _file_system


def _child(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def mark(spark: SparkSession, folder: str, version: int) -> None:
    """Leave the marker of ``version`` in ``folder``."""
    _, fs = _file_system(spark, folder)
    fs.create(_child(spark, f"{folder}/{version}"), True).close()


def marked(spark: SparkSession, folder: str) -> list[int]:
    """Versions with a marker in ``folder``, ascending."""
    root, fs = _file_system(spark, folder)
    if not fs.exists(root):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(root) if f.getPath().getName().isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, ascending."""
    return marked(spark, f"{path}/_commits")


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest committed version; -1 for a log without any."""
    return max(versions(spark, path), default=-1)


def append_version(changes: DataFrame, path: str, version: int) -> bool:
    """Write ``changes`` as ``version`` and commit it.  A version that is committed
    stays as it is (False): a replayed batch adds nothing."""
    spark = changes.sparkSession
    if version in versions(spark, path):
        return False
    changes.write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/version={version}")
    mark(spark, f"{path}/_commits", version)
    return True


def read_changes(spark: SparkSession, path: str, since: int = -1, until: int | None = None) -> DataFrame | None:
    """All change rows of the committed versions after ``since`` (up to ``until``), with
    their ``version``; None when there is no such version.  Only their folders are read."""
    wanted = [v for v in versions(spark, path) if v > since and (until is None or v <= until)]
    if not wanted:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in wanted])


def net_changes(log: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row ``(key, change_type, old, new)`` per key that differs between the version
    before ``log`` and its last one.  ``log`` holds at most one row per key and version.
    A key that came and went, or that is back at its old values, has no row.
    One aggregate with map-side partial results; a hot key ships one row per task."""
    keys = [key] if isinstance(key, str) else list(key)
    ends = log.groupBy(*keys).agg(
        F.min_by(F.struct("change_type", "old"), "version").alias("_first"),
        F.max_by(F.struct("change_type", "new"), "version").alias("_last"),
    )
    before, after = F.col("_first.change_type") != INSERT, F.col("_last.change_type") != DELETE
    net = (
        F.when(~before & after, F.lit(INSERT))
        .when(before & ~after, F.lit(DELETE))
        .when(before & after & ~F.col("_first.old").eqNullSafe(F.col("_last.new")), F.lit(UPDATE))
    )
    return (
        ends.select(*keys, net.alias("change_type"), F.col("_first.old").alias("old"), F.col("_last.new").alias("new"))
        .filter(F.col("change_type").isNotNull())
    )


def table_at(log: DataFrame, key: str) -> DataFrame:
    """The table that a log read from its beginning leaves: ``(key, new)`` per living key."""
    last = log.groupBy(key).agg(F.max_by(F.struct("change_type", "new"), "version").alias("_last"))
    return last.filter(F.col("_last.change_type") != DELETE).select(key, F.col("_last.new").alias("new"))
