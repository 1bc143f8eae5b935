"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import cut_lineage

# The white space of every word and line contract ---------------
WHITE = r"\x20\x09-\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"
# ------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null or empty: empty array)."""
    col = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(col, F.lit("")), f"[{WHITE}]+")
    return F.array_remove(parts, "")


def anti_join_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is listed in ``dropped``.  Rows
    with a null key match nothing and stay; the columns are those of ``docs``."""
    gone = dropped.select(F.col(key).alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


# ------------------------------------------------------------------------------
# a total order over a distributed table


def with_row_index(df: DataFrame, order: Sequence[str], index: str = "row_index", running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``index``, the 0-based place of each row in ``order``, and for
    each ``running`` entry (new name -> bigint column) the total of that column
    over the row and all rows before it.

    The rows are dealt by range over the whole order, so a value that many
    rows share is split; each partition is numbered by itself and written,
    and one row of totals per partition (the only thing the driver sees, so
    bounded by the partition count) gives the offsets."""
    running = running or {}
    spark = df.sparkSession
    cols = list(running.values())
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_last() for c in order]
    )
    fields = [*df.schema.fields, T.StructField("_pid", T.LongType()), T.StructField("_local", T.LongType())]
    fields += [T.StructField(f"_run_{n}", T.LongType()) for n in running]

    def number(batches):
        pid, seen, totals = TaskContext.get().partitionId(), 0, [0] * len(cols)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            arrays = [*batch.columns, pa.array(np.full(n, pid)), pa.array(np.arange(seen, seen + n))]
            for i, c in enumerate(cols):
                run = np.cumsum(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + totals[i]
                totals[i] = int(run[-1])
                arrays.append(pa.array(run))
            seen += n
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    table = cut_lineage(ranged.mapInArrow(number, T.StructType(fields)))
    ends = (
        table.groupBy("_pid")
        .agg(F.max("_local").alias("n"), *[F.max(f"_run_{n}").alias(n) for n in running])
        .orderBy("_pid")
        .collect()
    )  # one row per partition
    rows, before, sums = [], 0, [0] * len(cols)
    for e in ends:
        rows.append((int(e["_pid"]), before, *sums))
        before += int(e["n"]) + 1
        sums = [s + int(e[n]) for s, n in zip(sums, running)]
    schema = "_pid long, _before long" + "".join(f", _off_{n} long" for n in running)
    offsets = F.broadcast(spark.createDataFrame(rows, schema))  # one row per partition
    out = table.join(offsets, "_pid")
    new = [(F.col("_local") + F.col("_before")).alias(index)]
    new += [(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in running]
    return out.select(*df.columns, *new)


# ------------------------------------------------------------------------------
# connected components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the bigint ``edges (a, b)``: root is
    the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the
    edges shrink to a star per component in a number of rounds that grows
    with the logarithm of its length.  Each round is two aggregates with
    map-side combine and joins that AQE can split, written to the shared
    folder; only a count and a checksum of the edges reach the driver."""

    def undirected(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(pairs, larger: bool):
        """For each node a, link its (larger / not larger) neighbours to its least neighbour."""
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        kept = pairs.filter(F.col("b") > F.col("a")) if larger else pairs
        linked = kept.join(least, "a").select(F.col("b").alias("x"), "m")
        if not larger:
            linked = linked.union(least.select(F.col("a").alias("x"), "m"))
        return (
            linked.filter(F.col("x") != F.col("m"))
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
            .distinct()
        )

    def sign(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return int(r["n"]), r["s"]

    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    current = cut_lineage(both)
    seen = sign(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large = star(undirected(current), larger=True)
        small = star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False)
        current = cut_lineage(small)
        now = sign(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
