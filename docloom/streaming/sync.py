"""T5: a vector table kept in step with documents that are added, parsed again and deleted.

The input is a stream of document versions ``(path, text, order)``.  A newer version of a
path replaces the older one; one without text is a tombstone.  Per micro-batch:

1. the newest version of each path is chunked and compared with the references
   ``(path, chunk_id)`` the path had; the difference is committed to ``refs_log``;
2. ``refs_by_path`` and ``refs_by_key`` (the same rows, bucketed either way) take it over;
3. every key named in it is counted anew in its bucket: a key without references is
   deleted, a new one inserted, another smallest path or count is an update; committed to ``key_log``;
4. ``vectors`` takes that over: only inserted keys are embedded.

Only buckets that hold a touched path or key are read or rewritten.  The logs are the
truth: a batch that is replayed finds its versions committed and does not compute them
again, and tables whose rewriting may have been cut off are made anew from the log, in
the touched buckets.  The checkpoint lies beside the logs, since both count batches.

Defined results: among versions of a path the greatest ``order`` wins, whatever order they
arrive in; on equal order the later batch, and within a batch the text with the greater md5 (null last).
A null path is no document.  A null, empty or unparsable text leaves a document without chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import changelog, changes, chunk, embed
from docloom.operators.changes import DELETE, INSERT, UPDATE, key_bucket

DEFAULT_BUCKETS = 16  # of a new table; about one per 4 GB of chunks is a good number
SEEN = "seen"  # change type of the row that records a path's newest version

REFS = "ref_id string, path string, chunk_id string, stamp {order}, bucket int"
VECTORS = "chunk_id string, path string, n_refs long, chunked_text string, vector array<double>, bucket int"


def _digest():
    return F.md5("text")  # tells versions of equal order apart


def _ref_id():
    return F.md5(F.concat_ws("\u0000", F.col("path"), F.col("chunk_id")))


class VectorSync:
    """The tables and logs under ``base`` (a folder that all executors share)."""

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        order_type: str = "timestamp",
        buckets: int = DEFAULT_BUCKETS,
        dims: int = embed.DEFAULT_DIMS,
        size: int = chunk.DEFAULT_CHUNK_SIZE,
        overlap: int = chunk.DEFAULT_CHUNK_OVERLAP,
    ):
        self.spark, self.base = spark, base.rstrip("/")
        self.refs_schema = REFS.format(order=order_type)
        self.dims, self.size, self.overlap = dims, size, overlap
        self.refs_log, self.key_log = f"{self.base}/refs_log", f"{self.base}/key_log"
        self.vectors_path = f"{self.base}/vectors"
        state = f"{self.base}/_state"
        if not changes.table_exists(spark, state):
            for name, schema in (("refs_by_path", self.refs_schema), ("refs_by_key", self.refs_schema), ("vectors", VECTORS)):
                spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(f"{self.base}/{name}")
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(state)
        self.buckets = spark.read.parquet(state).first()["buckets"]

    # -- tables ---------------------------------------------------------------

    def refs(self, by: str) -> DataFrame:
        return self.spark.read.schema(self.refs_schema).parquet(f"{self.base}/refs_by_{by}")

    def vectors(self) -> DataFrame:
        """The vector table ``(chunk_id, path, n_refs, chunked_text, vector)``."""
        return self.spark.read.schema(VECTORS).parquet(self.vectors_path).drop("bucket")

    def version(self) -> int:
        """The newest version a reader of ``changes_since`` can have seen."""
        return changelog.latest_version(self.spark, self.key_log)

    def changes_since(self, version: int) -> DataFrame:
        """Net changes ``(chunk_id, change_type, old, new)`` of the vector table after
        ``version``; ``old`` and ``new`` hold path and reference count."""
        log = changelog.read_changes(self.spark, self.key_log, version)
        if log is None:
            log = self.spark.createDataFrame([], KEY_LOG)
        return changelog.net_changes(log, "chunk_id")

    # -- one micro-batch ------------------------------------------------------

    def apply(self, batch: DataFrame, version: int) -> None:
        """Bring the tables to ``version`` with the documents of ``batch``
        ``(path, text, stamp)``.  Calling it again with the same version changes nothing."""
        if version not in changelog.versions(self.spark, self.refs_log):
            changelog.append_version(self._ref_changes(batch), self.refs_log, version)
        refs = changelog.read_changes(self.spark, self.refs_log, version - 1, version)
        self._once("refs", version, lambda: self._write_refs(refs), lambda: self._remake_refs(refs))
        if version not in changelog.versions(self.spark, self.key_log):
            changelog.append_version(self._key_changes(refs, batch), self.key_log, version)
        keys = changelog.read_changes(self.spark, self.key_log, version - 1, version)
        self._once("keys", version, lambda: self._write_vectors(keys), lambda: self._remake_vectors(keys))

    def _once(self, step: str, version: int, write, remake) -> None:
        """``write`` unless it is done; ``remake`` when it began before and did not end."""
        begun, done = f"{self.base}/_begun/{step}", f"{self.base}/_done/{step}"
        if version in changelog.marked(self.spark, done):
            return
        again = version in changelog.marked(self.spark, begun)
        changelog.mark(self.spark, begun, version)
        (remake if again else write)()
        changelog.mark(self.spark, done, version)

    def _touched(self, df: DataFrame, column: str) -> list[int]:
        rows = df.filter(F.col(column).isNotNull()).select(key_bucket(column, self.buckets).alias("b")).distinct().collect()
        return sorted(r["b"] for r in rows)  # at most one per bucket

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written under ``_staged``, where the next batch overwrites it."""
        path = f"{self.base}/_staged/{name}"
        df.write.mode("overwrite").option("compression", changes.CODEC).parquet(path)
        return self.spark.read.parquet(path)

    def _ref_changes(self, batch: DataFrame) -> DataFrame:
        """The difference between the references of the batch's paths and their newest
        versions.  No text is shuffled, only keys of chunks."""
        docs = batch.filter(F.col("path").isNotNull()).select("path", "text", "stamp", _digest().alias("_digest"))
        newest = docs.groupBy("path").agg(F.max(F.struct("stamp", "_digest")).alias("_v")).select("path", "_v.*")
        newest = self._staged(newest, "newest")
        known = self.refs("path").filter(F.col("bucket").isin(self._touched(newest, "path")))
        seen = known.filter(F.col("chunk_id").isNull()).select("path", F.col("stamp").alias("_seen"))
        late = F.col("_seen").isNotNull() & (F.col("stamp").isNull() | (F.col("stamp") < F.col("_seen")))
        fresh = self._staged(newest.join(seen, "path", "left").filter(~late).drop("_seen"), "fresh")
        now = self._chunks(docs, fresh).select("path", "chunk_id").distinct().withColumn("_now", F.lit(True))
        before = (
            known.filter(F.col("chunk_id").isNotNull())
            .join(fresh.select("path"), "path", "left_semi")
            .select("path", "chunk_id", F.lit(True).alias("_before"))
        )
        moved = now.join(before, ["path", "chunk_id"], "full_outer").filter(F.col("_now").isNull() | F.col("_before").isNull())
        moved = moved.join(fresh.select("path", "stamp"), "path").select(
            "path", "chunk_id", "stamp", F.when(F.col("_now").isNull(), DELETE).otherwise(INSERT).alias("change_type")
        )
        marks = fresh.select("path", F.lit(None).cast("string").alias("chunk_id"), "stamp", F.lit(SEEN).alias("change_type"))
        return moved.unionByName(marks).withColumn("ref_id", _ref_id())

    def _chunks(self, docs: DataFrame, which: DataFrame) -> DataFrame:
        """Chunk keys of the versions ``(path, stamp, _digest)`` in ``which``.  Keys are made where the
        texts lie: only they are shuffled to their version."""
        keys = chunk.window_rows(docs, "text", self.size, self.overlap, keep=["stamp", "_digest"])
        keys = keys.select("path", "chunk_id", "stamp", "_digest")
        same = (keys["path"] == which["path"]) & keys["stamp"].eqNullSafe(which["stamp"]) & keys["_digest"].eqNullSafe(which["_digest"])
        return keys.join(which, same, "left_semi")

    def _write_refs(self, log: DataFrame) -> None:
        for by, column in (("path", "path"), ("key", "chunk_id")):
            rows = log.filter(F.col(column).isNotNull())
            changes.upsert_buckets(rows, f"{self.base}/refs_by_{by}", "ref_id", self.buckets, column, self.refs_schema)

    def _remake_refs(self, log: DataFrame) -> None:
        whole = changelog.read_changes(self.spark, self.refs_log)
        for by, column in (("path", "path"), ("key", "chunk_id")):
            touched = self._touched(log, column)
            rows = whole.filter(F.col(column).isNotNull()).withColumn("bucket", key_bucket(column, self.buckets))
            rows = rows.filter(F.col("bucket").isin(touched)).withColumn("new", F.struct("path", "chunk_id", "stamp", "bucket"))
            state = changelog.table_at(rows, "ref_id").select("ref_id", "new.*")
            changes.replace_buckets(self._staged(state, "refs"), f"{self.base}/refs_by_{by}", "ref_id", touched)

    def _key_changes(self, log: DataFrame, batch: DataFrame) -> DataFrame:
        named = log.filter(F.col("chunk_id").isNotNull())
        touched = self._touched(named, "chunk_id")
        keys = named.select("chunk_id").distinct()
        # counted before the join, so that a key with very many references is a partial sum per task
        living = (
            self.refs("key").filter(F.col("bucket").isin(touched)).groupBy("chunk_id")
            .agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_refs"))
            .select("chunk_id", F.struct("path", "n_refs").alias("new"))
        )
        present = self.spark.read.schema(VECTORS).parquet(self.vectors_path).filter(F.col("bucket").isin(touched))
        present = present.select("chunk_id", F.struct("path", "n_refs").alias("old"))
        both = keys.join(living, "chunk_id", "left").join(present, "chunk_id", "left")
        change = (
            F.when(F.col("old").isNull() & F.col("new").isNotNull(), INSERT)
            .when(F.col("old").isNotNull() & F.col("new").isNull(), DELETE)
            .when(~F.col("old").eqNullSafe(F.col("new")), UPDATE)
        )
        rows = both.withColumn("change_type", change).filter(F.col("change_type").isNotNull())
        rows = self._staged(rows.select("chunk_id", "change_type", "old", "new"), "keys")
        # all references of an inserted key came with this batch, and equal keys have equal texts: any
        # piece has the text, so pieces are grouped before their one shuffle
        pieces = chunk.window_rows(batch.select("path", "text"), "text", self.size, self.overlap)
        texts = pieces.groupBy("chunk_id").agg(F.max("chunked_text").alias("_text"))
        inserted = F.when(F.col("change_type") == INSERT, F.col("_text"))
        return rows.join(texts, "chunk_id", "left").withColumn("chunked_text", inserted).drop("_text")

    def _embedded(self, rows: DataFrame) -> DataFrame:
        return embed.embed(rows, "chunked_text", "vector", dims=self.dims)

    def _write_vectors(self, log: DataFrame) -> None:
        """The touched buckets with the changes of ``log``.  A key's stored row and its change meet in the
        task that writes them; texts of inserted keys are embedded there."""
        flat = log.select("chunk_id", "change_type", "new.path", "new.n_refs", "chunked_text")
        flat = flat.withColumn("bucket", key_bucket("chunk_id", self.buckets))
        more = F.when(F.col("change_type") == INSERT, 1).when(F.col("change_type") == DELETE, -1).otherwise(0)
        sizes = {r["bucket"]: r["n"] for r in flat.groupBy("bucket").agg(F.sum(more).alias("n")).collect()}  # one per bucket
        if not sizes:
            return
        stored = self.spark.read.schema(VECTORS).parquet(self.vectors_path).filter(F.col("bucket").isin(sorted(sizes)))
        for r in stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r["bucket"]] += r["n"]
        old = F.struct("path", "n_refs", "chunked_text", "vector").alias("_old")
        new = F.struct("change_type", "path", "n_refs", "chunked_text").alias("_new")
        both = stored.select("chunk_id", old).unionByName(flat.select("chunk_id", new), allowMissingColumns=True)
        met = changes.dealt(both, "chunk_id", self.buckets).groupBy("bucket", "_file", "chunk_id").agg(
            F.first("_old", ignorenulls=True).alias("_old"), F.first("_new", ignorenulls=True).alias("_new")
        )
        met = met.filter(F.col("_new").isNull() | (F.col("_new.change_type") != DELETE))
        placed = F.when(F.col("_new").isNull(), F.struct("_old.path", "_old.n_refs")).otherwise(F.struct("_new.path", "_new.n_refs"))
        fresh = F.coalesce(F.col("_new.change_type") == INSERT, F.lit(False))
        rows = met.select(
            "chunk_id",
            placed["path"].alias("path"),
            placed["n_refs"].alias("n_refs"),
            F.when(fresh, F.col("_new.chunked_text")).alias("_text"),
            F.when(~fresh, F.col("_old")).alias("_old"),
            "bucket",
        )
        rows = embed.embed(rows.select("*", "_old.chunked_text", F.col("_old.vector").alias("_stored")).drop("_old"), "_text", "vector", dims=self.dims)
        rows = rows.select(
            "chunk_id", "path", "n_refs", F.coalesce("_text", "chunked_text").alias("chunked_text"),
            F.coalesce("_stored", "vector").alias("vector"), "bucket",
        )
        changes.overwrite_buckets(rows, self.vectors_path)
        changes.drop_buckets(self.spark, self.vectors_path, [b for b, n in sizes.items() if not n])

    def _remake_vectors(self, log: DataFrame) -> None:
        touched = self._touched(log, "chunk_id")
        whole = changelog.read_changes(self.spark, self.key_log).withColumn("bucket", key_bucket("chunk_id", self.buckets))
        whole = whole.filter(F.col("bucket").isin(touched))
        texts = whole.filter(F.col("change_type") == INSERT).groupBy("chunk_id").agg(F.max("chunked_text").alias("chunked_text"))
        state = changelog.table_at(whole, "chunk_id").join(texts, "chunk_id").select("chunk_id", "new.path", "new.n_refs", "chunked_text")
        rows = self._embedded(state).withColumn("bucket", key_bucket("chunk_id", self.buckets))
        changes.replace_buckets(self._staged(rows, "vectors"), self.vectors_path, "chunk_id", touched)


KEY_LOG = (
    "chunk_id string, change_type string, old struct<path: string, n_refs: bigint>, "
    "new struct<path: string, n_refs: bigint>, chunked_text string, version int"
)


def sync_documents(stream: DataFrame, base: str, text: str = "parsed_content", order: str = "modificationTime", **options) -> VectorSync:
    """Run the sync over everything ``stream`` holds now (``availableNow``); called again with
    the same ``base`` it goes on from its checkpoint.  ``stream`` has ``path``, the ``text``
    and the ``order`` column; ``options`` are those of ``VectorSync``."""
    versions = stream.select("path", F.col(text).alias("text"), F.col(order).alias("stamp"))
    sync = VectorSync(stream.sparkSession, base, versions.schema["stamp"].dataType.simpleString(), **options)
    query = (
        versions.writeStream.foreachBatch(sync.apply)
        .option("checkpointLocation", f"{sync.base}/_ckpt")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    exc = query.exception()
    if exc is not None:
        raise RuntimeError(f"document sync failed: {exc}")
    return sync
