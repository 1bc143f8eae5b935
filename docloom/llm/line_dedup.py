"""Reversible line deduplication over documents (operator 5).

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased; keys of fewer than ``min_chars`` code points never count.  A key
held by two documents or more loses its lines everywhere but in the smallest
doc_id that holds it.

``LineIndex`` keeps four things in the shared folder, all written by Spark:

* ``ledger``  one row per (key, document) with sign +1 for an insert and -1
  for a deletion.  The net of the signs is what is in the index.
* ``refs``    the exact reference counts: key, number of documents, smallest
  document, and ``born``, the version whose filter table holds the key; the
  newest version of a key counts.
* ``filters`` one cuckoo filter per shard of the key space with every key
  whose count is above zero; each insert opens at most one table per shard.
* ``state``   one row per change (version, shards, min_chars), written last: a
  change without its row never happened, and the next one writes over it.

``LineIndex(spark, path)`` on a folder that holds an index goes on with it.  One
writer at a time.

An insert probes the filters shard by shard.  A key that is absent for certain
gets a new reference row unseen; only a key that may be present is looked up in
the exact table.  The first insert has no filter to probe: its result, and so
that of the one-shot form, comes from the exact counts alone.  A deletion writes the opposite ledger rows, counts the touched
keys anew from the ledger and takes the keys that reached zero out of the
filter table they were put into (another table may hold the same tag for another
key): inserting documents and deleting them again restores every count.

Keys are 128-bit BLAKE2b digests.  Counting is an aggregate with map-side
combine, so a line that a third of all documents share is one row per input
partition; the join of the holders with the counts can be split by AQE.

Defined results: a null or empty text is one empty line and keeps it; rows that
repeat a doc_id are one document; a row with a null doc_id is not indexed and
keeps all its lines; other columns pass through ``apply`` untouched.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import cuckoo
from docloom.llm.common import WHITE_CHARS
from docloom.operators.changes import table_exists
from docloom.session import cut_lineage, ensure_checkpoint_dir

MIN_CHARS = 10  # fixed value of the contract
KEYS_PER_SHARD = 1 << 12
_UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

POSTING = "k1 long, k2 long, doc_id long"
STATE = "version int, shards int, min_chars int"
FILTERS = "shard int, tables array<binary>, born array<int>"


def line_digest(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """16-byte digest of a line's key; None when the key is too short to count."""
    key = line.strip(WHITE_CHARS)
    if len(key) < min_chars:
        return None
    return hashlib.blake2b(key.translate(_UPPER_TO_LOWER).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _postings(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """Distinct ``(k1, k2, doc_id)`` of the lines of every whole text."""

    def run(batches):
        for batch in batches:
            ids, digests = [], []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {line_digest(x, min_chars) for x in (body.as_py() or "").split("\n")} - {None}
                ids.extend([doc_id] * len(found))
                digests.extend(found)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, type=pa.int64())],
                names=["k1", "k2", "doc_id"],
            )

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(run, POSTING)


class LineIndex:
    """Incremental index of lines (module docstring).  ``shards`` is fixed by the
    first insert (``KEYS_PER_SHARD`` keys each) unless given; a shard that
    outgrows its table opens further ones.  ``min_chars`` is ``MIN_CHARS`` unless
    given.  An index that exists keeps its own two values; other ones raise."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, min_chars: int | None = None):
        self.spark = spark
        self.path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines/{uuid.uuid4().hex}").rstrip("/")
        self.shards = shards
        self.min_chars = MIN_CHARS if min_chars is None else min_chars
        self.version = 0
        if path and table_exists(spark, f"{self.path}/state"):
            self._reopen(shards, min_chars)

    def _reopen(self, shards: int | None, min_chars: int | None) -> None:
        last = self.spark.read.schema(STATE).parquet(f"{self.path}/state").orderBy(F.desc("version")).first()
        if last is None:  # the first change was never committed
            return
        for name, given, kept in (("shards", shards, last["shards"]), ("min_chars", min_chars, last["min_chars"])):
            if given is not None and kept is not None and given != kept:
                raise ValueError(f"the index at {self.path} has {name} {kept}, not {given}")
        self.version, self.min_chars = last["version"], last["min_chars"]
        self.shards = last["shards"] or shards

    # -- tables ------------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/v={v}" for v in range(1, self.version + 1)])

    def ledger(self) -> DataFrame:
        """Net holdings ``(k1, k2, doc_id)``."""
        return self._holdings().drop("net")

    def _holdings(self) -> DataFrame:
        rows = self._table("ledger", f"{POSTING}, sign int")
        return rows.groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("net")).filter("net > 0")

    def refs(self) -> DataFrame:
        """Current reference counts ``(k1, k2, n_docs, holder)`` of the keys in use."""
        return self._refs().drop("born")

    def _refs(self) -> DataFrame:
        rows = self._table("refs", "k1 long, k2 long, n_docs long, holder long, born int, version int")
        if self.version > 1:
            newest = F.max_by(F.struct("n_docs", "holder", "born"), "version").alias("r")
            rows = rows.groupBy("k1", "k2").agg(newest).select("k1", "k2", "r.n_docs", "r.holder", "r.born")
        return rows.filter("n_docs > 0").select("k1", "k2", "n_docs", "holder", "born")

    def filters(self) -> DataFrame:
        """``(shard, tables, born)``: the cuckoo tables of every shard and the version that opened each."""
        if not self.version:
            return self.spark.createDataFrame([], FILTERS)
        return self.spark.read.parquet(f"{self.path}/filters/v={self.version}")

    def _shard(self):
        return F.pmod("k1", F.lit(self.shards)).cast("int")

    # -- cuckoo filters, a shard at a time -----------------------------------------

    def maybe_present(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys (k1, k2, ...)`` with ``maybe``: false means certainly absent."""
        keyed = keys.withColumn("shard", self._shard())
        schema = T.StructType([*keys.schema.fields, T.StructField("maybe", T.BooleanType())])
        names = keys.columns

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            k1, k2 = _halves(left)
            seen = np.zeros(left.num_rows, dtype=bool)
            for table in _tables(right):
                seen |= cuckoo.contains(table, k1, k2)
            return left.select(names).append_column("maybe", pa.array(seen))

        return keyed.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(probe, schema)

    def _write_filters(self, keys: DataFrame, remove: bool) -> None:
        """Next version of the filters: ``keys (k1, k2, born)`` inserted or deleted."""
        to = self.version + 1

        def change(left: pa.Table, right: pa.Table) -> pa.Table:
            tables = [t.copy() for t in _tables(right)]
            opened = _born(right)
            k1, k2 = _halves(left)
            if remove:
                born = left.column("born").to_numpy()
                for version, table in zip(opened, tables):
                    here = born == version
                    cuckoo.delete(table, k1[here], k2[here])
            elif len(k1):
                fresh = cuckoo.empty_table(len(k1))
                while not cuckoo.insert(fresh, k1, k2):
                    fresh = np.zeros((len(fresh) * 2, cuckoo.SLOTS), dtype=np.uint16)
                tables.append(fresh)
                opened.append(to)
            shard = (left if left.num_rows else right).column("shard")[0].as_py()
            return pa.table(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "tables": pa.array([[t.tobytes() for t in tables]], pa.list_(pa.binary())),
                    "born": pa.array([opened], pa.list_(pa.int32())),
                }
            )

        keyed = keys.select("k1", "k2", "born", self._shard().alias("shard"))
        out = keyed.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(change, FILTERS)
        out.write.mode("overwrite").parquet(f"{self.path}/filters/v={to}")

    # -- changes --------------------------------------------------------------------

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """Add documents.  One that is in the index already gains the lines it did not hold, so an
        insert that is repeated changes nothing (delete a document first to replace its text)."""
        to = self.version + 1
        batch = _postings(docs, key, text, self.min_chars)
        if self.version:
            live = self.ledger().select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("doc_id").alias("of"))
            same = (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")) & F.col("doc_id").eqNullSafe(F.col("of"))
            batch = batch.join(live, same, "left_anti")
        batch.withColumn("sign", F.lit(1)).write.mode("overwrite").parquet(f"{self.path}/ledger/v={to}")
        batch = self.spark.read.schema(POSTING).parquet(f"{self.path}/ledger/v={to}")
        held = batch.distinct()  # a repeated doc_id may repeat a line
        counts = cut_lineage(held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("holder")))
        if self.shards is None:
            self.shards = max(1, -(-counts.count() // KEYS_PER_SHARD))
        if self.version:
            probed = cut_lineage(self.maybe_present(counts))
            old = self._refs().select("k1", "k2", F.col("n_docs").alias("n0"), F.col("holder").alias("h0"), F.col("born").alias("b0"))
            known = probed.filter("maybe").join(old, ["k1", "k2"], "left")
            rows = probed.filter("not maybe").select("k1", "k2", "n_docs", "holder", F.lit(to).alias("born"))
            rows = rows.unionByName(
                known.select(
                    "k1",
                    "k2",
                    (F.col("n_docs") + F.coalesce("n0", F.lit(0))).alias("n_docs"),
                    F.least("holder", "h0").alias("holder"),
                    F.coalesce("b0", F.lit(to)).alias("born"),
                )
            )
            rows = cut_lineage(rows)
        else:  # no filter yet: every key is certainly absent
            rows = counts.withColumn("born", F.lit(to))
        self._write_filters(rows.filter(F.col("born") == to), remove=False)
        return self._commit(rows)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> LineIndex:
        """Take documents out: every count, holder and filter is as if they had never been inserted."""
        to = self.version + 1
        gone = ids.select(F.col(key).cast("long").alias("doc_id")).distinct()
        out = self._holdings().join(gone, "doc_id", "left_semi")
        out.select("k1", "k2", "doc_id", (-F.col("net")).cast("int").alias("sign")).write.mode("overwrite").parquet(f"{self.path}/ledger/v={to}")
        removed = self.spark.read.schema(POSTING).parquet(f"{self.path}/ledger/v={to}")
        touched = removed.select("k1", "k2").distinct()
        left = self.ledger().join(gone, "doc_id", "left_anti").join(touched, ["k1", "k2"], "left_semi")
        now = left.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("holder"))
        born = self._refs().select("k1", "k2", "born")
        rows = cut_lineage(
            touched.join(now, ["k1", "k2"], "left")
            .join(born, ["k1", "k2"])
            .select("k1", "k2", F.coalesce("n", F.lit(0)).alias("n_docs"), "holder", "born")
        )
        self._write_filters(rows.filter("n_docs = 0"), remove=True)
        return self._commit(rows)

    def _commit(self, rows: DataFrame) -> LineIndex:
        to = self.version + 1
        rows.select("k1", "k2", "n_docs", "holder", "born", F.lit(to).alias("version")).write.mode("overwrite").parquet(
            f"{self.path}/refs/v={to}"
        )
        state = self.spark.createDataFrame([(to, self.shards, self.min_chars)], STATE)
        state.coalesce(1).write.mode("append").parquet(f"{self.path}/state")  # one file: there whole or not at all
        self.version = to
        return self

    # -- result ---------------------------------------------------------------------

    def _kept(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """The columns of ``docs`` by place (``_0``, ``_1``, ...) with ``_kept``, ``_lines`` and ``_dropped``."""
        shared = self.refs().filter("n_docs > 1")
        held = self.ledger() if self.version > 1 else self._table("ledger", POSTING).distinct()
        lost = held.join(shared, ["k1", "k2"]).filter(F.col("doc_id") != F.col("holder"))
        # the list is at most the document's own lines
        lost = lost.groupBy(F.col("doc_id").alias("_lost_id")).agg(F.collect_list(F.array("k1", "k2")).alias("_lost"))
        places = {c: f"_{i}" for i, c in enumerate(docs.columns)}
        rows = docs.select(*[F.col(c).alias(n) for c, n in places.items()])
        joined = rows.join(lost, F.col(places[key]).cast("long") == F.col("_lost_id"), "left").drop("_lost_id")
        min_chars, place, lost_at = self.min_chars, docs.columns.index(text), len(docs.columns)
        schema = T.StructType(
            [*rows.schema.fields, *T._parse_datatype_string("_kept string, _lines long, _dropped long").fields]
        )

        def run(batches):
            for batch in batches:
                kept, n_lines, n_dropped = [], [], []
                for body, keys in zip(batch.column(place), batch.column(lost_at)):
                    lines = (body.as_py() or "").split("\n")
                    stay = lines
                    if keys.is_valid:
                        gone = {np.array(k, dtype="<i8").tobytes() for k in keys.as_py()}
                        stay = [x for x in lines if line_digest(x, min_chars) not in gone]
                    kept.append("\n".join(stay))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                columns = [*batch.columns[:lost_at], pa.array(kept, pa.string()), pa.array(n_lines), pa.array(n_dropped)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return joined.mapInArrow(run, schema)

    def apply(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``: the lines that
        indexed documents lose are gone, the others are joined by \\n as they were.
        Columns of ``docs`` with one of these names are replaced."""
        new = {"kept_text": "_kept", "n_lines": "_lines", "n_dropped": "_dropped"}
        old = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new]
        return self._kept(docs, key, text).select(*old, *[F.col(c).alias(n) for n, c in new.items()])

    def clean(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` with the kept lines as its text (a null text stays null)."""
        rows = self._kept(docs, key, text)
        kept = F.when(F.col(f"_{docs.columns.index(text)}").isNotNull(), F.col("_kept"))
        return rows.select(*[(kept if c == text else F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def _halves(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("k1", "k2"))


def _tables(filters: pa.Table) -> list[np.ndarray]:
    rows = filters.column("tables").to_pylist() if filters.num_rows else []
    return [np.frombuffer(t, dtype=np.uint16).reshape(-1, cuckoo.SLOTS) for row in rows for t in row]


def _born(filters: pa.Table) -> list[int]:
    rows = filters.column("born").to_pylist() if filters.num_rows else []
    return [v for row in rows for v in row]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One-shot form: index ``docs`` and apply the index to them."""
    return LineIndex(docs.sparkSession, min_chars=min_chars).insert(docs, key, text).apply(docs, key, text)
