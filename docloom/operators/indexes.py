"""Stored search indexes (R3, R4): vectors by cell, postings by term.

An index is a folder of Parquet tables, written once and read by any later session.
Its small ``meta`` table is written last, so a folder without one is not an index.

* Vectors lie in one directory per k-means cell, and a search reads the directories
  it probes.  How many cells that takes is measured when the index is written: for a
  bounded sample of items the exact neighbours are found in the whole table, and the
  probe count is the least that reaches the target recall.
* Postings are ``(term, number, s)``, sorted by term, so that Parquet's statistics keep a search
  to the files and row groups of its terms; ``s`` is the BM25 weight without the idf.  Chunks are
  numbered, and the rows of the term "" hold each number's key, so a key is stored once.
  ``terms`` holds each term's document frequency and largest ``s``.  A search finds a lower bound
  of each question's k-th score from its rarest terms, and lets only those terms bring
  candidates that are needed to pass it: the terms whose largest weights together stay
  below the bound are looked up for the candidates alone.  The result is that of scoring
  every chunk.

Null or empty vectors and texts have no entry; an index of an empty table gives no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.text import tokens, tokens_of
from docloom.operators import retrieve
from docloom.operators.common import row_count_at_most, top_k_per_group
from docloom.session import cut_lineage

TARGET_RECALL = 0.95
SAMPLE = 256  # items whose exact neighbours set the probe count: the only sample, a bound of its own
TOKENS_PER_FILE = 8_000_000  # chunk tokens whose postings make one file
SEED_TERMS = 3  # rarest terms of a question that bring the first candidates
SEED_DEPTH = 4  # times k: candidates whose whole score is found for the lower bound
MAX_LISTED_TERMS = 1_000  # terms named in the scan's filter
SLACK = 1e-6  # above the rounding of a score
NAMES = ["term", "number", "s", "key"]  # of the postings' columns
ROWS_AT_ONCE = 100_000  # postings of one Arrow batch

# ----------------------------------------------------------------------------
# Vectors by cell


def write_vector_index(
    items: DataFrame,
    path: str,
    key: str = "chunk_id",
    vec: str = "vector",
    cells: int | None = None,
    k: int = retrieve.DEFAULT_K,
    target_recall: float = TARGET_RECALL,
    sample: int = SAMPLE,
    seed: int = 7,
) -> None:
    """Write the index of ``items`` to ``path`` and measure its probe count for top-``k`` searches."""
    spark = items.sparkSession
    usable = items.select(key, F.col(vec).cast("array<double>").alias("_v")).filter(F.size("_v") > 0)
    if usable.isEmpty():
        usable.select(key, F.col("_v").alias("_unit"), F.lit(0).alias("cell")).write.parquet(f"{path}/items")
        spark.createDataFrame([], "cell int, centroid array<double>").write.parquet(f"{path}/centres")
        spark.createDataFrame([(0, k, 1.0)], "n_probe int, k int, recall double").write.parquet(f"{path}/meta")
        return
    assigned, centres = retrieve.build_ivf(usable, key, "_v", cells, seed)
    # dealt by range over (cell, key): a cell of any size is spread over as many files as it needs
    assigned.repartitionByRange("cell", key).write.partitionBy("cell").parquet(f"{path}/items")
    centres.write.parquet(f"{path}/centres")
    stored, centres = spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/centres")

    asks = cut_lineage(usable.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select(F.monotonically_increasing_id().alias("_ask"), "_v"))
    exact = retrieve.topk_semantic(asks, stored, k=k, qid="_ask", qvec="_v", key=key, vec="_unit").select("_ask", key)
    ranked = retrieve.topk_semantic(asks, centres, k=centres.count(), qid="_ask", qvec="_v", key="cell", vec="centroid")
    at = exact.join(stored.select(key, "cell"), key).join(ranked.select("_ask", "cell", "rank"), ["_ask", "cell"])
    # at most a row per cell: neighbours that lie in the n-th nearest cell of their question
    found = at.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).orderBy("rank").collect()
    total, so_far, n_probe = sum(r["n"] for r in found), 0, 1
    for r in found:
        so_far, n_probe = so_far + r["n"], r["rank"]
        if so_far >= target_recall * total:
            break
    meta = spark.createDataFrame([(int(n_probe), k, so_far / total if total else 1.0)], "n_probe int, k int, recall double")
    meta.write.parquet(f"{path}/meta")


def search_vector_index(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int | None = None,
    qid: str = "item_id",
    qvec: str = "vector",
    n_probe: int | None = None,
) -> DataFrame:
    """``(qid, rank, key, score)``: cosine top-k from the cells nearest to each question.  ``k``
    and ``n_probe`` default to what the index was measured for; only probed cells are read."""
    meta = spark.read.parquet(f"{path}/meta").first()
    stored = spark.read.parquet(f"{path}/items")
    return retrieve.topk_ann(
        questions,
        stored,
        k=k or meta["k"],
        qid=qid,
        qvec=qvec,
        key=stored.columns[0],
        n_probe=max(1, n_probe or meta["n_probe"]),
        index=(stored, spark.read.parquet(f"{path}/centres")),
    )


# ----------------------------------------------------------------------------
# Postings by term


def _postings(mean: float, k1: float, b: float, key_type: pa.DataType):
    """Arrow batches of ``(key, tokens)`` to ``(term, number, s, key)``: a row per distinct term of a chunk,
    and one with the term "" and the key."""

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            toks, keys = batch.column(1), batch.column(0).cast(key_type)
            lengths = toks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = toks.flatten().dictionary_encode()
            width = len(words.dictionary)
            doc = np.repeat(np.arange(len(toks), dtype=np.int64), lengths)
            pairs, tf = np.unique(doc * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            tf, dl = tf.astype(np.float64), lengths[pairs // width]
            s = tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * dl / mean))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat("", len(toks)), pa.array(first + np.arange(len(toks))), pa.nulls(len(toks), pa.float64()), keys], names=NAMES
            )
            for lo in range(0, len(pairs), ROWS_AT_ONCE):
                at = slice(lo, lo + ROWS_AT_ONCE)
                term = words.dictionary.take(pa.array(pairs[at] % width))
                number = pa.array(first + pairs[at] // width)
                yield pa.RecordBatch.from_arrays([term, number, pa.array(s[at]), pa.nulls(len(term), key_type)], names=NAMES)
            first += len(toks)

    return run


def write_postings(
    chunks: DataFrame,
    path: str,
    key: str = "chunk_id",
    text: str = "chunked_text",
    k1: float = retrieve.BM25_K1,
    b: float = retrieve.BM25_B,
) -> None:
    """Write the BM25 postings of ``chunks`` (one row per key) to ``path``."""
    spark = chunks.sparkSession
    rows = chunks.select(F.col(key), tokens_of(chunks, text).alias("_toks"))
    size = rows.agg(F.count("_toks").alias("n"), F.sum(F.size("_toks")).alias("total")).first()  # a null text is no chunk
    n, total = int(size["n"]), int(size["total"] or 0)
    mean = total / n if total else 1.0
    schema = T.StructType([*T._parse_datatype_string("term string, number long, s double").fields, T.StructField("key", chunks.schema[key].dataType)])
    # terms are counted inside their row, so that only the postings themselves are shuffled, once
    each = rows.filter(F.size("_toks") > 0).mapInArrow(_postings(mean, k1, b, to_arrow_type(schema["key"].dataType)), schema)
    files = max(1, -(-total // TOKENS_PER_FILE))
    ordered = each.repartitionByRange(files, "term", "number").sortWithinPartitions("term", "number")
    ordered.write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings").filter(F.col("term") != "")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("s").alias("most")).write.parquet(f"{path}/terms")
    spark.createDataFrame([(n, mean, key)], "n long, mean double, key string").write.parquet(f"{path}/meta")


def _with_terms(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of the asked terms, with the asking rows; the terms are named in the scan
    where they are few."""
    terms = asked.select("term").distinct()
    if row_count_at_most(terms, MAX_LISTED_TERMS):
        postings = postings.filter(F.col("term").isin([r["term"] for r in terms.collect()]))
    small = row_count_at_most(asked, retrieve.MAX_BROADCAST_QUESTION_TERMS)
    return postings.join(F.broadcast(asked) if small else asked, "term")


def topk_postings(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int = retrieve.DEFAULT_K,
    qid: str = "item_id",
    qtext: str = "text",
) -> DataFrame:
    """``(qid, rank, key, score)``: BM25 top-k of every question from the stored postings."""
    meta = spark.read.parquet(f"{path}/meta").first()
    stored = spark.read.parquet(f"{path}/postings")
    postings, key = stored.filter(F.col("term") != "").select("term", "number", "s"), "number"
    keys = stored.filter(F.col("term") == "").select("number", "key")
    idf = F.log(1.0 + (F.lit(float(meta["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = questions.select(F.col(qid).alias("_q"), F.explode(F.array_distinct(tokens(qtext))).alias("term")).distinct()
    known = asked.join(spark.read.parquet(f"{path}/terms"), "term")
    asked = cut_lineage(known.select("_q", "term", "df", idf.alias("idf"), (idf * F.col("most")).alias("most")))
    weight = F.col("idf") * F.col("s")

    def whole(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """Score of each (_q, key) from ``terms``, on top of its ``part``."""
        wanted = pairs.join(terms.select("_q", "term", "idf"), "_q")
        hits = wanted.join(postings, ["term", key]).groupBy("_q", key).agg(F.sum(weight).alias("more"))
        return pairs.join(hits, ["_q", key], "left").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0.0)))

    # a lower bound of the k-th score: whole scores of what the rarest terms find
    rarest = top_k_per_group(asked, ["_q"], [F.asc("df"), F.asc("term")], SEED_TERMS).select("_q", "term", "idf")
    first = _with_terms(postings, rarest).groupBy("_q", key).agg(F.sum(weight).alias("seed"))
    some = cut_lineage(top_k_per_group(first, ["_q"], [F.desc("seed"), F.asc(key)], SEED_DEPTH * k).select("_q", key, F.lit(0.0).alias("part")))
    best = top_k_per_group(whole(some, asked), ["_q"], [F.desc("score"), F.asc(key)], k)
    bound = best.filter(F.col("rank") == k).select("_q", F.col("score").alias("bound"))

    # terms that cannot reach the bound together bring no candidates
    below = F.sum("most").over(Window.partitionBy("_q").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    parted = asked.join(bound, "_q", "left").withColumn("below", below)
    silent = F.coalesce(F.col("below") < F.col("bound") - SLACK, F.lit(False))
    parted = cut_lineage(parted.withColumn("silent", silent))
    rest = parted.groupBy("_q").agg(F.sum(F.when(F.col("silent"), F.col("most")).otherwise(0.0)).alias("rest"), F.max("bound").alias("bound"))
    loud = _with_terms(postings, parted.filter(~F.col("silent")).select("_q", "term", "idf"))
    partial = loud.groupBy("_q", key).agg(F.sum(weight).alias("part")).join(rest, "_q")
    alive = partial.filter(F.col("bound").isNull() | (F.col("part") + F.col("rest") >= F.col("bound") - SLACK)).select("_q", key, "part")
    scored = whole(cut_lineage(alive), parted.filter("silent"))
    scored = scored.select("_q", key, F.round("score", retrieve.SCORE_DIGITS).alias("score")).filter("score > 0")
    scored = scored.join(keys, "number")  # equal scores are ordered by key
    return retrieve._ranked(scored, "_q", "key", k).select(F.col("_q").alias(qid), "rank", F.col("key").alias(meta["key"]), "score")
