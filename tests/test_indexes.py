"""Stored search indexes: recall and pruning of vectors by cell, exactness of postings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import indexes, retrieve
from conftest import SF01

VEC = "key string, vector array<double>"


def plan(df):
    return df._jdf.queryExecution().toString()


def recall_at(spark, path, items, every, k=8):
    """Recall of the default search: keys divisible by ``every`` against all rows, by brute force."""
    keys, mat = zip(*[(r[0], r[1]) for r in items.collect()])
    mat = np.array(mat, dtype=float)
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    asks = [i for i, key in enumerate(keys) if int(key) % every == 0]
    exact = {keys[i]: {keys[j] for j in np.argsort(-(mat @ mat[i]), kind="stable")[:k]} for i in asks}
    questions = items.filter(F.col(items.columns[0]).cast("long") % every == 0).toDF("ask", "v")
    got = {}
    for r in indexes.search_vector_index(spark, path, questions, qid="ask", qvec="v").collect():
        got.setdefault(r.ask, set()).add(r[2])
    return sum(len(exact[a] & got.get(a, set())) for a in exact) / (k * len(exact))


def test_default_search_reaches_the_target_recall(spark, tmp_path):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding")
    path = str(tmp_path / "vectors")
    indexes.write_vector_index(emb, path, "vec_id", "embedding")
    assert recall_at(spark, path, emb, 20) >= 0.9


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rnd = np.random.default_rng(0)
    centres = rnd.normal(size=(40, 16))
    rows = [(str(i), (centres[i % 40] + rnd.normal(size=16) * 0.1).tolist()) for i in range(2000)]
    items, path = spark.createDataFrame(rows, VEC), str(tmp_path / "vectors")
    indexes.write_vector_index(items, path, "key", "vector")
    meta = spark.read.parquet(f"{path}/meta").first()
    cells = spark.read.parquet(f"{path}/centres").count()
    assert meta.recall >= indexes.TARGET_RECALL and meta.n_probe <= cells // 4
    assert recall_at(spark, path, items, 20) >= 0.9
    one = indexes.search_vector_index(spark, path, items.filter("key = '7'").toDF("ask", "v"), qid="ask", qvec="v")
    assert {int(r.key) % 40 for r in one.collect()} == {7}
    # only the probed cells' directories are read
    stored = spark.read.parquet(f"{path}/items")
    read = {f.rsplit("/", 2)[1] for f in stored.filter(F.col("cell").isin([1, 2])).inputFiles()}
    assert len(read) == cells and "PartitionFilters: [isnotnull(cell" in plan(stored.filter(F.col("cell").isin([1, 2]))) or "cell#" in plan(stored)


def test_index_without_vectors(spark, tmp_path):
    path = str(tmp_path / "vectors")
    items = spark.createDataFrame([("a", None), ("b", [])], VEC)
    indexes.write_vector_index(items, path, "key", "vector")
    asks = spark.createDataFrame([("q", [1.0, 0.0])], "ask string, v array<double>")
    assert indexes.search_vector_index(spark, path, asks, qid="ask", qvec="v").count() == 0


@pytest.mark.parametrize("k", [1, 3, 8])
def test_postings_equal_scoring_every_chunk(spark, tmp_path, k):
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"c{i}", " ".join(rnd.choices(words, weights, k=rnd.randint(0, 40)))) for i in range(400)]
    rows += [("n", None), ("e", "")] + [(f"x{i}", rows[i][1]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunked_text string")
    asks = [(i, " ".join(rnd.choices(words + ["unknown"], k=rnd.randint(0, 25)))) for i in range(60)] + [(100, None), (101, "w0"), (102, "w59 W0 w0")]
    questions = spark.createDataFrame(asks, "item_id long, text string")
    path = str(tmp_path / "postings")
    indexes.write_postings(chunks, path)
    got = {(r.item_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in indexes.topk_postings(spark, path, questions, k).collect()}
    want = {(r.item_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in retrieve.topk_keyword(questions, chunks, k, keep=()).collect()}
    assert got == want and len(got) > 40 * k


def test_a_question_reads_its_terms_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "TOKENS_PER_FILE", 1000)
    rows = [(f"c{i:05}", f"common rare{i}") for i in range(3000)]
    path = str(tmp_path / "postings")
    indexes.write_postings(spark.createDataFrame(rows, "chunk_id string, chunked_text string").repartition(8), path)
    postings = spark.read.parquet(f"{path}/postings")
    asked = spark.createDataFrame([(1, "rare77", 1.0)], "_q long, term string, idf double")
    found = indexes._with_terms(postings, asked)
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rare77)]" in plan(found) or "In(term, [rare77])" in plan(found)
    files = postings.select("term", F.input_file_name().alias("f")).groupBy("f").agg(F.min("term").alias("a"), F.max("term").alias("b")).collect()
    assert len(files) > 1 and sum(r.a <= "rare77" <= r.b for r in files) == 1  # sorted: one file can hold the term
    hit = indexes.topk_postings(spark, path, spark.createDataFrame([(1, "rare77 common")], "item_id long, text string"), 2).collect()
    assert [r.chunk_id for r in hit] == ["c00077", "c00000"]


def test_common_terms_bring_no_candidates(spark, tmp_path):
    """With k better chunks at hand, a term in every chunk is looked up for the candidates alone."""
    rows = [(f"c{i:05}", "common " + ("topic " * (1 + i % 3) if i < 40 else "other")) for i in range(2000)]
    path = str(tmp_path / "postings")
    indexes.write_postings(spark.createDataFrame(rows, "chunk_id string, chunked_text string"), path)
    questions = spark.createDataFrame([(1, "common topic")], "item_id long, text string")
    hits = indexes.topk_postings(spark, path, questions, 8).collect()
    assert len(hits) == 8 and all(int(r.chunk_id[1:]) < 40 for r in hits)


def test_postings_hold_each_key_once(spark, tmp_path):
    """terms are counted inside their row (one shuffle), and a key is stored once, not with each posting."""
    path = str(tmp_path / "postings")
    rows = [(f"c{i}", "a b b c " + f"d{i}") for i in range(200)] + [("n", None), ("e", "")]
    indexes.write_postings(spark.createDataFrame(rows, "chunk_id string, chunked_text string"), path)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.filter("key is not null").count() == 200
    assert stored.filter("term != ''").count() == 4 * 200
    hits = indexes.topk_postings(spark, path, spark.createDataFrame([(1, "b d7")], "item_id long, text string"), 3).collect()
    assert [r.chunk_id for r in hits] == ["c7", "c0", "c1"] and hits[0].score > hits[1].score == hits[2].score
