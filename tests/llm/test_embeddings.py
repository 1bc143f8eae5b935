"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import embedding_dedup
from docloom.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]
)


def brute(rows, threshold=0.93):
    """``id, n_links, component, kept`` of rows (id, vector, label), every pair compared."""

    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    linked = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is None or a != b or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i, (vid, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(ids) if ids else None
        out.append((vid, len(linked[i]), root, vid == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def clustered(rnd, n, dim):
    """Vectors around a few centres at angles on both sides of the threshold, some of them copied."""
    rows = []
    for i in range(n):
        centre = np.random.default_rng(i % 12).normal(size=dim)
        v = centre + rnd.normal(size=dim) * rnd.choice([0.02, 0.2, 0.27, 0.35])
        rows.append((v * rnd.uniform(0.1, 30)).tolist())
    rows += rows[: n // 4]
    return [(int(i), v, int(i) % 2) for i, v in zip(rnd.permutation(len(rows)), rows)]


@pytest.mark.parametrize("dim,cell", [(64, 8192), (64, 16), (10, 8), (3, 4), (1, 4)])
def test_links_equal_brute_force(spark, dim, cell):
    rows = clustered(np.random.default_rng(dim + cell), 120, dim)
    df = spark.createDataFrame(rows, VECTORS)
    want = brute(rows)
    assert got(embedding_dedup.near_duplicates(df, cell=cell)) == want
    assert got(embedding_dedup.near_duplicates(df, cell=cell, block_dims=3)) == want
    assert sum(r[1] for r in want) > 100


def test_no_pair_is_lost_between_cells():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 4)) * 0.1
    budget = 0.01
    row, code, home = embedding_dedup.place(x, x.mean(axis=0), x.std(axis=0), [2, 1, 1, 1], budget)
    cells = {}
    for r, c, h in zip(row, code, home):
        cells.setdefault(c, []).append((r, h))
    met = {}
    for members in cells.values():
        for k, (a, ha) in enumerate(members):
            for b, hb in members[:k]:
                if ha or hb:
                    met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    near = [(a, b) for a in range(400) for b in range(a) if ((x[a] - x[b]) ** 2).sum() <= budget]
    assert len(near) > 500 and all(met[frozenset(p)] == 1 for p in near)
    assert home.sum() == 400 and len(cells) > 20


def test_rotation_keeps_distances_and_does_not_depend_on_the_batch():
    rnd = np.random.default_rng(1)
    u = embedding_dedup.unit_vectors(rnd.normal(size=(50, 48)) * 1e200)
    z = embedding_dedup.rotate(u)
    assert z.shape == (50, 64) and np.allclose(z @ z.T, u @ u.T)
    assert (embedding_dedup.rotate(u[7:9]) == z[7:9]).all()
    one = embedding_dedup.rotate(np.eye(64)[:1])  # a single coordinate is spread over all
    assert np.abs(one).max() < 0.5


def test_defined_results(spark):
    e, big = [1.0, 0.0, 0.0], [1e300, 1.0, 0.0]
    rows = [
        (1, e, 1), (2, [2.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, big, 1), (4, e, None), (5, e, None), (6, None, 1), (7, [], 1),
        (8, [0.0, 0.0, 0.0], 1), (9, [0.0, -0.0, 0.0], 1), (10, [1.0, None, 0.0], 1), (11, [float("nan"), 0.0, 0.0], 1),
        (12, [float("inf"), 0.0, 0.0], 1), (13, [1.0, 0.0], 1), (14, [1.0, 0.0], 1), (None, e, 1), (None, [0.0, 1.0, 0.0], 2), (None, [0.0, 1.0, 0.0], 2),
        (15, [-1.0, 0.0, 0.0], 1), (16, e, 2),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("node", "gid", "vec", "size", "copies", "least", "n", "root", "n_links", "kept", "_id", "_label"):
        df = df.withColumn(c, F.lit("x"))
    rows = [(i, None if v is None else [1e100 if x == 1e300 else x for x in v], a) for i, v, a in rows]  # brute() squares
    out = got(embedding_dedup.near_duplicates(df))
    want = sorted([(i, n, root, True if i == root else False) for i, n, root, _ in brute(rows)], key=str)
    assert out == want
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_long_vectors(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(3, 5000))
    rows = [(i, (base[i % 3] + rnd.normal(size=5000) * 0.1).tolist(), 1) for i in range(9)]
    assert got(embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS))) == brute(rows)


def test_query_columns(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    out = QUERIES["op11_embedding_dedup"](spark, SF001)
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert got(out) == brute(rows)
