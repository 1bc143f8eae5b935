import pytest
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import embed, retrieve
from docloom.session import cut_lineage
from conftest import SF01

DOCS = [
    ("c1", "the cat sat on the mat", "p1"),
    ("c2", "the dog sat on the log", "p2"),
    ("c3", "cats and dogs", "p3"),
    ("c4", "a cat a cat a cat", "p4"),
    ("c5", "nothing in common here", "p5"),
    ("c6", "the cat sat on the mat", "p6"),  # same text as c1, other key: equal scores
]
QUESTIONS = [(1, "cat on mat"), (2, "dog log"), (3, "zzz"), (4, "the")]


def tok(s):
    return re.findall(r"[^\W_]+", s.lower())


def brute_bm25(k=3, k1=1.2, b=0.75):
    docs = {key: tok(t) for key, t, _ in DOCS}
    n = len(docs)
    avgdl = sum(map(len, docs.values())) / n
    df = Counter(t for d in docs.values() for t in set(d))
    out = {}
    for q, text in QUESTIONS:
        scores = {}
        for key, d in docs.items():
            tf = Counter(d)
            s = 0.0
            for t in set(tok(text)):
                if tf[t]:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avgdl))
            if s > 0:
                scores[key] = round(s, 9)
        out[q] = [key for key, _ in sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:k]]
    return out


def test_bm25_equals_brute_force_with_ties(spark):
    chunks = spark.createDataFrame(DOCS, "chunk_id string, chunked_text string, path string")
    qs = spark.createDataFrame(QUESTIONS, "item_id long, text string")
    hits = retrieve.topk_keyword(qs, chunks, k=3).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.item_id, r.rank)):
        got.setdefault(r.item_id, []).append(r.chunk_id)
    want = {q: v for q, v in brute_bm25().items() if v}
    assert got == want
    assert got[1][:2] == ["c1", "c6"]  # equal scores: key ascending
    assert {r.path for r in hits if r.chunk_id == "c4"} == {"p4"}


def test_bm25_empty_inputs(spark):
    chunks = spark.createDataFrame(DOCS, "chunk_id string, chunked_text string, path string")
    qs = spark.createDataFrame([(1, "")], "item_id long, text string")
    assert retrieve.topk_keyword(qs, chunks, k=3).count() == 0


def test_semantic_equals_numpy(spark):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(300, 16))
    queries = rng.normal(size=(5, 16))
    idf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q long, vector array<double>")
    hits = retrieve.topk_semantic(qdf, idf.repartition(7), k=5, qid="q", key="vec_id", vec="embedding").collect()
    un = items / np.linalg.norm(items, axis=1, keepdims=True)
    for qi, qv in enumerate(queries):
        s = np.round(un @ (qv / np.linalg.norm(qv)), 9)
        want = sorted(range(len(s)), key=lambda j: (-s[j], j))[:5]
        got = [r.vec_id for r in sorted((h for h in hits if h.q == qi), key=lambda h: h.rank)]
        assert got == want


def test_semantic_ties_break_on_key(spark):
    items = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "q long, v array<double>")
    hits = retrieve.topk_semantic(q, items, k=2, qid="q", qvec="v", key="vec_id", vec="v").orderBy("rank").collect()
    assert [h.vec_id for h in hits] == [1, 3]


def test_ann_recall_against_exact(spark):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    cents = embed.centroids(emb, "label", "embedding")
    exact = retrieve.topk_semantic(cents, emb, k=8, qid="label", qvec="centroid", key="vec_id", vec="embedding")
    e = {(r.label, r.vec_id) for r in exact.collect()}
    index = retrieve.build_ivf(emb, "vec_id", "embedding", cells=8)

    def recall(n_probe):
        approx = retrieve.topk_ann(cents, emb, k=8, qid="label", qvec="centroid", key="vec_id", vec="embedding",
                                   n_probe=n_probe, index=index)
        a = {(r.label, r.vec_id) for r in approx.collect()}
        return len(a & e) / len(e)

    assert recall(8) == 1.0  # probing every cell is exact
    assert recall(4) >= 0.5


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "item_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "item_id long, chunk_id string, rank int")
    fused = retrieve.fuse_ranks([a, b], k=3).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["y", "x", "z"]
    assert abs(fused[0].score - (1 / 61 + 1 / 62)) < 1e-12


def test_source_list(spark):
    hits = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "b")], "item_id long, rank int, path string")
    assert retrieve.source_list(hits).collect()[0].sources == ["b", "a"]


def test_hashed_encoder_counts_tokens(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "id long, text string")
    rows = {r.id: r.vector for r in embed.embed(df, "text", dims=8).collect()}
    assert sum(rows[1]) == 3 and len(rows[1]) == 8 and max(rows[1]) == 2
    assert rows[2] is None


def test_injected_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    rows = {r.id: r.vec for r in embed.embed(df, "text", "vec", method="encoder",
                                             encoder=lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert rows == {1: [2.0, 1.0], 2: [4.0, 1.0]}


def test_question_batches_give_the_same_answer(spark, monkeypatch):
    chunks = spark.createDataFrame([("c%d" % i, "word%d common text %d" % (i % 7, i), "p") for i in range(120)],
                                   "chunk_id string, chunked_text string, path string")
    qs = spark.createDataFrame([(i, "word%d common" % (i % 7)) for i in range(40)], "item_id long, text string")
    whole = sorted((r.item_id, r.rank, r.chunk_id) for r in retrieve.topk_keyword(qs, chunks, k=3).collect())
    monkeypatch.setattr(retrieve, "MAX_BROADCAST_QUESTIONS", 6)
    batched = sorted((r.item_id, r.rank, r.chunk_id) for r in retrieve.topk_keyword(qs, chunks, k=3).collect())
    assert whole == batched


def test_ivf_trains_on_the_callers_rows_but_assigns_every_item(spark):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    assigned, centres = retrieve.build_ivf(emb, "vec_id", "embedding", cells=4, train=emb.limit(100))
    assert assigned.count() == emb.count()
    assert centres.count() == 4


def test_semantic_ranks_only_vectors_of_the_questions_length(spark):
    items = [(i, [1.0, float(i)]) for i in range(4)] + [(10 + i, [1.0, 2.0, float(i)]) for i in range(9)]
    frame = spark.createDataFrame(items, "vec_id long, v array<double>")
    qs = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0, 2.0, 3.0])], "q long, v array<double>")
    for parts in (1, 5):
        hits = retrieve.topk_semantic(qs, frame.repartition(parts), k=3, qid="q", qvec="v", key="vec_id", vec="v").collect()
        assert {h.vec_id for h in hits if h.q == 0} <= {0, 1, 2, 3}
        assert sorted(h.rank for h in hits if h.q == 0) == [1, 2, 3]
        assert all(h.vec_id >= 10 for h in hits if h.q == 1)


def test_running_top_k_memory_does_not_grow_with_rows():
    rng = np.random.default_rng(0)
    best, seen, most = retrieve._Best(50, 8), [], 0
    for block in range(60):
        scores = np.round(rng.random((400, 50)), 2)  # many ties
        keys = np.array([f"k{block:03d}{i:04d}" for i in rng.permutation(400)], dtype=object)
        best.add(scores, keys, 0.0)
        most = max(most, len(best.q) + best.pending)
        seen.append((scores, keys))
    best.cut()
    assert most <= best.limit + 400 * 50
    scores, keys = np.concatenate([s for s, _ in seen]), np.concatenate([k for _, k in seen])
    for q in range(50):
        want = sorted(range(len(keys)), key=lambda i: (-scores[i, q], keys[i]))[:8]
        assert list(best.keys[best.q == q]) == [keys[i] for i in want]


def test_hybrid_answer_does_not_depend_on_the_batch(spark):
    docs = [(f"c{i:02d}", f"alpha beta w{i}", "p", [1.0, float(i)]) for i in range(20)]
    chunks = spark.createDataFrame(docs, "chunk_id string, chunked_text string, path string, vector array<double>")
    rows = [(0, "alpha w3", [1.0, 0.0]), (1, "palabras ajenas", [0.2, 1.0]), (2, "?!", [1.0, 1.0]), (3, None, [1.0, 2.0]), (4, "beta w5", None)]
    qs = spark.createDataFrame(rows, "item_id long, text string, vector array<double>")

    def hits(only):
        part = qs.filter(F.col("item_id").isin(only))
        got = retrieve.topk_hybrid(part, chunks, k=4, question_vectors=part, chunk_vectors=chunks).collect()
        return {q: sorted((r["rank"], r.chunk_id, r.score) for r in got if r.item_id == q) for q in only}

    together = hits([0, 1, 2, 3, 4])
    assert all(len(x) == 4 for x in together.values())
    assert hits([1, 2, 3]) == {q: together[q] for q in (1, 2, 3)}  # no question term occurs
    assert hits([4]) == {4: together[4]}  # no question has a vector
    semantic = retrieve.topk_semantic(qs.filter("item_id in (1, 2, 3)"), chunks, k=4).collect()
    assert {(r.item_id, r["rank"], r.chunk_id) for r in semantic} == {(q, n, c) for q in (1, 2, 3) for n, c, _ in together[q]}


def test_hybrid_fuses_uncut_ranks(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(f"c{i:04d}", " ".join(rng.choice(vocab, size=rng.integers(3, 30))), "p") for i in range(400)]
    chunks = spark.createDataFrame(docs, "chunk_id string, chunked_text string, path string").repartition(5)
    qs = spark.createDataFrame([(i, " ".join(rng.choice(vocab, size=6))) for i in range(6)], "item_id long, text string")
    every = 400
    semantic = retrieve.topk_semantic(embed.embed(qs, "text"), embed.embed(chunks, "chunked_text"), k=every).filter("score > 0")
    keyword = retrieve.topk_keyword(qs, chunks, k=every, keep=())
    want = retrieve.fuse_ranks([semantic, keyword], k=8).collect()
    got = retrieve.topk_hybrid(qs, chunks, k=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_tfidf_vectors_against_brute_force(spark):
    import hashlib
    import math

    from docloom.operators import embed

    texts = ["red house", "red red car", "", None, "blue car and house", "red"]
    dims = 32
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.vector for r in embed.embed(df, "text", "vector", method="tfidf", dims=dims).collect()}
    buckets = {i: [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dims for w in t.split()] for i, t in enumerate(texts) if t is not None}
    for i, mine in buckets.items():
        want = [0.0] * dims
        for b in mine:
            df_b = sum(b in other for other in buckets.values())
            want[b] += math.log((1 + len(buckets)) / (1 + df_b)) + 1
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in want])
    assert got[3] is None
    idf = embed.fit_idf(df, "text", dims)
    asked = embed.embed(df.limit(1), "text", "vector", method="tfidf", dims=dims, idf=idf).first().vector
    assert asked == pytest.approx(got[0])
    empty = embed.embed(df.limit(0), "text", "vector", method="tfidf", dims=dims)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        embed.embed(df, "text", "vector", method="tfidf", dims=dims, idf=idf[:5])


def test_common_terms_are_pruned_without_loss():
    """over several blocks the pruned search gives the scores of every chunk, ties by key."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n_v, n_q, n = 300, 40, 3000
    share = 1.0 / np.arange(1, n_v + 1)
    vocab = [f"w{i:03d}" for i in range(n_v)]
    docs = [[vocab[t] for t in rng.choice(n_v, 30, p=share / share.sum())] for _ in range(n)]
    docs[100:200] = docs[:100]
    lists = [np.sort(rng.choice(n_v, 12, replace=False)) for _ in range(n_q)]
    idf = np.log(2.0 + np.arange(n_v))

    class Index:
        value = (n_q, pa.array(vocab), idf, 12 * np.arange(n_q + 1), np.concatenate(lists), 1.2, 0.75, 30.0)

    keys = [f"k{i:05d}" for i in rng.permutation(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 500]), pa.array(docs[a : a + 500])], names=["k", "t"]) for a in range(0, n, 500)]
    found, every = retrieve._Best(n_q, 5), retrieve._Best(n_q, 5)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(retrieve, "FIRST_POSTINGS", 2000)
        retrieve._bm25_tops(Index)(iter(batches), found)
        for block, scores in retrieve._bm25_blocks(Index)(iter(batches)):
            every.add(scores, block, 1e-300)
    found.cut(), every.cut()
    assert list(found.q) == list(every.q) and list(found.s) == list(every.s) and list(found.keys) == list(every.keys)


def test_exact_ranks_are_counted_for_all_questions_at_once(spark):
    """ranks of given pairs, ties by key, beside questions that nothing is asked of."""
    rng = np.random.default_rng(9)
    vectors = rng.integers(0, 3, (300, 3)).astype(float)  # many equal scores
    items = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "chunk_id string, vector array<double>").repartition(4)
    asked = [(q, v.tolist()) for q, v in enumerate(rng.integers(1, 4, (7, 3)).astype(float))]
    qvecs = spark.createDataFrame(asked, "_q long, _v array<double>")
    source = retrieve._vector_source(qvecs, items, qvecs.schema["_q"], "chunk_id", "vector", float(np.nextafter(0.0, 1.0)))
    all_ranks = {(r._q, r.chunk_id): (r.score, r["rank"]) for r in source.top(300).collect()}
    some = [(q, key, s) for (q, key), (s, n) in sorted(all_ranks.items()) if q not in (0, 4) and rng.random() < 0.2]
    assert len({s for _, _, s in some}) < len(some)
    scored = spark.createDataFrame(some, "_q long, chunk_id string, score double")
    got = {(r._q, r.chunk_id): r["rank"] for r in source.ranks_of(scored).collect()}
    assert got == {(q, key): all_ranks[q, key][1] for q, key, _ in some}
    assert source.ranks_of(scored.limit(0)).count() == 0


def test_keyword_search_of_a_part_first_gives_the_same_answer(spark, monkeypatch):
    """every task starts from scores that k rows of the whole table reach, and sends few rows."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(600)]
    texts[300:330] = texts[:30]
    chunks = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, chunked_text string").repartition(8)
    # the last question has more terms than 16 bits of bounds can hold, the first fewer hits than k
    asked = [(0, "w1"), *[(q, " ".join(rng.choice(words, 9))) for q in range(1, 12)], (12, " ".join(words))]
    asks = spark.createDataFrame(asked, "item_id long, text string")

    def rows():
        return sorted(tuple(r) for r in retrieve.topk_keyword(asks, chunks, k=5, keep=()).collect())

    whole = rows()
    made = []
    least_scores = retrieve._Source.least_scores
    monkeypatch.setattr(retrieve, "PART", 3)
    monkeypatch.setattr(retrieve, "PART_ROWS", 40)
    monkeypatch.setattr(retrieve._Source, "least_scores", lambda s, k: made.append((s, least_scores(s, k))) or made[-1][1])
    assert rows() == whole
    source, least = made[-1]  # the outermost ends last
    assert [s.n_rows for s, _ in made] == [66, 200, 600]
    kth = {q: min(s for i, _, _, s in whole if i == q) for q in range(1, 13)}
    assert all(-np.inf < least.value[i] <= kth[q] for i, q in enumerate(source.qids) if q)

    def sent(least):
        best_of = source._best(5, least)

        def run(batches):
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([len(best_of(batches).q)])], names=["n"])

        return source.rows.mapInArrow(run, "n long").groupBy().sum().first()[0]

    assert sent(least) < sent(None) / 2


def test_hybrid_counts_ranks_only_of_what_can_win(spark, monkeypatch):
    """of the two heads only keys that may be among the first k get an exact rank; the answer is the same."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    chunks = spark.createDataFrame(
        [(f"c{i:03d}", " ".join(rng.choice(words, 12))) for i in range(500)], "chunk_id string, chunked_text string"
    ).repartition(4)
    asks = spark.createDataFrame([(q, " ".join(rng.choice(words, 6))) for q in range(8)], "item_id long, text string")
    # vectors that have nothing to do with the texts: few keys are in both heads
    items = cut_lineage(spark.createDataFrame([(f"c{i:03d}", rng.normal(size=8).tolist()) for i in range(500)], "chunk_id string, vector array<double>"))
    vectors = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(8)], "item_id long, vector array<double>")
    counted = []
    ranks_of = retrieve._Source.ranks_of
    monkeypatch.setattr(retrieve._Source, "ranks_of", lambda s, scored: counted.append((s.n_rows, scored.count())) or ranks_of(s, scored))

    def rows():
        counted.clear()
        return sorted(tuple(r) for r in retrieve.topk_hybrid(asks, chunks, k=4, question_vectors=vectors, chunk_vectors=items).collect())

    whole = rows()
    semantic = retrieve.topk_semantic(vectors, items, k=500).filter("score > 0")
    ranks = [{(r.item_id, r.chunk_id): r["rank"] for r in hits.collect()} for hits in (semantic, retrieve.topk_keyword(asks, chunks, k=500, keep=()))]
    for q in range(8):
        fused = {key: round(sum(1 / (60 + x[q, key]) for x in ranks if (q, key) in x), 12) for i, key in {**ranks[0], **ranks[1]} if i == q}
        assert [(i, key) for i, _, key, _ in whole if i == q] == [(q, key) for key in sorted(fused, key=lambda key: (-fused[key], key))[:4]]
    every = sum(n for _, n in counted)
    monkeypatch.setattr(retrieve, "PART", 3)
    monkeypatch.setattr(retrieve, "PART_ROWS", 50)
    assert rows() == whole
    of_all = [n for size, n in counted if size in (0, 500)]  # the vectors' table, whose size is not known, and the chunks
    assert 0 < sum(of_all) < every < 8 * 2 * (60 + 2 * 4) * 0.8
