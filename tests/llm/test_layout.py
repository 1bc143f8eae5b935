"""Sharding, packing, WARC archives and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import packing, rule_ensemble, sharding, warc
from docloom.llm.common import with_row_index
from docloom.llm.queries import QUERIES, held_out
from llm_fixtures import edges, make_docs  # noqa: F401
from test_dedup import brute_lines, fingerprint, least_reachable
from test_select import brute_leaks

SF001 = "/root/testdata/sf0.001"


# -- order ---------------------------------------------------------------------------


def test_row_index_over_a_hot_value(spark):
    rows = [(1, i, i % 5 + 1) for i in range(500)] + [(k, 0, 7) for k in (0, 2, None)]
    df = spark.createDataFrame(rows, "k long, i long, w long").repartition(7)
    got = sorted(with_row_index(df, ["k", "i"], "at", {"run": "w"}).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(503))
    assert [(r.k, r.i) for r in got] == [(0, 0), *[(1, i) for i in range(500)], (2, 0), (None, 0)]
    assert [r.run for r in got] == list(np.cumsum([r.w for r in got]))


# -- sharding --------------------------------------------------------------------------


def least_capacity(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("blocks", [2, 9, 4096])
def test_minimax_capacity_equals_brute_force(spark, blocks):
    rnd = random.Random(blocks)
    for case in range(3):
        sizes = [rnd.choice([1, 5, 40, 300]) for _ in range(rnd.randint(1, 80))] + ([5000] if case == 1 else [])
        rnd.shuffle(sizes)
        table = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "end long").cache()
        ends = sharding.GroupEnds(table, sum(sizes), blocks)
        capacity = sharding.minimax_capacity(ends, max(sizes), 7)
        assert capacity == least_capacity(sizes, 7)
        cuts = [0, *sharding.balanced_cuts(ends, capacity, 7), sum(sizes)]
        assert all(b - a <= capacity and a <= b for a, b in zip(cuts, cuts[1:])) and set(cuts) <= {0, *np.cumsum(sizes)}


def test_shards(make_docs, edges):
    rnd = random.Random(9)
    texts = ["é" * rnd.randint(0, 50) for _ in range(300)] + ["hot " * 30] * 150 + [None, ""]
    rnd.shuffle(texts)
    rows = sharding.shard(make_docs(list(enumerate(texts)), clash=True), shards=6, max_blocks=16).collect()
    assert len(rows) == len(texts)
    slots, load, where = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        where[body].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    assert all(len(s) == 1 for s in where.values())
    first = {}
    for i, t in enumerate(texts):
        first.setdefault((t or ""), i)
    sizes = [(len(t.encode()) + 1) * sum((x or "") == t for x in texts) for t in sorted(first, key=first.get)]
    assert max(load.values()) <= least_capacity(sizes, 6)
    assert len(sharding.shard(edges).collect()) == edges.count()
    assert sharding.shard(make_docs([])).count() == 0


# -- packing -----------------------------------------------------------------------------


def bin_price(c, cost, attention):
    return cost + c + c * c / attention


def best_fit(sizes, capacities, cost, attention):
    """Piece by piece; a new bin's size by filling one of each size from what is left."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        fits = [b for b in bins if b[0] >= left[0]]
        if fits:
            bin_ = min(fits, key=lambda b: b[0])
        else:
            prices = []
            for c in sorted(capacities):
                if c >= left[0]:
                    held = 0
                    for s in left:
                        held += s if held + s <= c else 0
                    prices.append((bin_price(c, cost, attention) / held, c))
            bin_ = [min(prices)[1], 0]
            bins.append(bin_)
        s = left.pop(0)
        bin_[0], bin_[1] = bin_[0] - s, bin_[1] + s
    return sorted(b[1] for b in bins)


def test_plan_on_counts_packs_as_piece_by_piece():
    rnd = random.Random(1)
    for _ in range(400):
        capacities = sorted(rnd.sample(range(5, 60), 3))
        sizes = [rnd.randint(1, capacities[-1]) for _ in range(rnd.randint(1, 120))]
        attention = rnd.choice([20, 60, 1000])
        rules, bins = packing.plan(list(Counter(sizes).items()), capacities, 4, attention)
        used = sorted(u for _, n, u, _ in bins for _ in range(n))
        assert used == best_fit(sizes, capacities, 4, attention)
        assert all(min(c for c in capacities if c >= u) == cap for _, _, u, cap in bins)


def test_sizes_are_chosen_jointly():
    rnd = random.Random(3)
    sizes = [min(4096, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000)]
    counts = list(Counter(sizes).items())

    def spent(capacities):
        _, bins = packing.plan(counts, capacities)
        assert sum(n * u for _, n, u, _ in bins) == sum(sizes)
        of_size = Counter()
        for _, n, _, cap in bins:
            of_size[cap] += n
        return sum(n * bin_price(cap, packing.BIN_COST, packing.ATTENTION) for cap, n in of_size.items()), of_size

    joint, used = spent(packing.CAPACITIES)
    assert sum(n > 50 for n in used.values()) >= 3
    assert joint < 0.95 * spent((4096,))[0]
    one_size = packing.plan(counts, (4096,))[1]  # the largest size only, each bin downsized afterwards
    downsized = [(n, min(c for c in packing.CAPACITIES if c >= u)) for _, n, u, _ in one_size]
    assert joint < 0.95 * sum(n * bin_price(c, packing.BIN_COST, packing.ATTENTION) for n, c in downsized)


def test_a_very_long_text_is_packed_whole(make_docs):
    rows = packing.pack(make_docs([(1, "w " * 1_000_000), (2, "w")])).collect()
    parts = sorted((r.start, r.stop) for r in rows if r.doc_id == 1)
    assert parts[0][0] == 0 and parts[-1][1] == 1_000_000 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert len({r.bin_id for r in rows}) <= len(parts) and all(r.offset + r.size <= r.capacity for r in rows)


def test_pack(make_docs, edges):
    rnd = random.Random(2)
    texts = {i: " ".join(["w"] * rnd.choice([0, 1, 3, 3, 3, 9, 14, 40, 200])) for i in range(300)}
    rows = packing.pack(make_docs(list(texts.items()), clash=True), capacities=(8, 16, 32), bin_cost=2, attention=64).collect()
    parts, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.size == r.stop - r.start + 1
        parts[r.doc_id].append((r.piece, r.start, r.stop))
        bins[r.bin_id].append(r)
    for i, t in texts.items():
        cuts = sorted(parts[i])
        assert [p for p, _, _ in cuts] == list(range(len(cuts))) and cuts[0][1] == 0 and cuts[-1][2] == len(t.split())
        assert all(a[2] == b[1] for a, b in zip(cuts, cuts[1:]))
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        assert members[0].offset == 0 and all(a.offset + a.size == b.offset for a, b in zip(members, members[1:]))
        used = members[-1].offset + members[-1].size
        assert {(r.bin_used, r.capacity) for r in members} == {(used, min(c for c in (8, 16, 32) if c >= used))}
    assert sorted(sum(r.size for r in m) for m in bins.values()) == best_fit([r.size for r in rows], (8, 16, 32), 2, 64)
    assert sorted(bins) == list(range(len(bins)))
    assert len(packing.pack(edges).collect()) == edges.count()
    assert packing.pack(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), capacities=())


# -- WARC ----------------------------------------------------------------------------------


def page_rows():
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n", "", None, "<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n", "x" * 300_000, "", "plain"]
    return [(i, f"http://h/{i}\r\nX: y é", h) for i, h in enumerate(html)] + [(7, None, "plain"), (6, "http://h/6", "plain"), (None, "u", "plain"), (None, "u", "alone")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("_first", F.lit(1)).withColumn("payload", F.lit("p"))
    index = warc.write_archives(pages.repartition(3), roll_bytes=500)
    assert index.select("file").distinct().count() > 2
    rows = warc.read_records(index).collect()
    got = sorted((r.page_id if r.page_id is not None else 99, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    bodies = [(i if i is not None else 99, (h or "").encode()) for i, _, h in page_rows()]
    least = {}
    for i, b in bodies:
        least[b] = min(i, least.get(b, 99))

    def digest(b):
        return base64.b32encode(hashlib.sha1(b).digest()).decode()

    want = [(i, *(("response", None) if i == least[b] else ("revisit", least[b])), len(b), digest(b)) for i, b in bodies]
    assert got == sorted(want)
    by = {r.page_id: r for r in rows if r.record_type == "response"}
    assert bytes(by[0].payload) == bodies[0][1] and by[4].payload_bytes == 300_000
    some = warc.read_records(index.filter("page_id in (0, 4)"), gap=0, most=1).collect()
    assert {r.page_id for r in some} == {0, 4}
    whole = warc.read_records(warc.write_archives(pages, min_revisit_bytes=10)).filter("record_type = 'revisit'").collect()
    assert {r.page_id for r in whole} == {3}
    empty = warc.write_archives(pages.limit(0))
    assert empty.count() == 0 and warc.read_records(empty).count() == 0


def test_warc_tasks_follow_archive_bytes_and_joins_agree(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 5000 if i % 3 == 0 else f"page {i} " * 40) for i in range(60)], "page_id long, url string, html string")
    index = warc.write_archives(pages, roll_bytes=2000)
    stored = sum(r.length for r in index.collect())
    records = warc.read_records(index, read_bytes=stored // 12)
    assert records.rdd.getNumPartitions() >= 12
    want = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in records.collect())
    assert [x[0] for x in want if x[1] == "response"] == [i for i in range(60) if i == 0 or i % 3]
    shuffled = warc.read_records(warc.write_archives(pages, max_broadcast=0))
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in shuffled.collect()) == want


def test_warc_very_long_page(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(1000)) * 3000
    pages = spark.createDataFrame([(1, "a", text), (2, "b", text), (3, "c", "short")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.read_records(warc.write_archives(pages)).collect()}
    assert rows[1].payload.decode() == text and rows[2].refers_to == 1 and rows[2].payload_bytes == 3_000_000


def test_ranges_are_joined():
    runs = list(warc._reads(["a", "a", "a", "b"], [0, 10, 100, 0], [10, 5, 5, 5], gap=20, most=60))
    assert runs == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 100, 5, [(100, 5)]), ("b", 0, 5, [(0, 5)])]


# -- pipeline ---------------------------------------------------------------------------------


def brute_near(texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    root = least_reachable(fps, lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 3)
    return {i: t for i, t in texts.items() if root[i] == i}


def test_stages_take_their_decisions(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = rule_ensemble.fit(docs, labels.filter(~held_out()))
    rejected = {r.doc_id for r in rule_ensemble.score(docs, model).collect() if r.score < rule_ensemble.THRESHOLD}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()}
    steps = [
        lambda t: {i: x for i, x in t.items() if i not in rejected},
        lambda t: {i: kept for i, (_, _, kept) in brute_lines(t).items()},
        brute_near,
        lambda t: {i: x for i, x in t.items() if i not in {d for d, _ in brute_leaks(t, items)}},
    ]
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], steps):
        out = stage(spark, docs, SF001)
        rows = out.collect()
        texts = step(texts)
        assert out.columns == columns, name
        assert {r.doc_id: r.text for r in rows} == texts, name
        assert all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).collect())) == sorted(map(tuple, packed))


def test_stages_on_edges(spark, edges, make_docs):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, edges, SF001)
        if (name, stage) != corpus_pipeline.STAGES[-1]:
            assert rows.columns == edges.columns, name
        rows.collect()
        assert stage(spark, make_docs([]), SF001).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_with_a_row_per_input(spark, name):
    rows = QUERIES[name](spark, SF001)
    n = rows.count()
    if name == "op9_warc":
        assert n == spark.read.parquet(f"{SF001}/pages.parquet").count()
    elif name == "op11_embedding_dedup":
        assert n == spark.read.parquet(f"{SF001}/embeddings.parquet").count()
    elif name not in ("op6_packing", "op10_decontaminate", "op12_conversation_trie", "op13_collocations"):
        assert n == spark.read.parquet(f"{SF001}/documents.parquet").count()
