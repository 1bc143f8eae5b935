"""SimHash, line and suffix deduplication against brute force."""

import hashlib
import random
import shutil
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from llm_fixtures import edges, make_docs  # noqa: F401

from docloom.llm import cuckoo, line_dedup, simhash_dedup, suffix_dedup
from docloom.llm.common import components

WHITE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def fingerprint(text):
    words = lower(text or "").translate({ord(c): " " for c in WHITE}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, x in enumerate(nodes):
        for y in nodes[i + 1 :]:
            if linked(x, y):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_copies(rnd, n):
    vocab = [f"word{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 300))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            out.append("  ".join(copy).upper() if rnd.random() < 0.3 else "\n".join(copy))
    return out


def test_simhash_components_equal_brute_force(make_docs):
    rnd = random.Random(3)
    texts = near_copies(rnd, 40) + ["", None, " \n", "one", "one two"]
    rnd.shuffle(texts)
    docs = make_docs(list(enumerate(texts)), clash=True)
    for cell in (simhash_dedup.CELL, 2):  # 2: every bucket is dealt into many units
        rows = simhash_dedup.near_duplicates(docs, cell=cell).collect()
        fps = {i: fingerprint(t) for i, t in enumerate(texts)}
        assert {r.doc_id: r.fp % (1 << 64) for r in rows} == fps
        want = least_reachable(fps, lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 3)
        assert {r.doc_id: r.component_id for r in rows} == want
        assert len(set(want.values())) < len(texts) - 20


def test_bit_sliced_links_within_a_group():
    rnd = np.random.default_rng(0)
    values = rnd.integers(0, 1 << 62, size=60, dtype=np.int64).astype(np.uint64)
    flips = [int(v) ^ sum(1 << int(b) for b in rnd.integers(0, 64, size=rnd.integers(0, 5))) for v in values for _ in range(4)]
    values = np.unique(np.array([int(v) for v in values] + flips, dtype=np.uint64))
    starts = np.array([0, 50, 51, 130])
    got = simhash_dedup.group_links(values, starts, 3)
    for a, b in zip(starts, [*starts[1:], len(values)]):
        want = least_reachable(range(a, b), lambda x, y: (int(values[x]) ^ int(values[y])).bit_count() <= 3)
        assert {i: int(got[i]) for i in range(a, b)} == want


def test_simhash_edges_and_one_per_group(edges, make_docs):
    rows = simhash_dedup.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.component_id)
    assert by_id[1] == by_id[2] == by_id[3] == {1} and by_id[7] == {6} and by_id[None] == {None, 1}
    kept = simhash_dedup.keep_one_per_group(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 4, 5, 6]
    assert simhash_dedup.near_duplicates(make_docs([])).count() == 0
    assert simhash_dedup.keep_one_per_group(make_docs([])).count() == 0


def test_long_text_fingerprint():
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    words = text.split()
    counts = np.zeros(64, dtype=np.int64)
    for i in range(len(words) - 2):
        h = np.uint64(xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42))
        counts += (h >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int64)
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 2)
    assert simhash_dedup.text_fingerprint(text) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
    assert got[5000] == 4000


# -- lines ---------------------------------------------------------------------------


def line_key(x):
    return lower(x.strip(WHITE))


def brute_lines(texts):
    held = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= 10:
                held[line_key(x)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held[line_key(x)]) < 2 or min(held[line_key(x)]) == i or len(line_key(x)) < 10]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def line_texts(rnd, n):
    pool = [f"Shared Line number {i}  " for i in range(30)] + ["short", "", "  ", " ten chars!", "x" * 10, "X" * 10 + "\r"]
    return {
        i: "\n".join(rnd.choice(pool) if rnd.random() < 0.4 else f"own line {i} {j}" for j in range(rnd.randint(0, 12))) for i in range(n)
    }


def test_lines_equal_brute_force(make_docs):
    texts = {**line_texts(random.Random(1), 150), 900: None, 901: "\n\n"}
    rows = line_dedup.dedup_lines(make_docs(list(texts.items()), clash=True)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in rows} == brute_lines(texts)


def test_lines_are_reversible(spark, make_docs):
    texts = line_texts(random.Random(2), 120)
    first = {i: t for i, t in texts.items() if i % 3}
    late = {i: t for i, t in texts.items() if not i % 3}

    def state(index):
        refs = sorted(map(tuple, index.refs().collect()))
        tables = {r.shard: [np.frombuffer(t, np.uint16) for t in r.tables] for r in index.filters().collect()}
        return refs, sum(int((t != 0).sum()) for ts in tables.values() for t in ts)

    index = line_dedup.LineIndex(spark, shards=3).insert(make_docs(list(first.items())))
    before = state(index)
    index.insert(make_docs(list(late.items())))
    whole = line_dedup.LineIndex(spark, shards=3).insert(make_docs(list(texts.items())))
    assert state(index) == state(whole)
    rows = index.apply(make_docs(list(texts.items()))).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in rows} == brute_lines(texts)
    index.delete(make_docs(list(late.items())))
    assert state(index) == before
    rows = index.apply(make_docs(list(first.items()))).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in rows} == brute_lines(first)


def same_tag_lines(buckets):
    """Two lines of one tag that share no bucket in a table of ``buckets`` buckets."""
    seen = {}
    for i in range(100_000):
        line = f"a line of its own {i}"
        k1, k2 = np.frombuffer(line_dedup.line_digest(line), dtype="<u8").reshape(2, 1)
        home, other, tag = cuckoo._homes(np.zeros((buckets, cuckoo.SLOTS), np.uint16), k1, k2)
        here = {int(home[0]), int(other[0])}
        for line_before, places in seen.setdefault(int(tag[0]), []):
            if not here & places:
                return line_before, line
        seen[int(tag[0])].append((line, here))
    raise AssertionError("no pair found")


def test_line_delete_spares_a_live_key_of_the_same_tag(spark, make_docs):
    filler = [f"filler line number {i}" for i in range(40)]
    live, gone = same_tag_lines(len(cuckoo.empty_table(len(filler) + 1)))
    texts = {1: live, 2: "\n".join([gone, *filler]), 3: live, 4: gone}
    docs = {i: make_docs([(i, t)]) for i, t in texts.items()}
    index = line_dedup.LineIndex(spark, shards=1).insert(docs[1])  # one bucket: every equal tag is a false positive
    index.insert(docs[2]).delete(docs[2])
    (row,) = index.filters().collect()
    assert [np.count_nonzero(np.frombuffer(t, np.uint16)) for t in row.tables] == [1, 0]
    index.insert(docs[3]).insert(docs[4])
    left = {i: texts[i] for i in (1, 3, 4)}
    whole = line_dedup.LineIndex(spark, shards=1).insert(make_docs(list(left.items())))
    assert sorted(index.refs().collect()) == sorted(whole.refs().collect())
    rows = index.apply(make_docs(list(left.items()))).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in rows} == brute_lines(left)


def test_line_index_is_reopened_from_its_folder(spark, make_docs, tmp_path):
    texts = line_texts(random.Random(5), 90)
    first, late, gone = ({i: t for i, t in texts.items() if i % 3 == r} for r in range(3))
    path = str(tmp_path / "index")
    line_dedup.LineIndex(spark, path, shards=3, min_chars=8).insert(make_docs(list({**first, **gone}.items())))
    line_dedup.LineIndex(spark, path).insert(make_docs(list(late.items())))
    index = line_dedup.LineIndex(spark, path)
    whole = line_dedup.LineIndex(spark, shards=3, min_chars=8).insert(make_docs(list(texts.items())))
    assert (index.version, index.shards, index.min_chars) == (2, 3, 8)
    assert sorted(index.refs().collect()) == sorted(whole.refs().collect())
    shutil.copytree(f"{path}/ledger/v=1", f"{path}/ledger/v=3")  # left by a change that was never committed
    line_dedup.LineIndex(spark, path).delete(make_docs(list(gone.items())))
    left = make_docs(list({**first, **late}.items()))
    index = line_dedup.LineIndex(spark, path)
    whole = line_dedup.LineIndex(spark, shards=3, min_chars=8).insert(left)
    assert sorted(index.refs().collect()) == sorted(whole.refs().collect())
    assert sorted(index.apply(left).collect()) == sorted(whole.apply(left).collect())
    for other in ({"shards": 4}, {"min_chars": 10}):
        with pytest.raises(ValueError):
            line_dedup.LineIndex(spark, path, **other)


def test_repeated_inserts_and_rows_are_undone_by_one_delete(spark, make_docs):
    line = "a line that is long enough"
    one, two = make_docs([(1, line), (1, line)]), make_docs([(2, line)])
    index = line_dedup.LineIndex(spark, shards=2).insert(one).insert(one)
    assert sorted((r.n_docs, r.holder) for r in index.refs().collect()) == [(1, 1)]
    index.delete(make_docs([(1, "")]))
    assert index.ledger().count() == 0
    index.insert(two).insert(make_docs([(2, line + "\nand another line")]))
    assert sorted((r.n_docs, r.holder) for r in index.refs().collect()) == [(1, 2), (1, 2)]


def test_lines_edges(edges, make_docs, spark):
    rows = line_dedup.dedup_lines(edges).collect()
    assert len(rows) == edges.count()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in rows) == [
        (0, 1, 0), (0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 1), (7, 1, 1),
    ]
    cleaned = line_dedup.LineIndex(spark).insert(edges).clean(edges)
    assert cleaned.columns == edges.columns
    assert {r.doc_id for r in cleaned.collect() if r.text is None} == {1, None}
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


def test_cuckoo_filter_has_no_false_negative_and_forgets():
    rnd = np.random.default_rng(4)
    k1, k2 = (rnd.integers(0, 1 << 63, size=5000, dtype=np.int64).astype(np.uint64) for _ in range(2))
    table = cuckoo.empty_table(5000)
    assert cuckoo.insert(table, k1, k2) and cuckoo.contains(table, k1, k2).all()
    assert int((table != 0).sum()) == 5000
    cuckoo.delete(table, k1[:3000], k2[:3000])
    assert int((table != 0).sum()) == 2000 and cuckoo.contains(table, k1[3000:], k2[3000:]).all()
    assert cuckoo.contains(table, k1[:3000], k2[:3000]).mean() < 0.01


# -- suffixes --------------------------------------------------------------------------


def brute_suffixes(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for j in range(len(data) - length + 1):
            piece = data[j : j + length]
            if piece in seen:
                gone[j : j + length] = True
            seen.add(piece)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def suffix_texts(rnd, n):
    shared = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(60, 400))) for _ in range(12)]
    out = {}
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 60)
            parts.append(s[a : a + rnd.randint(50, 400)] if rnd.random() < 0.6 else "".join(rnd.choice("xyz ") for _ in range(50)))
        out[i] = "".join(parts)
    return out


def as_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def test_suffixes_equal_brute_force(make_docs):
    rnd = random.Random(6)
    texts = {**suffix_texts(rnd, 80), 500: "ab" * 300, 501: "ab" * 250, 502: "\0" * 300, 503: None, 504: "", 505: "é" * 49, 506: "é" * 50, 507: "é" * 50}
    docs = make_docs(list(texts.items()), clash=True)
    want = brute_suffixes(texts)
    assert sum(x[1] for x in want.values()) > 3000
    assert as_rows(suffix_dedup.remove_repeats(docs)) == want
    assert as_rows(suffix_dedup.remove_repeats(docs, max_contexts=3)) == want  # some anchors go on in parts
    assert as_rows(suffix_dedup.remove_repeats(docs, max_contexts=1)) == want  # every anchor dealt by window


def test_suffixes_of_a_text_longer_than_a_piece(make_docs):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcdefgh") for _ in range(suffix_dedup.PIECE - 500))
    texts = {1: base + base[1000:3000], 2: "zz" + base[suffix_dedup.PIECE - 900 :] + base[:700]}
    assert as_rows(suffix_dedup.remove_repeats(make_docs(list(texts.items())))) == brute_suffixes(texts)


def test_merged_transforms_find_the_repeated_windows():
    rnd = random.Random(8)
    core = bytes(rnd.choice(b"ab\0") for _ in range(260))
    strings = [core[rnd.randint(0, 90) : rnd.randint(150, 260)] + bytes(rnd.choice(b"abc") for _ in range(9)) for _ in range(30)]
    groups = defaultdict(set)
    for s, at, block in zip(*suffix_dedup.repeated_windows(strings, 100, shard_bytes=400)):
        groups[block].add((int(s), int(at)))
    want = defaultdict(set)
    for i, s in enumerate(strings):
        for j in range(len(s) - 99):
            want[s[j : j + 100]].add((i, j))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_suffix_edges(edges, make_docs):
    rows = suffix_dedup.remove_repeats(edges).collect()
    assert len(rows) == edges.count() and all(r.n_removed == 0 for r in rows)
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0
    same = "a repeated row of more than one hundred bytes, which is judged like its twin and not against it, is it not? yes"
    twice = suffix_dedup.remove_repeats(make_docs([(1, same), (1, same), (None, same)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, len(same)), (1, 0), (1, 0)]
    assert hashlib.sha256(bytes(twice[0].kept)).hexdigest()


def test_context_hashes_tell_contexts_apart():
    rnd = np.random.default_rng(3)
    data = rnd.integers(0, 3, size=4000, dtype=np.uint8)
    first = rnd.integers(0, 3800, size=3000)
    stop = first + rnd.integers(100, 170, size=3000)
    key = suffix_dedup.draw_key()
    seen = {}
    for a, b, c, d in zip(first, stop, *suffix_dedup.context_hashes(data, first, stop, key)):
        seen.setdefault(data[a:b].tobytes(), set()).add((int(c), int(d)))
    assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)
    assert suffix_dedup.draw_key() != key
    # by hand, one base
    want = sum((int(x) + 1) * pow(key[0], i, suffix_dedup.PRIME) for i, x in enumerate(data[5:150])) % suffix_dedup.PRIME
    assert int(suffix_dedup.context_hashes(data, np.array([5]), np.array([150]), key)[0][0]) >> 31 == want


def test_only_true_repeats_go(make_docs):
    """Texts that share all but their first 16 bytes: 84 common bytes are no repeat, 100 are."""
    rnd = random.Random(11)
    chars = "".join(chr(c) for c in range(33, 127))
    texts, n = {}, 0
    for _ in range(40):
        tail = "".join(rnd.choice(chars) for _ in range(rnd.choice([84, 99, 100, 120])))
        for _ in range(3):
            texts[n] = "".join(rnd.choice(chars) for _ in range(16)) + tail
            n += 1
    got = as_rows(suffix_dedup.remove_repeats(make_docs(list(texts.items()))))
    assert got == brute_suffixes(texts)
    assert sum(v[1] == 0 for v in got.values()) > 60


def test_hot_anchor_over_batches(make_docs, monkeypatch):
    """One gram in many different surroundings, more than are held at once."""
    monkeypatch.setattr(suffix_dedup, "MOST_HELD", 20)
    rnd = random.Random(12)
    gram = "G" * 32
    texts = {i: "".join(rnd.choice("xyz") for _ in range(rnd.randint(60, 90))) + gram + "".join(rnd.choice("xyz") for _ in range(rnd.randint(60, 90))) for i in range(150)}
    for i in range(150, 200):
        body = texts[rnd.randrange(100)]
        cut = rnd.randrange(len(body) - 100)
        texts[i] = "ab" + body[cut : cut + 110] + "cd"
    want = brute_suffixes(texts)
    assert as_rows(suffix_dedup.remove_repeats(make_docs(list(texts.items())))) == want
    assert as_rows(suffix_dedup.remove_repeats(make_docs(list(texts.items())), max_contexts=5)) == want
