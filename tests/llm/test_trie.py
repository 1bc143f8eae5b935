"""Conversation trie against a plain trie."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import conversation_trie

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)


def order_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:40]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, order_digest(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + v[h:]
    return out


def plain_trie(convs):
    """``{(conv, depth): row}``, one node at a time."""
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    weights = {}
    for k in sorted(nodes, key=len, reverse=True):
        below = [weights[x] for x in kids.get(k, [])]
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        weights[k] = (sum(x[0] for x in below) or (not below), own + sum(x[1] for x in below))
    out = []
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append(
            (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), int(weights[k][0]), weights[k][1], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rows(seed, n, length, letters):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rnd.randrange(3 * n)
        k = rnd.randint(1, length)
        turns = rnd.sample(range(-100, 100), k) if k < 100 else range(k)
        for t in turns:
            rows.append((c, t, rnd.choice(["user", "assistant", "", None]) if rnd.random() < 0.1 else "user", rnd.choice(letters)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,fan", [(4, 16), (2, 2), (1, 3)])
def test_equals_plain_trie(spark, block, fan):
    rows = random_rows(block, 60, 12, ["a", "b", "é漢"])
    rows += [(1000 + i, j, "user", "same") for i in range(0, 60, 5) for j in range(6)]  # copies
    rows += [(2000, j, "user", "a" * (j % 3)) for j in range(70)]  # one long conversation
    out = conversation_trie.shared_prefix_trie(spark.createDataFrame(rows, TURNS), block, fan)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(out) == plain_trie(rebuilt(rows))


def test_defined_results(spark):
    rows = [
        (None, 1, "user", "nobody"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 1, "user", "tie"), (1, 5, "", ""), (4, 0, "user", "x" * 300_000),
        (-3, 1, "user", "negative"), (-5, 1, "user", "base"), (7, None, None, "é"), (7, None, None, "é"), (55, 2, "user", "a:b"), (50, 2, "usera", ":b"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("pos", "at", "digest", "bytes", "conv", "before", "after", "x", "n", "len", "key"):
        df = df.withColumn(c, F.lit("x"))
    assert got(conversation_trie.shared_prefix_trie(df)) == plain_trie(rebuilt(rows))
    assert conversation_trie.shared_prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    no_id = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert conversation_trie.shared_prefix_trie(no_id).count() == 0


def test_turnless_conversations(spark):
    """A conversation that is shorter than its share of a missing base has no turns left."""
    rows = [(c, t, "user", "a") for c in range(1, 5) for t in range(2)] + [(c, 0, "user", "b") for c in range(5, 12)]
    want = rebuilt(rows)
    assert any(not v for v in want.values())
    assert got(conversation_trie.shared_prefix_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(want)
    alone = [r for r in rows if not want[r[0]]][:1]
    assert got(conversation_trie.shared_prefix_trie(spark.createDataFrame(alone, TURNS))) == plain_trie(rebuilt(alone))


def test_member_lists_are_hashed_in_packs(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PACK_BYTES", 16)
    ends = [(1, 2, m) for m in range(1, 400)] + [(5, 0, m) for m in (5, 9, 10, 100)]
    out = conversation_trie._end_digests(spark.createDataFrame(ends, "conv long, depth long, member long"))
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got(out) == sorted([(1, 2, sha(range(1, 400))), (5, 0, sha([5, 9, 10, 100]))], key=str)
