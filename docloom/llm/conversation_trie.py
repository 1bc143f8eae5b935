"""Prefix trie of conversations by fixed-length block hashing (operator 12).

A node of depth d is a distinct sequence of the first d (role, text) turns of the
conversations; the root is the empty sequence.  A conversation is a member of
every node it starts with.

1. Turns get their place by a total order that is dealt by range, so that one
   very long conversation is spread over many tasks, and a digest.
2. ``block_turns`` turns make a block with a digest of its own, ``fan`` blocks a
   block of the next level, and so on until a conversation is one block: a few
   levels for any length.
3. From the top level down each block gets the digest of all that comes before it
   (and after it: its end).  A block holds at most ``fan`` digests, so every step is
   one row's work.
4. Conversations are grouped by (what comes before, block).  Where all members of a
   prefix go on with one block, the turns inside it are one chain and its nodes
   follow from the group alone.  Only where siblings diverge are turn boundaries
   refined: the groups, not the conversations, are cut at every turn and grouped again.
5. A node is named by its smallest member and its depth.  Sums over subtrees
   come from sums over members, without walking the trie: every node belongs to its
   smallest member, whose nodes are a path's lower end, so a member brings its own
   nodes' bytes, and whether its path ends in a leaf, into each node it passes.

Turns of equal number stand in the order of their digests.  Digests are SHA-256, cut to
``DIGEST`` hex digits.

Defined results: a null role or text is empty; a null turn comes first; rows without a
conversation id belong to no conversation; repeated rows are turns of their own;
very long texts are hashed where they lie and not moved, very long conversations
take more rows, never a longer one; other columns are ignored; an empty table has
no conversations and gives an empty trie without a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import with_row_index
from docloom.session import cut_lineage

BLOCK_TURNS = 4
FAN = 16
DIGEST = 40  # hex digits kept of a SHA-256
PACK_BYTES = 1 << 14  # member ids packed into one row
# Fixed values of the rebuilt conversations ---------------------------------------
FAMILY = 5
MOST_SHARED = 9
# -----------------------------------------------------------------------------------


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGEST)


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, digest, bytes)``: every turn with its place from 1, the digest of
    (role, text) and the UTF-8 bytes of its text."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).isNotNull().cast("int").alias("numbered"),
        F.col(turn).alias("turn"),
        _digest(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)).alias("digest"),
        F.octet_length(t).cast("long").alias("bytes"),
    )
    order = ["conv", "numbered", "turn", "digest"]
    placed = cut_lineage(with_row_index(rows, order, "at").select("conv", "at", "digest", "bytes"))
    first = placed.groupBy("conv").agg(F.min("at").alias("first"))
    return placed.join(first, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), "digest", "bytes")


def share_prefixes(own: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations ``(conv, pos, digest, bytes)`` and ``(conv, len)``: conversation c
    takes its first h turns from c - c % ``family`` and keeps its own after the first h,
    where h = crc32(c) % ``most``."""
    lens = own.groupBy("conv").agg(F.max("pos").alias("n"))
    lens = lens.select("conv", "n", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("base"))
    bases = lens.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = cut_lineage(
        lens.join(bases, "base", "left").select("conv", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    )
    kept = own.join(plan.select("conv", "h", "taken"), "conv").filter("pos > h")
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    heads = own.filter(F.col("pos") < most).withColumnRenamed("conv", "base")  # h is less than `most`
    lent = plan.select("conv", "base", "h").join(heads, "base").filter("pos <= h").select("conv", "pos", "digest", "bytes")
    size = (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("len")
    return kept.union(lent), plan.select("conv", size)


# ---------------------------------------------------------------------------------
# blocks and what comes before them


def _pieces(rows: DataFrame, per: int) -> DataFrame:
    """Rows ``(conv, at, digest, ...)`` gathered ``per`` to a block (a bounded list)."""
    extra = [c for c in rows.columns if c not in ("conv", "at", "digest")]
    item = F.struct("at", "digest", *extra)
    packed = rows.groupBy("conv", F.floor(F.col("at") / per).cast("long").alias("up")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return packed.select("conv", F.col("up").alias("at"), "x", _digest(F.array_join("x.digest", "")).alias("digest"))


def blocks(rebuilt: DataFrame, block_turns: int = BLOCK_TURNS, fan: int = FAN) -> DataFrame:
    """``(conv, at, before, after, digest, x)`` for every block of turns: ``before`` and ``after``
    name the whole sequence up to the block's start and end, ``x`` lists its turns."""
    lowest = cut_lineage(_pieces(rebuilt.select("conv", (F.col("pos") - 1).alias("at"), "digest", "bytes"), block_turns))
    levels = [lowest]
    top = lowest.agg(F.max("at")).first()[0] or 0
    while top:
        levels.append(cut_lineage(_pieces(levels[-1].select("conv", "at", "digest"), fan)))
        top //= fan
    known = levels[-1].select("conv", "at", F.lit("").alias("before"), F.col("digest").alias("after"))
    for level, below in zip(levels[:0:-1], levels[-2::-1]):
        inner = level.join(known, ["conv", "at"]).select("conv", "before", "after", F.posexplode("x").alias("i", "y"), F.col("x.digest").alias("all"))

        def upto(n):
            return F.when(n == 0, F.col("before")).otherwise(
                _digest(F.concat(F.lit("b"), F.col("before"), F.lit(":"), F.array_join(F.slice("all", 1, n), "")))
            )

        end = F.when(F.col("i") + 1 == fan, F.col("after")).otherwise(upto(F.col("i") + 1))
        known = cut_lineage(inner.select("conv", F.col("y.at").alias("at"), F.when(F.col("i") == 0, F.col("before")).otherwise(upto(F.col("i"))).alias("before"), end.alias("after")))
        known = known.select("conv", "at", "before", "after")
    return lowest.join(known, ["conv", "at"])


def _nodes(members: DataFrame, aggregates: dict[str, Column], merged: dict[str, Column], block_turns: int) -> DataFrame:
    """One row per node below the root: ``(key, above, depth, bytes, conv, ...)``.

    ``members`` are blocks of conversations; they are grouped by (before, digest), and cut at
    turn boundaries and grouped again (with ``merged``) only where siblings diverge."""
    groups = members.groupBy("before", "digest").agg(
        F.min("conv").alias("conv"), F.first("at").alias("at"), F.first("after").alias("after"), F.first("x").alias("x"), *[c.alias(n) for n, c in aggregates.items()]
    )
    groups = cut_lineage(groups)
    siblings = groups.groupBy("before").agg(F.count(F.lit(1)).alias("siblings"))
    ways = groups.join(siblings, "before")

    def key(i):  # of the i-th turn boundary: a full block's last one is where the next block starts
        inside = _digest(F.concat(F.lit("t"), F.col("before"), F.lit(":"), F.array_join(F.slice("x.digest", 1, i), "")))
        return F.when(i == block_turns, F.col("after")).when(i == 0, F.col("before")).otherwise(inside)

    cut = ways.select("*", F.posexplode("x").alias("i", "turn"))
    cut = cut.select(
        key(F.col("i") + 1).alias("key"),
        key(F.col("i")).alias("above"),
        (F.col("at") * block_turns + F.col("i") + 1).alias("depth"),
        F.col("turn.bytes").alias("bytes"),
        "conv",
        "siblings",
        *aggregates,
    )
    same = ["key", "above", "depth", "bytes"]
    chains = cut.filter("siblings = 1").select(*same, "conv", *aggregates)
    refined = cut.filter("siblings > 1").groupBy(*same).agg(F.min("conv").alias("conv"), *[c.alias(n) for n, c in merged.items()])
    return chains.union(refined.select(*same, "conv", *aggregates))


# ---------------------------------------------------------------------------------
# members that end at a node


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(conv, depth, ends_sha256)`` of rows ``(conv, depth, member)``: SHA-256 of the members in
    ascending order, comma-joined.  Members are packed where the total order puts them, so that the
    one task that must see all of a node reads packs and holds one at a time."""

    def pack(batches):
        node, members, size = None, [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]]), pa.array([node[1]]), pa.array([members[0]]), pa.array([",".join(map(str, members))])],
                names=["conv", "depth", "least", "pack"],
            )

        for batch in batches:
            for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
                if members and ((conv, depth) != node or size >= PACK_BYTES):
                    yield out()
                    members, size = [], 0
                node = (conv, depth)
                members.append(member)
                size += len(str(member)) + 1
        if members:
            yield out()

    def finish(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for conv, depth, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, depth) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["conv", "depth", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays(
                [pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=["conv", "depth", "ends_sha256"]
            )

    order = ["conv", "depth", "member"]
    packs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "conv long, depth long, least long, pack string")
    whole = packs.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "least")
    return whole.mapInArrow(finish, "conv long, depth long, ends_sha256 string")


# ---------------------------------------------------------------------------------
# the trie


def build(rebuilt: DataFrame, lens: DataFrame, block_turns: int = BLOCK_TURNS, fan: int = FAN) -> DataFrame:
    """The trie of conversations given as turns ``(conv, pos, digest, bytes)`` and ``(conv, len)``:
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
    members = cut_lineage(blocks(rebuilt, block_turns, fan))
    total = members.groupBy("conv").agg(F.sum(F.aggregate("x.bytes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))
    convs = cut_lineage(lens.join(total, "conv", "left").select("conv", F.col("len"), F.coalesce("total", F.lit(0)).cast("long").alias("total")))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).filter("conv IS NOT NULL")

    count = {"n": F.count(F.lit(1))}
    below = _nodes(members, count, {"n": F.sum("n")}, block_turns)
    top = root.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("above"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "conv", "n")
    nodes = below.union(top)
    nodes = cut_lineage(nodes)
    children = nodes.filter("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("above"), F.col("conv").alias("parent"))
    shape = cut_lineage(
        nodes.join(children, "key", "left")
        .join(parents, "above", "left")
        .select("conv", "depth", "bytes", "n", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), "key")
    )
    # what a member's own nodes weigh, and whether they end in a leaf
    owned = shape.groupBy("conv").agg(
        F.sum("bytes").alias("own"), F.max(F.struct("depth", (F.col("n_children") == 0).cast("long").alias("leaf"))).alias("last")
    )
    worth = cut_lineage(
        convs.join(owned, "conv", "left").select("conv", "len", "total", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("last.leaf", F.lit(0)).alias("leaf"))
    )
    sums = {"total": F.sum("total"), "own": F.sum("own"), "leaves": F.sum("leaf")}
    again = {n: F.sum(n) for n in sums}
    weighed = _nodes(members.join(worth, "conv"), sums, again, block_turns).select("conv", "depth", *sums)
    weighed = weighed.union(worth.agg(F.min("conv").alias("conv"), F.lit(0).cast("long").alias("depth"), *[c.alias(n) for n, c in sums.items()]).filter("conv IS NOT NULL"))

    # bytes of the smallest member before the node's own turn
    bodies = members.select("conv", F.explode("x").alias("t")).select("conv", (F.col("t.at") + 1).alias("depth"), F.col("t.bytes").alias("bytes"))
    running = cut_lineage(with_row_index(bodies, ["conv", "depth"], "at", {"sum": "bytes"}).select("conv", "depth", (F.col("sum") - F.col("bytes")).alias("sum")))
    start = running.filter("depth = 1").select("conv", F.col("sum").alias("start"))
    before = running.join(start, "conv").select("conv", "depth", (F.col("sum") - F.col("start")).alias("prefix"))

    ended = convs.select(F.col("conv").alias("member"), F.col("len").alias("depth"))
    final = members.select(F.col("conv").alias("member"), "at", "before", "after", "x").filter(F.size("x") > 0)
    names = final.join(ended, "member").filter(F.col("at") == F.floor((F.col("depth") - 1) / block_turns))
    inside = _digest(F.concat(F.lit("t"), F.col("before"), F.lit(":"), F.array_join("x.digest", "")))
    keyed = names.select("member", F.when(F.size("x") == block_turns, F.col("after")).otherwise(inside).alias("key"))
    keyed = keyed.union(ended.filter("depth = 0").select("member", F.lit("").alias("key")))
    ends = _end_digests(keyed.join(shape.select("key", "conv", "depth"), "key"))

    mine = worth.select("conv", F.col("own").alias("conv_own"), F.col("total").alias("conv_total"))
    out = shape.join(weighed, ["conv", "depth"]).join(mine, "conv").join(before, ["conv", "depth"], "left").join(ends, ["conv", "depth"], "left")
    pre = F.coalesce("prefix", F.lit(0))
    spent = F.col("total") - F.col("n") * pre  # bytes of the members' turns from here on
    once = F.col("own") - F.col("conv_own") + F.col("conv_total") - pre  # bytes of the subtree's nodes
    return out.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"),
        (spent - once).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def shared_prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS, fan: int = FAN) -> DataFrame:
    """The trie of the rebuilt conversations (``share_prefixes``)."""
    rebuilt, lens = share_prefixes(cut_lineage(turns(conversations)))
    return build(rebuilt, lens, block_turns, fan)
