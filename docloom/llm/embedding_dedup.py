"""Near-duplicate vectors by a subspace pigeonhole join (operator 11).

Vectors of one label (and one dimension) are linked when their cosine is at
least ``threshold``; a component is a set of vectors connected by links.

How the links are found
* Equal vectors of a label are one node with a count, so copies never meet.
* Unit vectors are turned by a fixed rotation (two rounds of sign changes and
  Hadamard transforms), which spreads a difference evenly over all coordinates
  and changes no distance.  A cosine of at least t is a squared distance of at
  most 2 - 2t.
* The rotated coordinates are cut into blocks of ``block_dims``, and each block
  has the share of the squared distance that its width has.  Two linked vectors
  keep within the budget of at least one block, so the union of the blocks'
  range joins loses no pair.
* The range join of a block works on cells.  A label of up to ``cell`` nodes is one
  cell; beyond that the block's coordinates are split at quantiles of a normal
  curve with the label's own mean and deviation, one bit for each doubling.  A vector
  is at home in one cell and visits every cell of smaller code that comes
  within the block's budget of it, so a pair meets in exactly one cell of a block.
* A cell with more members than ``cell`` (a dense group of near copies) is dealt
  into chunks, and each pair of chunks is one unit of work.
* Inside a unit the pairs within the block's budget are the candidates.  A pair
  that an earlier block finds as well is left to that block; the others are verified
  by their cosine in double precision.  Block distances are summed elementwise
  from the same doubles everywhere, so all units agree on them.
* A unit emits one row per node with a link: the copies it is linked to, and one
  edge of a spanning forest.  No pair leaves a task.

Defined results: a vector that is null, empty or zero, or that holds a null or
non-finite component, links with nothing, and so does one with a null label;
vectors of different dimension never link.  Repeated rows are vectors of their
own (each counts the others).  A null id is never a component's id unless the
component has no other.  Long vectors are held a unit at a time (two chunks).
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components
from docloom.llm.simhash_dedup import _least_label
from docloom.session import cut_lineage

THRESHOLD = 0.93  # fixed value of the contract
BLOCK_DIMS = 8
CELL = 8192  # nodes of a cell, or of a chunk of it
SEED = 11
SLACK = 1e-9  # far above the rounding of a distance, far below any budget
ROWS = 512  # query rows of one distance matrix
PAIRS = 1 << 15  # candidates verified at once
PLACE_ROWS = 1024  # vectors whose visits are listed at once
MAX_BITS = 3  # splits of one coordinate

# ---------------------------------------------------------------------------------
# vectors


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` at length 1, scaled by powers of two first so that no square overflows."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -e[:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotate(u: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The fixed rotation of unit vectors, padded with zeros to a power of two.
    Only elementwise steps: a vector's result does not depend on its batch."""
    n, dim = u.shape
    width = 1 << max(0, dim - 1).bit_length()
    z = np.zeros((n, width))
    z[:, :dim] = u
    rnd = np.random.default_rng([seed, dim])
    for _ in range(2):
        z *= rnd.choice([-1.0, 1.0], size=width)
        step = 1
        while step < width:
            pairs = z.reshape(n, -1, 2, step)
            z = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
            step *= 2
        z /= np.sqrt(width)
    return z


def block_bounds(width: int, block_dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + block_dims, width)) for a in range(0, width, block_dims)]


def budgets(width: int, block_dims: int, threshold: float) -> np.ndarray:
    """Each block's share of the squared distance 2 - 2t."""
    return np.array([(2 - 2 * threshold) * (b - a) / width for a, b in block_bounds(width, block_dims)]) + SLACK


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


# ---------------------------------------------------------------------------------
# cells


def split_bits(n: int, dims: int, cell: int) -> list[int]:
    """Bits of each coordinate of a block: one in all for each doubling of ``n`` over ``cell``."""
    bits = min(max(0, int(np.ceil(np.log2(max(n, 1) / cell)))), MAX_BITS * dims)
    return [bits // dims + (i < bits % dims) for i in range(dims)]


def place(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: list[int], budget: float):
    """``(row, code, home)``: each row's own cell, and the cells of smaller code that lie
    within the squared distance ``budget`` of it."""
    row = np.arange(len(x))
    code, own, spent = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
    for j, b in enumerate(bits):
        if not b:
            continue
        n = 1 << b
        cuts = mean[j] + deviation[j] * np.array([NormalDist().inv_cdf(i / n) for i in range(1, n)])
        low, high = np.concatenate(([-np.inf], cuts)), np.concatenate((cuts, [np.inf]))
        at = x[row, j]
        own = own * n + np.searchsorted(cuts, at, side="right")
        far = np.maximum(0, np.maximum(low[None, :] - at[:, None], at[:, None] - high[None, :])) ** 2 + spent[:, None]
        which, part = np.nonzero(far <= budget)
        row, own, spent, code = row[which], own[which], far[which, part], code[which] * n + part
    kept = code <= own
    return row[kept], code[kept], (code == own)[kept]


def _placed(nodes: DataFrame, block_dims: int, threshold: float, cell: int) -> DataFrame:
    """``(gid, block, code, home, node)``: homes and visits of every node in every block."""
    names = ["gid", "block", "code", "home", "node"]

    def run(batches):
        for batch in batches:
            node, gid, size = (batch.column(i).to_numpy() for i in range(3))
            for g in np.unique(gid):
                at = np.flatnonzero(gid == g)
                z = rotate(unit_vectors(_matrix(batch.column(3).take(pa.array(at)))))
                n, width = int(size[at[0]]), z.shape[1]
                if n > cell:
                    mean, deviation = (np.array(batch.column(i)[int(at[0])].as_py()) for i in (4, 5))
                else:
                    mean = deviation = np.zeros(width)
                share = budgets(width, block_dims, threshold)
                for k, (a, b) in enumerate(block_bounds(width, block_dims)):
                    for lo in range(0, len(at), PLACE_ROWS):
                        row, code, home = place(
                            z[lo : lo + PLACE_ROWS, a:b], mean[a:b], deviation[a:b], split_bits(n, b - a, cell), share[k]
                        )
                        m = len(row)
                        cols = [np.full(m, g), np.full(m, k, np.int32), code, home, node[at[lo + row]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return nodes.select("node", "gid", "size", "vec", "mean", "deviation").mapInArrow(
        run, "gid long, block int, code long, home boolean, node long"
    )


def _spread(nodes: DataFrame) -> DataFrame:
    """``(gid, mean, deviation)`` of the rotated coordinates, from one row of sums per group and batch."""

    def run(batches):
        for batch in batches:
            gid = batch.column(0).to_numpy()
            for g in np.unique(gid):
                z = rotate(unit_vectors(_matrix(batch.column(1).take(pa.array(np.flatnonzero(gid == g))))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(g)]), pa.array([len(z)]), pa.array([z.sum(axis=0).tolist()]), pa.array([(z * z).sum(axis=0).tolist()])],
                    names=["gid", "n", "s", "q"],
                )

    sums = nodes.select("gid", "vec").mapInArrow(run, "gid long, n long, s array<double>, q array<double>")
    each = sums.select("gid", "n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "x"))
    mean = F.sum("x.s") / F.sum("n")
    by = each.groupBy("gid", "i").agg(
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("x.q") / F.sum("n") - mean * mean)).alias("deviation")
    )
    # one entry per coordinate
    rows = by.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("i", "mean", "deviation"))).alias("x"))
    return rows.select("gid", F.col("x.mean").alias("mean"), F.col("x.deviation").alias("deviation"))


# ---------------------------------------------------------------------------------
# units of work


def unit_links(u, z, copies, home, side, block: int, block_dims: int, threshold: float, two_chunks: bool):
    """``(linked copies, label)`` of a unit's rows: how many vectors each is linked to by
    pairs that this block is the first to find, and the least row it is connected to by them.
    ``side`` tells the two chunks apart (either may be empty)."""
    n, width = z.shape
    bounds, share = block_bounds(width, block_dims), budgets(width, block_dims, threshold)
    a0, b0 = bounds[block]
    x = z[:, a0:b0]
    norms = np.einsum("ij,ij->i", x, x)
    linked, label, rows = np.zeros(n, np.int64), np.arange(n), np.arange(n)

    def verify(a, b):
        nonlocal label
        first = np.ones(len(a), dtype=bool)
        for k, (lo, hi) in enumerate(bounds[: block + 1]):
            d = z[a, lo:hi] - z[b, lo:hi]
            within = (d * d).sum(axis=1) <= share[k]
            first &= within if k == block else ~within
        a, b = a[first], b[first]
        near = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
        a, b = a[near], b[near]
        if len(a):
            np.add.at(linked, a, copies[b])
            np.add.at(linked, b, copies[a])
            label = _least_label(n, np.concatenate([rows, a]), np.concatenate([label, b]))

    def join(left, right, triangle):
        for lo in range(0, len(left), ROWS):
            part = left[lo : lo + ROWS]
            square = norms[part][:, None] + norms[right][None, :] - 2 * (x[part] @ x[right].T)
            i, j = np.nonzero(square <= share[block] + SLACK)
            if triangle:
                i, j = i[later := j > i + lo], j[later]
            for at in range(0, len(i), PAIRS):
                verify(part[i[at : at + PAIRS]], right[j[at : at + PAIRS]])

    homes, guests = np.flatnonzero(home & ~side), np.flatnonzero(~home & ~side)
    if two_chunks:
        join(homes, np.flatnonzero(side), False)
        join(guests, np.flatnonzero(home & side), False)
    else:
        join(homes, homes, True)
        join(homes, guests, False)
    return linked, label


def _links(units: DataFrame, block_dims: int, threshold: float) -> DataFrame:
    """``(a, b, n)``: node, a node it is connected to in a unit, copies it is linked to there."""
    by = ["gid", "block", "code", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []  # the rows of the unit that may go on in the next batch

        def links_of(part: pa.Table):
            node, copies, home, side = (part.column(i).to_numpy() for i in range(5, 9))
            u = unit_vectors(_matrix(part.column(9).combine_chunks()))
            block, i, j = (part.column(c)[0].as_py() for c in (1, 3, 4))
            linked, label = unit_links(u, rotate(u), copies, home, side, block, block_dims, threshold, i != j)
            some = np.flatnonzero(linked)
            if len(some):
                cols = [node[some], node[label[some]], linked[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(5)])
            cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield from links_of(table.slice(lo, hi - lo))
            held = table.slice(cuts[-1]).to_batches()
        if held:
            yield from links_of(pa.Table.from_batches(held))

    sorted_units = units.repartition(*by).sortWithinPartitions(*by)
    return sorted_units.select(*by, "node", "copies", "home", "side", "vec").mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    block_dims: int = BLOCK_DIMS,
    cell: int = CELL,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row: the other vectors it is linked
    to directly, the smallest key reachable by links, and whether that is its own."""
    kind = vectors.schema[vector].dataType.simpleString()
    vec = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), vec.alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.filter(F.col("_label").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0))
    distinct = usable.groupBy("_label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least"))
    table = cut_lineage(distinct.select("*", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("node")))
    groups = cut_lineage(
        table.groupBy("_label", "dim").agg(F.count(F.lit(1)).alias("size")).select("*", F.monotonically_increasing_id().alias("gid"))
    )
    nodes = cut_lineage(table.join(groups, ["_label", "dim"]).select("node", "gid", "size", "vec", "copies"))
    spread = _spread(nodes.filter(F.col("size") > cell))

    placed = cut_lineage(_placed(nodes.join(spread, "gid", "left"), block_dims, threshold, cell))
    cells = ["gid", "block", "code"]
    sizes = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("lived_in")).filter("members > 1 and lived_in")
    chunks = F.ceil(F.col("members") / F.lit(cell)).cast("int")
    dealt = placed.join(sizes, cells).select(*cells, "home", "node", chunks.alias("m"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("c"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    units = dealt.select("*", other.alias("o")).select(
        *cells, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("side"), "home", "node"
    )
    links = cut_lineage(_links(units.join(nodes.select("node", "vec", "copies"), "node"), block_dims, threshold))

    roots = components(links.select("a", "b"))
    linked = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    grouped = (
        table.join(linked, "node", "left")
        .join(roots, "node", "left")
        .select("_label", "vec", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    result = grouped.join(ids, "root").select("_label", "vec", "n_links", "component_id")
    out = rows.join(result, ["_label", "vec"], "left").select(
        F.col("_id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.select("*", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))
