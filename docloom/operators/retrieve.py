"""Retrieval jobs (R2-R8): top-k joins of a question table against a chunk table.

Every top-k orders by score descending, then key ascending; scores are
doubles rounded to ``SCORE_DIGITS`` before ranking so that equal scores tie
the same way in every engine.

Scale notes
* Questions are the small side.  Their size is checked in rows, terms and
  cells before anything is broadcast; above a bound the question table is
  split into salted hash batches, each an ordinary distributed job.
* Neither keyword nor vector search materialises question x chunk pairs as
  rows: each partition scores its chunks against the broadcast questions in
  numpy blocks with a running top-k per question, whose memory is bounded by
  questions x k; the partitions' candidates are merged in two steps.  Corpus
  statistics for BM25 come from one aggregate for all question batches.
* Approximate search scores an item only for the questions that probe its
  k-means cell, in the same blocks.
* Hybrid search fuses the uncut rankings: the heads that can matter are
  taken from both lists and ranks missing in the other are counted exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.templates import fill_template
from docloom.functions.text import tokens, tokens_of
from docloom.operators import embed
from docloom.operators.common import row_count_at_most, top_k_per_group
from docloom.session import cut_lineage

# Fixed values --------------------------------------------------------------
DEFAULT_K = 8
BM25_K1 = 1.2  # Robertson and Zaragoza (2009)
BM25_B = 0.75
RRF_CONSTANT = 60  # Cormack, Clarke and Buettcher (2009)
SCORE_DIGITS = 9
DEFAULT_CHUNK_TEMPLATE = "Passage: {chunk_text}\n"
# ----------------------------------------------------------------------------

# Bounds for the broadcast side (rows, and cells of what is shipped to every
# task).  Larger question sets are split into hash batches of questions;
# each batch is an ordinary distributed job and the results are unioned.
MAX_BROADCAST_QUESTIONS = 400_000
MAX_BATCH_TERMS = 8_000_000  # question terms that a keyword index holds (64 MB)
MAX_BROADCAST_QUESTION_TERMS = 1_000_000
MAX_JOINED_QUESTIONS = 100_000  # whose ranked lists are broadcast to the chunks
MAX_BROADCAST_VECTOR_CELLS = 8_000_000  # questions x dimensions (64 MB of doubles)
MAX_FUSED_QUESTIONS = 5_000  # each has up to 2 x (constant + 2k) candidates in a task
MAX_PROBES = 1_000_000  # (question, cell) probes of one batch
MERGE_GROUPS = 64  # groups of partitions whose candidates are merged before the final merge


def _question_batches(questions: DataFrame, qid: str, n_batches: int, salt: int) -> list[DataFrame]:
    """Hash batches of questions.  ``salt`` changes the hash at every level,
    so a batch that is still too large splits again instead of landing in
    one sub-batch."""
    bucket = F.pmod(F.xxhash64(F.col(qid), F.lit(salt)), F.lit(n_batches))
    return [questions.filter(bucket == i) for i in range(n_batches)]


def _union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _ranked(scored: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    """Final top-k in two steps: per group of partitions, then per question, so that no
    task sorts the candidates of all partitions for a question."""
    order = [F.desc("score"), F.asc(key)]
    grouped = scored.withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
    some = top_k_per_group(grouped, [qid, "_group"], order, k, rank_col="_some").drop("_some", "_group")
    return top_k_per_group(some, [qid], order, k)


def attach_chunks(top: DataFrame, chunks: DataFrame, key: str, cols: Sequence[str], small: bool) -> DataFrame:
    """Join the ranked keys back to their chunk columns.  ``top`` holds at
    most questions x k rows; when the question count was proven small it is
    broadcast and the chunk table is only scanned, never shuffled."""
    side = chunks.select(key, *cols)
    return side.join(F.broadcast(top) if small else top, key, "inner")


# ----------------------------------------------------------------------------
# scoring in numpy blocks, shared by keyword and vector search


BLOCK_ROWS = 4_096  # chunk rows scored at once in a task ...
BLOCK_CELLS = 256_000  # ... for so many questions that their scores stay in the cache
PART = 16  # of the rows, one in so many is searched first, for scores that the others have to reach
PART_ROWS = 5_000  # of such a part that a task searches, and its least size
OUT_ROWS = 100_000  # rows of one Arrow batch that a task returns


class _Best:
    """Running top-k of every question of a task: candidates are appended as flat
    arrays and cut back to k per question whenever they outgrow a fixed multiple
    of questions x k, so memory does not grow with the rows seen."""

    def __init__(self, n_q: int, k: int, least: np.ndarray | None = None):
        self.n_q, self.k = n_q, k
        self.limit = max(4 * n_q * k, 1 << 16)
        self.q, self.s, self.keys = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)
        # the k-th best so far, or a score that k rows of the whole table are known to reach
        self.least = np.full(n_q, -np.inf) if least is None else least.copy()
        self.parts: list[tuple] = []
        self.pending = 0

    def add(self, scores: np.ndarray, keys: np.ndarray, floor: float, asks: np.ndarray | None = None) -> None:
        """``scores`` (rows, questions), or the columns of the questions ``asks`` only;
        scores below ``floor`` never rank."""
        least = self.least if asks is None else self.least[asks]
        blind = np.flatnonzero(np.isneginf(least))
        if len(scores) > self.k and len(blind):
            least = least.copy()
            least[blind] = -np.partition(-scores[:, blind], self.k - 1, axis=0)[self.k - 1]
        rows, cols = np.nonzero(scores >= np.maximum(least, floor)[None, :])
        self.add_rows(cols if asks is None else asks[cols], scores[rows, cols], keys[rows])

    def add_rows(self, q: np.ndarray, s: np.ndarray, keys: np.ndarray) -> None:
        """Single scores ``s`` of the questions ``q``."""
        if len(q):
            self.parts.append((q, s, keys))
            self.pending += len(q)
            if self.pending > self.limit:
                self.cut()

    def cut(self) -> None:
        q, s, keys = (np.concatenate(x) for x in zip((self.q, self.s, self.keys), *self.parts))
        self.parts, self.pending = [], 0
        if not len(q):
            return
        order = np.lexsort((-s, q))
        q, s, keys = q[order], s[order], keys[order]
        same = (q[1:] == q[:-1]) & (s[1:] == s[:-1])
        tied = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if tied.any():  # the smaller key comes first
            _, place = np.unique(keys[tied], return_inverse=True)
            at = np.flatnonzero(tied)
            keys[at] = keys[at[np.lexsort((place, -s[at], q[at]))]]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = nth < self.k
        self.q, self.s, self.keys = q[keep], s[keep], keys[keep]
        full = nth == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def _round(scores: np.ndarray) -> np.ndarray:
    """``np.round(scores, SCORE_DIGITS)`` in place."""
    np.multiply(scores, 10.0**SCORE_DIGITS, out=scores)
    np.rint(scores, out=scores)
    return np.divide(scores, 10.0**SCORE_DIGITS, out=scores)


def _question_blocks(n_q: int, n_rows: int) -> list[tuple]:
    """The questions scored at once against ``n_rows`` rows: ``(slice, *asks)``, no ``asks`` when they are all."""
    some = max(1, BLOCK_CELLS // max(n_rows, 1))
    if n_q <= some:
        return [(slice(0, n_q),)]
    return [(slice(lo, lo + some), np.arange(lo, min(lo + some, n_q))) for lo in range(0, n_q, some)]


@dataclass(frozen=True)
class _Source:
    """One way of scoring: ``blocks`` maps Arrow batches of ``rows`` (key first) to ``(keys, scores)`` or
    ``(keys, scores, asks)`` blocks, scores being (rows, questions) in the order of ``qids`` or of ``asks``.
    ``pairs`` maps Arrow batches and ``{key: questions}`` to ``(keys, questions, scores)``."""

    rows: DataFrame
    blocks: Callable
    qids: list
    q_field: T.StructField
    key: str
    floor: float
    tops: Callable | None = None  # adds the best rows of Arrow batches to a _Best without scoring every cell
    n_rows: int = 0  # of ``rows``, when known
    pairs: Callable | None = None

    @functools.cached_property
    def part(self) -> _Source | None:
        """The same over a ``PART``-th of the rows, for what has to be known before all are searched; None for few rows."""
        n_part = self.n_rows // PART
        if n_part < PART_ROWS:
            return None
        rows = self.rows.filter(F.pmod(F.xxhash64(F.col(self.key), F.lit(PART)), F.lit(PART)) == 0)
        return replace(self, rows=cut_lineage(rows.repartition(-(-n_part // PART_ROWS), self.key)), n_rows=n_part)

    def _schema(self, extra: str) -> tuple[T.StructType, pa.DataType, pa.DataType]:
        key_field = self.rows.schema[self.key]
        fields = [T.StructField("_q", self.q_field.dataType), T.StructField(self.key, key_field.dataType)]
        schema = T.StructType([*fields, *T._parse_datatype_string(extra).fields])
        return schema, to_arrow_type(self.q_field.dataType), to_arrow_type(key_field.dataType)

    def _best(self, k: int, least):
        """The best rows per question of a task's Arrow batches, as a ``_Best``."""
        blocks, n_q, floor, tops = self.blocks, len(self.qids), self.floor, self.tops

        def best_of(batches) -> _Best:
            best = _Best(n_q, k, least.value if least is not None else None)
            if tops is not None:
                tops(batches, best)
            else:
                for keys, scores, *asks in blocks(batches):
                    best.add(scores, keys, floor, *asks)
            best.cut()
            return best

        return best_of

    def least_scores(self, k: int):
        """Broadcast: for every question a score that at least ``k`` of the rows reach, the k-th best among a
        ``PART``-th of them (-inf where that part holds fewer).  All rows are scored afterwards; those
        below it cannot rank, so a task neither adds them up nor sends them.  None for few rows."""
        if self.part is None:
            return None
        best_of = self._best(k, self.part.least_scores(k))

        def run(batches):
            best = best_of(batches)
            for lo in range(0, len(best.q), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(best.q[lo : lo + OUT_ROWS]), pa.array(best.s[lo : lo + OUT_ROWS])], names=["q", "score"])

        scored = self.part.rows.mapInArrow(run, "q long, score double").withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
        some = top_k_per_group(scored, ["q", "_group"], [F.desc("score")], k, rank_col="_some").select("q", "score")
        kth = top_k_per_group(some, ["q"], [F.desc("score")], k).filter(F.col("rank") == k).select("q", "score").toArrow()  # a row per question
        least = np.full(len(self.qids), -np.inf)
        least[kth.column("q").to_numpy()] = kth.column("score").to_numpy()
        return self.rows.sparkSession.sparkContext.broadcast(least)

    def top(self, k: int) -> DataFrame:
        """``(_q, key, score, rank)``: the k best rows per question."""
        schema, q_type, key_type = self._schema("score double")
        qids, best_of = self.qids, self._best(k, self.least_scores(k))

        def run(batches):
            best = best_of(batches)
            for lo in range(0, len(best.q), OUT_ROWS):
                part = slice(lo, lo + OUT_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qids[i] for i in best.q[part]], q_type), pa.array(best.keys[part].tolist(), key_type), pa.array(best.s[part])],
                    names=schema.names,
                )

        return _ranked(self.rows.mapInArrow(run, schema), "_q", self.key, k)

    def scores_of(self, pairs: DataFrame) -> DataFrame:
        """``(_q, key, score)`` of the given ``(_q, key)`` pairs (at most questions x candidates)."""
        schema, q_type, key_type = self._schema("score double")
        wanted: dict = {}
        numbers = {q: i for i, q in enumerate(self.qids)}
        given = pairs.select("_q", self.key).toArrow()
        for q, key in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
            if q in numbers:  # a question without a vector has no score
                wanted.setdefault(key, []).append(numbers[q])
        shared, score, qids, floor = pairs.sparkSession.sparkContext.broadcast(wanted), self.pairs, self.qids, self.floor

        def run(batches):
            wanted = shared.value

            def candidates():
                for batch in batches:
                    here = np.array([x in wanted for x in batch.column(0).to_pylist()], dtype=bool)
                    if here.any():
                        yield batch.filter(pa.array(here))

            for keys, q, scores in score(candidates(), wanted):
                keep = scores >= floor
                if keep.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([qids[i] for i in q[keep]], q_type), pa.array(keys[keep].tolist(), key_type), pa.array(scores[keep])],
                        names=schema.names,
                    )

        return self.rows.mapInArrow(run, schema)

    def ranks_of(self, scored: DataFrame) -> DataFrame:
        """``(_q, key, rank)`` of ``scored (_q, key, score)``: one more than the rows that come before."""
        schema, q_type, key_type = self._schema("better long")
        numbers = {q: i for i, q in enumerate(self.qids)}
        given: dict[int, list] = {}
        rows = scored.select("_q", self.key, "score").toArrow()  # at most questions x candidates
        for q, key, score in zip(*(rows.column(i).to_pylist() for i in range(3))):
            given.setdefault(numbers[q], []).append((score, key))
        for q in given:
            given[q].sort()
        shared, blocks, qids = scored.sparkSession.sparkContext.broadcast(given), self.blocks, self.qids

        def run(batches):
            given = shared.value
            limits = {q: np.array([s for s, _ in xs]) for q, xs in given.items()}
            better = {q: np.zeros(len(xs), dtype=np.int64) for q, xs in given.items()}
            for keys, scores, *asks in blocks(batches):
                by_question = scores.T
                for i, q in enumerate(asks[0].tolist() if asks else range(len(qids))):
                    if q not in given:
                        continue
                    row = by_question[i]
                    ordered = np.sort(row)
                    left, right = np.searchsorted(ordered, limits[q], "left"), np.searchsorted(ordered, limits[q], "right")
                    better[q] += len(row) - right
                    for j in np.flatnonzero(left != right).tolist():  # equal scores: the smaller key comes first
                        score, key = given[q][j]
                        better[q][j] += sum(x < key for x in keys[np.flatnonzero(row == score)])
            out = [(qids[q], key, int(n)) for q, xs in given.items() for (_, key), n in zip(xs, better[q]) if n]
            for lo in range(0, len(out), OUT_ROWS):
                q, key, n = zip(*out[lo : lo + OUT_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(q, q_type), pa.array(key, key_type), pa.array(n, pa.int64())], names=schema.names)

        counts = self.rows.mapInArrow(run, schema).groupBy("_q", self.key).agg(F.sum("better").alias("better"))
        joined = scored.join(counts, ["_q", self.key], "left")
        return joined.select("_q", self.key, (F.coalesce("better", F.lit(0)) + 1).alias("rank"))


# ----------------------------------------------------------------------------
# Keyword top-k (BM25)


def keyword_stats(chunks: DataFrame, vocab: DataFrame, text: str) -> DataFrame:
    """``(term, df, total)``: the document frequency of every vocabulary term, and under
    the term "" the number and total length of the chunks.  One scan: each chunk
    emits one marker row carrying its length and one row per distinct vocabulary
    term; an aggregate with map-side combine leaves at most ``len(vocab) + 1`` rows."""
    wanted = vocab.unionByName(chunks.sparkSession.range(1).select(F.lit("").alias("term")))
    if row_count_at_most(vocab, MAX_BROADCAST_QUESTION_TERMS):
        wanted = F.broadcast(wanted)
    return (
        chunks.select(tokens_of(chunks, text).alias("_toks"))
        .select(F.size("_toks").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("_toks"))).alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total"))
    )


POSTINGS = 4_000_000  # (chunk, question term) pairs of a task that are weighed at once
FIRST_POSTINGS = 1 << 19  # of its first block, which finds the k-th best scores that later blocks have to pass
STEPS = 64  # of a score, in which upper bounds are added up as 16-bit numbers
COMMON = 16  # a term in more than one of so many chunks of a block is laid out by chunk ...
COMMON_CELLS = 32_000_000  # ... as far as these 16-bit cells go
COMMON_ROWS = 1_000  # such terms whose exact weights are laid out by chunk
OVER = (1 << 16) - 1
SCORED_AT_ONCE = 4_000_000  # marks of questions' terms that candidates are compared with at once
CANDIDATES = 10_000  # chunks that get their whole score at once


def _weighed(index, batches, most=FIRST_POSTINGS):
    """This partition's chunks as ``(keys, ends, terms, weights)``: the question terms of each chunk with
    their BM25 weights, in blocks of at most about ``POSTINGS`` pairs; every chunk lies in one block."""
    import pyarrow.compute as pc

    _, vocab, idf, _, _, k1, b, avgdl = index
    n_v, held, size = max(len(vocab), 1), [], 0

    def block():
        keys, sizes, terms, weights = (np.concatenate(x) for x in zip(*held))
        return keys, np.cumsum(sizes), terms, weights

    for batch in batches:
        step = 2_000 if most < POSTINGS else max(batch.num_rows, 1)
        for lo in range(0, batch.num_rows, step):
            toks = batch.column(1).slice(lo, step)
            keys = np.array([*batch.column(0).slice(lo, step).to_pylist(), None], dtype=object)[:-1]
            lengths = np.asarray(toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            words = toks.flatten().dictionary_encode()
            places = pc.index_in(words.dictionary, value_set=vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = places[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
            doc = np.repeat(np.arange(len(toks), dtype=np.int64), lengths)[codes >= 0]
            pairs, tf = np.unique(doc * n_v + codes[codes >= 0], return_counts=True)
            d, t = pairs // n_v, pairs % n_v
            tf = tf.astype(np.float64)
            w = idf[t] * tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * lengths[d] / avgdl))
            held.append((keys, np.bincount(d, minlength=len(toks)), t, w))
            size += len(t)
            if size >= most:
                yield block()
                held, size, most = [], 0, min(4 * most, POSTINGS)
    if held:
        yield block()


def _whole_scores(shared):
    """A function that gives the scores of single chunks for single questions, each from the chunk's own
    terms, and the number of questions it can be asked for at once."""
    q_start, q_terms, n_v = shared[3], shared[4], len(shared[1])
    mine = np.zeros(max(SCORED_AT_ONCE // max(n_v, 1), 1) * n_v, dtype=bool)

    def whole(asking, slots, chunks, starts, ends, terms, weights):
        """Scores of ``chunks`` for the questions ``asking[slots]``."""
        asked = np.concatenate([i * n_v + q_terms[q_start[q] : q_start[q + 1]] for i, q in enumerate(asking)])
        mine[asked] = True
        scores = np.zeros(len(chunks))
        for lo in range(0, len(chunks), CANDIDATES):
            some = chunks[lo : lo + CANDIDATES]
            sizes = ends[some] - starts[some]
            nth = np.repeat(np.arange(len(some)), sizes)
            where = np.arange(sizes.sum()) + np.repeat(starts[some] - (np.cumsum(sizes) - sizes), sizes)
            hit = mine[slots[lo : lo + CANDIDATES][nth] * n_v + terms[where]]
            scores[lo : lo + CANDIDATES] = np.bincount(nth[hit], weights[where[hit]], minlength=len(some))
        mine[asked] = False
        return np.round(scores, SCORE_DIGITS)

    return whole, max(SCORED_AT_ONCE // max(n_v, 1), 1)


def _bm25_pairs(index):
    """Scores of the wanted ``(key, question)`` pairs among this partition's chunks."""

    def run(batches, wanted):
        whole, at_once = _whole_scores(index.value)
        for keys, ends, terms, weights in _weighed(index.value, batches):
            starts = np.concatenate(([0], ends[:-1]))
            lists = [wanted[key] for key in keys]
            chunks, q = np.repeat(np.arange(len(keys)), [len(x) for x in lists]), np.concatenate(lists)
            order = np.argsort(q, kind="stable")
            chunks, q = chunks[order], q[order]
            asking, first = np.unique(q, return_index=True)
            first = np.append(first, len(q))
            for lo in range(0, len(asking), at_once):
                some = slice(first[lo], first[min(lo + at_once, len(asking))])
                slots = np.searchsorted(asking[lo : lo + at_once], q[some])
                yield keys[chunks[some]], q[some], whole(asking[lo : lo + at_once], slots, chunks[some], starts, ends, terms, weights)

    return run


def _bm25_tops(index):
    """Adds to a ``_Best`` every chunk that can be among a question's best, with its whole score.

    Weights are rounded up to whole steps, so that their sums are upper bounds.  The steps of a block's
    common terms lie in one row per term, those of the others in postings.  A question adds up its rows
    and postings over all chunks at once; chunks whose bound reaches the k-th best score so far get
    their whole score from their own row.  The result is that of scoring every chunk."""

    def tops(batches, best):
        shared = index.value
        q_start, q_terms = shared[3], shared[4]
        k, n_v, n_q = best.k, len(shared[1]), best.n_q
        of, n_terms = np.repeat(np.arange(n_q), np.diff(q_start)), np.diff(q_start).tolist()
        whole, at_once = _whole_scores(shared)

        known = np.isfinite(best.least).mean() > 0.9 if n_q else False
        for keys, ends, terms, weights in _weighed(shared, batches, POSTINGS if known else FIRST_POSTINGS):
            n = len(keys)
            starts = np.concatenate(([0], ends[:-1]))
            order = np.argsort(terms, kind="stable")
            by_chunk = np.repeat(np.arange(n), ends - starts)[order]
            unit = min(STEPS, OVER / max(float(weights.max(initial=0.0)), 1.0))
            by_steps = np.ceil(weights[order] * unit).astype(np.uint16)
            t_start = np.searchsorted(terms[order], np.arange(n_v + 1))
            del order
            fan = np.diff(t_start)
            here = np.flatnonzero(fan)
            most = np.zeros(n_v, dtype=np.int64)
            most[here] = np.maximum.reduceat(by_steps, t_start[here]) if len(here) else 0
            common = np.flatnonzero(fan > n // COMMON)
            common = common[np.argsort(-fan[common], kind="stable")][: COMMON_CELLS // max(n, 1)]
            place = np.full(n_v, -1)
            place[common] = np.arange(len(common))
            rows = [np.zeros(n, dtype=np.uint16) for _ in common]
            for row, t in zip(rows, common):
                row[by_chunk[t_start[t] : t_start[t + 1]]] = by_steps[t_start[t] : t_start[t + 1]]

            mosts, in_row = most[q_terms], place[q_terms] >= 0
            total = np.bincount(of, mosts, minlength=n_q)
            needs = np.floor(np.maximum(best.least, 0.0) * unit)
            added = np.flatnonzero(in_row)
            row_of, row_start = place[q_terms[added]].tolist(), np.searchsorted(of[added], np.arange(n_q + 1)).tolist()
            some = np.flatnonzero((mosts > 0) & ~in_row)
            lows, highs = t_start[q_terms[some]].tolist(), t_start[q_terms[some] + 1].tolist()
            span_start = np.searchsorted(of[some], np.arange(n_q + 1)).tolist()

            short, long = np.zeros(n, dtype=np.uint16), None
            limits, found = needs.tolist(), []
            asks = np.flatnonzero((total > 0) & (total >= needs)).tolist()
            for nth, q in enumerate(asks, 1):
                bound = short
                if total[q] > OVER:
                    bound = long = np.zeros(n, dtype=np.uint32) if long is None else long
                bound[:] = 0
                for r in row_of[row_start[q] : row_start[q + 1]]:
                    np.add(bound, rows[r], out=bound)
                x, y = span_start[q], span_start[q + 1]
                if x < y:
                    spans = [slice(i, j) for i, j in zip(lows[x:y], highs[x:y])]
                    np.add.at(bound, np.concatenate([by_chunk[s] for s in spans]), np.concatenate([by_steps[s] for s in spans]).astype(bound.dtype, copy=False))
                limit = limits[q]
                if not limit:  # the k-th best bound, less what rounding up can have added
                    limit = max(int(np.partition(bound, n - k)[n - k]) - n_terms[q], 1) if n > k else 1
                chunks = (bound >= bound.dtype.type(limit)).nonzero()[0]
                if len(chunks):
                    found.append((q, chunks))
                if found and (nth == len(asks) or len(found) == at_once):
                    slots, chunks = np.repeat(np.arange(len(found)), [len(c) for _, c in found]), np.concatenate([c for _, c in found])
                    asking = np.array([q for q, _ in found])
                    scores, of_slot = whole(asking, slots, chunks, starts, ends, terms, weights), asking[slots]
                    keep = scores >= np.maximum(best.least[of_slot], np.nextafter(0.0, 1.0))
                    best.add_rows(of_slot[keep], scores[keep], keys[chunks[keep]])
                    found = []
            best.cut()

    return tops


def _bm25_blocks(index):
    """Blocks of BM25 scores of this partition's chunks for every question.  A chunk's weights are added in
    the order of the vocabulary, as ``_whole_scores`` does: equal sums are equal to the last bit."""

    def run(batches):
        n_q, vocab, idf, q_start, q_terms, *_ = index.value
        n_v, counts = len(vocab), np.diff(q_start)
        n_common = min(int(np.searchsorted(idf, np.log(COMMON))), COMMON_ROWS)  # the vocabulary goes from common to rare
        of = np.repeat(np.arange(n_q), counts)
        rare = (q_start[:-1] + np.bincount(of[q_terms < n_common], minlength=n_q)).tolist()
        begin, codes = q_start.tolist(), q_terms.tolist()
        for keys, ends, terms, weights in _weighed(index.value, batches):
            starts = np.concatenate(([0], ends[:-1]))
            for lo in range(0, len(keys), BLOCK_ROWS):
                hi = min(lo + BLOCK_ROWS, len(keys))
                n, here = hi - lo, slice(int(starts[lo]), int(ends[hi - 1]))
                order = np.argsort(terms[here], kind="stable")
                by_chunk, by_weight = np.repeat(np.arange(n), ends[lo:hi] - starts[lo:hi])[order], weights[here][order]
                sorted_terms = terms[here][order]
                t_start = np.searchsorted(sorted_terms, np.arange(n_v + 1))
                rows = np.zeros((n_common, n))
                common = slice(0, int(t_start[n_common]))
                rows[sorted_terms[common], by_chunk[common]] = by_weight[common]
                rows = list(rows)
                lows, highs = t_start[q_terms].tolist(), t_start[q_terms + 1].tolist()
                for some, *asks in _question_blocks(n_q, n):
                    scores = np.zeros((min(some.stop, n_q) - some.start, n))
                    for i, into in enumerate(scores, some.start):
                        for t in codes[begin[i] : rare[i]]:
                            np.add(into, rows[t], out=into)
                        spans = [slice(x, y) for x, y in zip(lows[rare[i] : begin[i + 1]], highs[rare[i] : begin[i + 1]]) if x < y]
                        if spans:
                            np.add.at(into, np.concatenate([by_chunk[x] for x in spans]), np.concatenate([by_weight[x] for x in spans]))
                    yield keys[lo:hi], _round(scores).T, *asks

    return run


def _question_terms(questions: DataFrame, qid: str, qtext: str, wordless: bool = False) -> DataFrame:
    """Distinct terms of every question; questions without a token only when ``wordless``."""
    terms = F.coalesce(F.array_distinct(tokens(qtext)), F.array().cast("array<string>"))
    rows = questions.select(F.col(qid).alias("_q"), terms.alias("_terms"))
    return cut_lineage(rows if wordless else rows.filter(F.size("_terms") > 0))


def _term_batches(qterms: DataFrame, most: int) -> list[DataFrame]:
    """Hash batches of questions within the broadcast bounds.  A batch that is over them is
    split again with another hash; one question alone is taken as it is."""
    todo, out, salt = [(qterms, 0)], [], 0
    while todo:
        part, depth = todo.pop()
        sizes = part.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_terms")).alias("terms"), F.min("_q").alias("a"), F.max("_q").alias("b")).first()
        need = max(-(-int(sizes["n"]) // most), -(-int(sizes["terms"] or 0) // MAX_BATCH_TERMS), 1)
        if need == 1 or sizes["a"] == sizes["b"]:
            out.append(part)
        else:
            # an eighth more batches than the bound asks for, as their sizes differ
            todo += [(p, depth + 1) for p in _question_batches(part, "_q", need + -(-need // 8), depth)]
    return out


def _keyword_source(qterms: DataFrame, stats: DataFrame, chunks: DataFrame, q_field, key: str, text: str, k1: float, b: float) -> _Source | None:
    """The BM25 index of a batch of questions, broadcast; None when no question term occurs."""
    import pyarrow.compute as pc

    rows = qterms.select("_q", "_terms").toArrow().combine_chunks()  # bounded by _term_batches
    terms = qterms.select(F.explode("_terms").alias("term")).unionByName(
        chunks.sparkSession.range(1).select(F.lit("").alias("term"))
    )
    freq = stats.join(terms.distinct(), "term", "left_semi").select("term", "df", "total").toArrow()
    mark = pc.equal(freq.column("term"), "")
    n_docs, total = ([int(x or 0) for x in freq.filter(mark).select(["df", "total"]).to_pylist()[0].values()]) if pc.any(mark).as_py() else (0, 0)
    freq = freq.filter(pc.invert(mark))  # terms that occur in the corpus
    if not rows.num_rows or not freq.num_rows:
        return None
    avgdl = (total / n_docs if n_docs else 0.0) or 1.0
    freq = freq.sort_by([("df", "descending"), ("term", "ascending")])
    vocab, df_arr = freq.column("term").combine_chunks(), freq.column("df").to_numpy().astype(np.float64)
    idf = np.log(1.0 + (n_docs - df_arr + 0.5) / (df_arr + 0.5))
    lists = rows.column("_terms").combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    codes = pc.index_in(lists.flatten(), value_set=vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(rows.num_rows), sizes)[codes >= 0]
    codes = codes[codes >= 0]
    q_terms = codes[np.lexsort((codes, of))]  # a question's terms from common to rare
    q_start = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows.num_rows))))
    index = chunks.sparkSession.sparkContext.broadcast((rows.num_rows, vocab, idf, q_start, q_terms, k1, b, avgdl))
    scored = chunks.select(key, tokens_of(chunks, text).alias("_toks"))
    qids = rows.column("_q").to_pylist()
    return _Source(scored, _bm25_blocks(index), qids, q_field, key, float(np.nextafter(0.0, 1.0)), _bm25_tops(index), n_docs, _bm25_pairs(index))


def _empty_top(spark, q_field, key_field) -> DataFrame:
    schema = T.StructType([T.StructField("_q", q_field.dataType), T.StructField(key_field.name, key_field.dataType)])
    return spark.createDataFrame([], schema).select("*", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))


def topk_keyword(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULT_K,
    qid: str = "item_id",
    qtext: str = "text",
    key: str = "chunk_id",
    text: str = "chunked_text",
    keep: Sequence[str] = ("path", "chunked_text"),
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """BM25 top-k chunks per question: ``(qid, rank, key, score, *keep)``.

    ``chunks`` must hold one row per ``key`` (see ``dedup_chunks``).  Idf is
    ``ln(1 + (N - df + 0.5) / (df + 0.5))``; each distinct question term
    counts once; a chunk sharing no term with a question is not ranked.

    Plan: (1) one aggregate, for all questions together, gives N, mean length and
    the document frequency of the question vocabulary; (2) the question-term
    index (size-checked) is broadcast; (3) every partition scores its chunks in
    numpy blocks against a running top-k; (4) the partitions' candidates are
    merged in two steps.  No question x chunk pair is ever a row and nothing is
    shuffled but the candidates.
    """
    q_field, key_field = questions.schema[qid], chunks.schema[key]
    qterms = _question_terms(questions, qid, qtext)  # read several times below
    stats = cut_lineage(keyword_stats(chunks, qterms.select(F.explode("_terms").alias("term")).distinct(), text))
    tops = []
    for part in _term_batches(qterms, MAX_BROADCAST_QUESTIONS):
        source = _keyword_source(part, stats, chunks, q_field, key, text, k1, b)
        tops.append(source.top(k) if source else _empty_top(questions.sparkSession, q_field, key_field))
    top = _union_all(tops).select(F.col("_q").alias(qid), "rank", key, "score")
    cols = [c for c in keep if c != key]
    if not cols:
        return top
    # broadcast only behind a check of the question count: top has at most that x k rows
    small = row_count_at_most(qterms, MAX_JOINED_QUESTIONS)
    return attach_chunks(top, chunks, key, cols, small).select(qid, "rank", key, "score", *cols)


# ----------------------------------------------------------------------------
# R2: exact vector top-k (cosine)


def _unit_rows(values: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return values / norms


def _list_matrix(arr, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row indices, float64 matrix) of the rows of a list<double> column that have ``dim`` values."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lengths = np.asarray(arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
    keep = np.flatnonzero(lengths == dim)
    sub = arr if len(keep) == len(arr) else arr.take(pa.array(keep))
    flat = np.asarray(sub.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return keep, flat.reshape(len(keep), dim)


def _cosine_blocks(shared):
    """Blocks of cosine scores of this partition's vectors of the questions' length."""

    def run(batches):
        qmat = shared.value
        for batch in batches:
            keep, mat = _list_matrix(batch.column(1), qmat.shape[1])
            if not len(keep):
                continue
            keys = np.array(batch.column(0).take(pa.array(keep)).to_pylist(), dtype=object)
            for lo in range(0, len(keep), BLOCK_ROWS):
                unit_rows = _unit_rows(mat[lo : lo + BLOCK_ROWS]).T
                for some, *asks in _question_blocks(len(qmat), unit_rows.shape[1]):
                    yield keys[lo : lo + BLOCK_ROWS], _round(qmat[some] @ unit_rows).T, *asks

    return run


def _cosine_pairs(shared):
    """Cosine scores of the wanted ``(key, question)`` pairs among this partition's vectors."""

    def run(batches, wanted):
        qmat = shared.value
        for batch in batches:
            keep, mat = _list_matrix(batch.column(1), qmat.shape[1])
            if not len(keep):
                continue
            keys = np.array(batch.column(0).take(pa.array(keep)).to_pylist(), dtype=object)
            lists = [wanted[key] for key in keys]
            rows, q, mat = np.repeat(np.arange(len(keys)), [len(x) for x in lists]), np.concatenate(lists), _unit_rows(mat)
            for lo in range(0, len(q), BLOCK_ROWS):
                some = slice(lo, lo + BLOCK_ROWS)
                yield keys[rows[some]], q[some], _round(np.einsum("ij,ij->i", mat[rows[some]], qmat[q[some]]))

    return run


def _vector_source(qvecs: DataFrame, items: DataFrame, q_field, key: str, vec: str, floor: float = -np.inf, n_rows: int = 0) -> _Source:
    rows = qvecs.collect()  # bounded by _vector_batches, all of one length
    qmat = _unit_rows(np.asarray([r[1] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 0))
    shared = items.sparkSession.sparkContext.broadcast(qmat)
    scored = items.select(key, F.col(vec).cast("array<double>").alias("_vec"))
    return _Source(scored, _cosine_blocks(shared), [r[0] for r in rows], q_field, key, floor, None, n_rows, _cosine_pairs(shared))


def _vector_batches(qvecs: DataFrame, max_questions: int) -> list[DataFrame]:
    """Questions ``(_q, _v)`` by vector length, in hash batches within the broadcast bounds."""
    out = []
    sizes = qvecs.groupBy(F.size("_v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    for dim, n in sizes:  # a row per vector length
        part = qvecs.filter(F.size("_v") == dim)
        need = max(-(-n // max_questions), -(-(n * dim) // MAX_BROADCAST_VECTOR_CELLS), 1)
        out += [part] if need == 1 else _question_batches(part, "_q", 2 * need, 0)
    return out


def topk_semantic(
    questions: DataFrame,
    items: DataFrame,
    k: int = DEFAULT_K,
    qid: str = "item_id",
    qvec: str = "vector",
    key: str = "chunk_id",
    vec: str = "vector",
    keep: Sequence[str] = (),
    max_questions: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """Exact cosine top-k items per question: ``(qid, rank, key, score, *keep)``.

    The question vectors are the broadcast side: their count is checked, then
    they are shipped once to every task as a unit-normalised matrix.  Items
    stay where they are; each partition keeps a running top-k per question and
    the partitions' candidates are merged in two steps.  A question is compared
    with the items of its own length; items of another length cannot rank.
    """
    q_field, key_field = questions.schema[qid], items.schema[key]
    qvecs = cut_lineage(
        questions.select(F.col(qid).alias("_q"), F.col(qvec).cast("array<double>").alias("_v")).filter(F.size("_v") > 0)
    )
    tops = []
    for part in _vector_batches(qvecs, max_questions):
        source = _vector_source(part, items, q_field, key, vec)
        if source.qids:
            tops.append(source.top(k))
    top = _union_all(tops or [_empty_top(questions.sparkSession, q_field, key_field)])
    top = top.select(F.col("_q").alias(qid), "rank", key, "score")
    cols = [c for c in keep if c != key]
    if not cols:
        return top
    # broadcast only behind the check of the question count: top has at most that x k rows
    small = len(tops) <= 1 and row_count_at_most(qvecs, MAX_JOINED_QUESTIONS)
    return attach_chunks(top, items, key, cols, small).select(qid, "rank", key, "score", *cols)


# ----------------------------------------------------------------------------
# Approximate top-k (inverted file over k-means cells)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def unit(vec: Column) -> Column:
    """Vector divided by its L2 norm (a zero vector stays zero)."""
    norm = F.sqrt(_dot(vec, vec))
    return F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


MIN_CELLS = 16


def build_ivf(
    items: DataFrame,
    key: str = "chunk_id",
    vec: str = "vector",
    cells: int | None = None,
    seed: int = 7,
    max_iter: int = 20,
    train: DataFrame | None = None,
):
    """Train k-means centres on unit vectors (pyspark.ml, distributed) and assign every
    item to its nearest centre.  ``cells`` defaults to the square root of the item
    count, so that a cell grows only with the root of the table.  Training reads all
    items, or the rows the caller passes as ``train``; assignment covers all items.
    Returns ``(assigned items (key, _unit, cell), centres (cell, centroid))``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def units(df: DataFrame, *cols: str) -> DataFrame:
        return df.select(*cols, unit(F.col(vec).cast("array<double>")).alias("_unit")).withColumn("_features", array_to_vector("_unit"))

    if cells is None:
        cells = max(MIN_CELLS, int(items.count() ** 0.5))
    kmeans = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cell")
    model = kmeans.fit(units(items if train is None else train))
    assigned = model.transform(units(items, key)).select(key, "_unit", F.col("cell").cast("int").alias("cell"))
    centres = items.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cell int, centroid array<double>",
    )
    return assigned, centres


CELL_CELLS = 2_000_000  # item rows x probing questions scored at once


def _cell_blocks(shared):
    """Blocks of cosine scores, cell by cell, of the questions that probe the cell."""

    def run(batches):
        qmat, probing = shared.value
        for batch in batches:
            keep, mat = _list_matrix(batch.column(1), qmat.shape[1])
            if not len(keep):
                continue
            keys = np.array(batch.column(0).take(pa.array(keep)).to_pylist(), dtype=object)
            cells = batch.column(2).to_numpy(zero_copy_only=False)[keep]
            for cell in np.unique(cells):
                asks = probing.get(int(cell))
                if asks is None:
                    continue
                rows = np.flatnonzero(cells == cell)
                block = max(1, CELL_CELLS // len(asks))
                for lo in range(0, len(rows), block):
                    part = rows[lo : lo + block]
                    yield keys[part], np.round(mat[part] @ qmat[asks].T, SCORE_DIGITS), asks

    return run


def topk_ann(
    questions: DataFrame,
    items: DataFrame,
    k: int = DEFAULT_K,
    qid: str = "item_id",
    qvec: str = "vector",
    key: str = "chunk_id",
    vec: str = "vector",
    cells: int | None = None,
    n_probe: int = 4,
    index=None,
    max_questions: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """Approximate cosine top-k: each question probes its ``n_probe`` nearest
    cells and is scored exactly against the items of those cells only.

    The questions of a batch (bounded in rows and in vector cells) and their probe
    lists are broadcast; the items are scanned in place, scored in blocks cell by
    cell against a running top-k, so no question x item pair is ever a row.
    ``index`` may be a prebuilt ``build_ivf`` result.  Probing all cells is exact.
    """
    assigned, centres = index if index is not None else build_ivf(items, key, vec, cells)
    q_field, key_field = questions.schema[qid], items.schema[key]
    qvecs = cut_lineage(
        questions.select(F.col(qid).alias("_q"), F.col(qvec).cast("array<double>").alias("_v")).filter(F.size("_v") > 0)
    )
    tops = []
    for part in _vector_batches(qvecs, min(max_questions, MAX_PROBES // max(n_probe, 1))):
        rows = part.collect()  # bounded by _vector_batches
        if not rows:
            continue
        probes = topk_semantic(part, centres, k=n_probe, qid="_q", qvec="_v", key="cell", vec="centroid").collect()
        number = {r["_q"]: i for i, r in enumerate(rows)}
        probing: dict[int, list[int]] = {}
        for r in probes:
            probing.setdefault(int(r["cell"]), []).append(number[r["_q"]])
        lists = {c: np.array(sorted(q), dtype=np.int64) for c, q in probing.items()}
        qmat = _unit_rows(np.asarray([r["_v"] for r in rows], dtype=np.float64))
        shared = items.sparkSession.sparkContext.broadcast((qmat, lists))
        near = assigned.filter(F.col("cell").isin(sorted(lists)))  # a table partitioned by cell is read in part
        source = _Source(near.select(key, "_unit", "cell"), _cell_blocks(shared), [r["_q"] for r in rows], q_field, key, -np.inf)
        tops.append(source.top(k))
    top = _union_all(tops or [_empty_top(questions.sparkSession, q_field, key_field)])
    return top.select(F.col("_q").alias(qid), "rank", key, "score")


# ----------------------------------------------------------------------------
# Hybrid top-k by reciprocal rank fusion


def fuse_ranks(
    ranked_lists: Sequence[DataFrame],
    k: int = DEFAULT_K,
    qid: str = "item_id",
    key: str = "chunk_id",
    constant: int = RRF_CONSTANT,
) -> DataFrame:
    """Reciprocal rank fusion: score = sum over lists of ``1 / (constant + rank)``
    for the lists where the key appears; top-k by that score.  The lists must hold the
    rank of every key that can make the cut (``topk_hybrid`` sees to that)."""
    parts = [r.select(qid, key, (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("rr")) for r in ranked_lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scored = union.groupBy(qid, key).agg(F.round(F.sum("rr"), 12).alias("score"))
    return _ranked(scored, qid, key, k).select(qid, "rank", key, "score")


CLOSE = 1e-9  # above the rounding of fused scores


def _uncut(first: _Source, second: _Source, k: int, constant: int) -> list[DataFrame]:
    """``(_q, key, rank)`` of both lists for every key that fusion can choose.

    A key outside the first ``constant + 2k`` of both lists scores at most
    ``2 / (2 constant + 2k + 1)``, less than the first k of either list alone.  So
    the candidates are those heads.  One that is missing from the other head comes there after
    all of it, and after as many rows as a part of the rows holds before it; when its score is then below that
    of k others, whatever its rank, it cannot be chosen.  The rest get their exact rank, by
    counting the rows that come before."""
    depth = constant + 2 * k
    key = first.key
    heads = [cut_lineage(s.top(depth).select("_q", key, "rank")) for s in (first, second)]
    ranks = [h.select("_q", key, F.col("rank").alias(name)) for h, name in zip(heads, ("_a", "_b"))]
    both = ranks[0].join(ranks[1], ["_q", key], "full")
    sure = sum(F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(name)), F.lit(0.0)) for name in ("_a", "_b"))
    both = cut_lineage(both.withColumn("_sure", sure))
    kth = top_k_per_group(both.select("_q", "_sure"), ["_q"], [F.desc("_sure")], k).filter(F.col("rank") == k)
    kth = kth.select("_q", F.col("_sure").alias("_kth"))
    out = []

    def can_win(pairs: DataFrame) -> DataFrame:
        """Pairs whose score is not surely below that of k others when they have ``rank`` at best in this list."""
        most = F.col("_sure") + F.lit(1.0) / (F.lit(constant) + F.col("rank"))
        return pairs.join(kth, "_q", "left").filter(F.col("_kth").isNull() | (most > F.col("_kth") - CLOSE)).drop("_kth", "rank")

    for source, head, name in zip((first, second), heads, ("_a", "_b")):
        missing = can_win(both.filter(F.col(name).isNull()).withColumn("rank", F.lit(depth + 1)))
        scored = cut_lineage(source.scores_of(missing).join(missing.select("_q", key, "_sure"), ["_q", key]))  # those without a score are in no list
        if source.part is not None:
            scored = cut_lineage(can_win(scored.join(source.part.ranks_of(scored), ["_q", key])))
        out.append(head.unionByName(source.ranks_of(scored).select("_q", key, F.col("rank").cast("int"))))
    return out


def topk_hybrid(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULT_K,
    qid: str = "item_id",
    qtext: str = "text",
    key: str = "chunk_id",
    text: str = "chunked_text",
    question_vectors: DataFrame | None = None,
    chunk_vectors: DataFrame | None = None,
    qvec: str = "vector",
    vec: str = "vector",
    constant: int = RRF_CONSTANT,
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """Top-k of the fused, uncut keyword and vector rankings: ``(qid, rank, key, score)``.

    Vectors default to the hashed ones.  A key of score zero is in no list.  A question
    without a token, or whose terms do not occur in the corpus, has its vector ranking alone."""
    if question_vectors is None:
        question_vectors = embed.embed(questions, qtext, qvec)
    items = chunk_vectors
    if items is None:  # read up to three times below: embedded once
        items = cut_lineage(embed.embed(chunks, text, vec).select(key, vec))
    n_items = items.count() if chunk_vectors is None else 0
    q_field, key_field = questions.schema[qid], chunks.schema[key]
    qterms = _question_terms(questions, qid, qtext, wordless=True)
    stats = cut_lineage(keyword_stats(chunks, qterms.select(F.explode("_terms").alias("term")).distinct(), text))
    vectors = question_vectors.select(F.col(qid).alias("_q"), F.col(qvec).cast("array<double>").alias("_v"))
    vectors = vectors.filter(F.size("_v") > 0)
    positive = float(np.nextafter(0.0, 1.0))
    tops = []
    for part in _term_batches(qterms, MAX_FUSED_QUESTIONS):
        keyword = _keyword_source(part, stats, chunks, q_field, key, text, k1, b)
        semantic = _vector_source(vectors.join(part.select("_q"), "_q", "left_semi"), items, q_field, key, vec, positive, n_items)
        lists = [semantic.top(k)] if keyword is None else _uncut(semantic, keyword, k, constant)
        lists = [r.withColumnRenamed("_q", qid) for r in lists]
        tops.append(fuse_ranks(lists, k, qid, key, constant))
    empty = _empty_top(questions.sparkSession, q_field, key_field).select(F.col("_q").alias(qid), "rank", key, "score")
    return _union_all(tops or [empty])


# ----------------------------------------------------------------------------
# Context text and source list


def build_context(
    hits: DataFrame,
    qid: str = "item_id",
    template: str = DEFAULT_CHUNK_TEMPLATE,
    text: str = "chunked_text",
    uri: str = "path",
) -> DataFrame:
    """One ``context`` string per question: the template filled per hit and
    concatenated in rank order without separator.  Each group holds at most
    k hits, so the per-group list is bounded."""
    piece = fill_template(template, chunk_text=F.col(text), document_uri=F.col(uri))
    return hits.groupBy(qid).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), piece.alias("p")))),
                lambda x: x["p"],
            ),
            "",
        ).alias("context")
    )


def source_list(hits: DataFrame, qid: str = "item_id", uri: str = "path") -> DataFrame:
    """Distinct document uris of each question's hits, best rank first (ties by uri)."""
    best = hits.groupBy(qid, uri).agg(F.min("rank").alias("best_rank"))
    return best.groupBy(qid).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("best_rank", uri))), lambda x: x[uri]
        ).alias("sources")
    )
