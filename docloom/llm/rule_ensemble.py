"""Quality classifier as a sparse rule ensemble (operator 8).

1. Statistics of the text, all of them Spark expressions.
2. Small boosted regression trees on a bounded sample of labelled rows; every
   path from a root to a node is a rule, a conjunction of threshold tests.
3. Logistic regression with an L1 penalty over the 0/1 rules: most weights
   become exactly zero (Friedman and Popescu, 2008).
4. The rules left are compiled into one Spark column expression, so scoring a
   table is a projection inside whole-stage code generation.

Only step 2 and 3 run on the driver, on at most ``max_train`` labelled rows
(chosen by a hash of the id); scoring covers every row.

Defined results: a null or empty text has all statistics zero and is scored
like any other; labels that are null or whose document is missing are not used;
several labels of one id are all used; rows of one id with equal statistics are
one row of the fit, and when there are more rows than ``max_train`` every id's
first row goes before any id's second; without labels, or with labels of one
class only, the score is the smoothed share of label 1; an empty table gives
an empty result; other columns are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WHITE, WHITE_CHARS, words
from docloom.session import cut_lineage

MAX_TRAIN = 20_000  # labelled rows the ensemble is fitted on at most
N_TREES = 30
DEPTH = 3
SHRINKAGE = 0.3
BINS = 32
L1 = 1e-3
STEPS = 600
THRESHOLD = 0.3  # fixed value of the contract: predicted is 1 from this score on

_SYMBOLS = "#*$%&|<>^~=@"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(text: str = "text") -> list[Column]:
    """The two projections' worth of counts the features are made of; see ``with_features``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))

    def removed(chars: str) -> Column:
        return F.length(body) - F.length(F.translate(body, chars, ""))

    return [
        words(text).alias("_w"),
        lines.alias("_l"),
        F.length(body).alias("_chars"),
        removed(WHITE_CHARS).alias("_white"),
        removed(_SYMBOLS).alias("_symbols"),
        removed(_CAPITALS).alias("_capitals"),
        removed("!").alias("_exclaim"),
        removed(".").alias("_stops"),
    ]


FEATURES = (
    "n_words",
    "mean_word",
    "symbol_ratio",
    "capital_ratio",
    "exclaim_ratio",
    "stop_ratio",
    "distinct_ratio",
    "distinct_line_ratio",
    "words_per_line",
)


def with_features(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` and one double column per feature."""
    df = docs.select(*keep, *statistics(text))
    df = df.select(
        *keep,
        F.size("_w").alias("_n"),
        F.size(F.array_distinct("_w")).alias("_nd"),
        F.size("_l").alias("_nl"),
        F.size(F.array_distinct("_l")).alias("_ndl"),
        (F.col("_chars") - F.col("_white")).alias("_letters"),
        "_symbols",
        "_capitals",
        "_exclaim",
        "_stops",
    )

    def ratio(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    values = (
        F.col("_n").cast("double"),
        ratio("_letters", "_n"),
        ratio("_symbols", "_n"),
        ratio("_capitals", "_letters"),
        ratio("_exclaim", "_n"),
        ratio("_stops", "_n"),
        ratio("_nd", "_n"),
        ratio("_ndl", "_nl"),
        ratio("_n", "_nl"),
    )
    return df.select(*keep, *[v.alias(f"_f_{name}") for name, v in zip(FEATURES, values)])


# ----------------------------------------------------------------------------------
# trees and their paths

Test = tuple[int, bool, float]  # (feature, above, threshold): above means value > threshold


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple[Test, ...], paths: list, out: np.ndarray, rows: np.ndarray):
    """One regression tree by least squares: fills ``out`` with its predictions and
    appends the path of every node but the root to ``paths``."""
    total, n = y[rows].sum(), len(rows)
    best = (1e-9, None)
    if depth and n >= 10:
        base = total * total / n
        for f, points in enumerate(cuts):
            if not len(points):
                continue
            place = np.searchsorted(points, x[rows, f], side="left")  # value <= points[k] for place <= k
            count = np.cumsum(np.bincount(place, minlength=len(points) + 1))[:-1]
            part = np.cumsum(np.bincount(place, weights=y[rows], minlength=len(points) + 1))[:-1]
            ok = (count >= 5) & (n - count >= 5)
            if not ok.any():
                continue
            low, high = np.maximum(count, 1), np.maximum(n - count, 1)
            gain = np.where(ok, part**2 / low + (total - part) ** 2 / high - base, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float(points[k])))
    if best[1] is None:
        out[rows] = total / max(n, 1)
        return
    f, cut = best[1]
    above = x[rows, f] > cut
    for side, part_rows in ((False, rows[~above]), (True, rows[above])):
        step = (*path, (f, side, cut))
        paths.append(step)
        _grow(x, y, cuts, depth - 1, step, paths, out, part_rows)


def _simplify(path: tuple[Test, ...]) -> tuple[Test, ...]:
    """The tightest test per feature and side, in a fixed order."""
    kept: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        old = kept.get((f, above))
        kept[f, above] = cut if old is None else (max(old, cut) if above else min(old, cut))
    return tuple((f, above, cut) for (f, above), cut in sorted(kept.items()))


def extract_rules(x: np.ndarray, y: np.ndarray, n_trees: int = N_TREES, depth: int = DEPTH) -> list[tuple[Test, ...]]:
    """Distinct tree paths of trees boosted on the logistic residuals."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    margin = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[tuple[Test, ...], None] = {}
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        paths: list[tuple[Test, ...]] = []
        leaf = np.zeros(len(y))
        _grow(x, y - p, cuts, depth, (), paths, leaf, np.arange(len(y)))
        margin += SHRINKAGE * 4 * leaf  # 4: the curvature bound of the logistic loss
        found.update(dict.fromkeys(map(_simplify, paths)))
    return list(found)


def _holds(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, l1: float = L1, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    w = np.zeros(k + 1)
    w[0] = math.log((y.sum() + 1) / (n - y.sum() + 1))
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleModel:
    """Fitted ensemble: ``intercept`` and ``(weight, rule)`` pairs."""

    intercept: float
    rules: tuple[tuple[float, tuple[Test, ...]], ...]

    def score(self) -> Column:
        """The compiled expression over the columns of ``with_features``."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for f, above, cut in rule:
                value = F.col(f"_f_{FEATURES[f]}")
                holds = holds & ((value > cut) if above else (value <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        def words_of(rule):
            return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {cut:.4g}" for f, above, cut in rule)

        return [f"{w:+.3f} if {words_of(r)}" for w, r in sorted(self.rules, key=lambda x: -abs(x[0]))]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    """Fit on the ``labels (key, label)`` whose document is in ``docs``."""
    chosen = (
        labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_y"))
        .filter("_id is not null and _y is not null")
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_train)
    )
    by_id = chosen.groupBy("_id").agg(F.sort_array(F.collect_list("_y")).alias("_ys"))  # at most max_train labels
    bodies = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    features = [f"_f_{f}" for f in FEATURES]
    rows = cut_lineage(with_features(bodies.join(F.broadcast(by_id), "_id"), ["_id", "_ys"], "_text").distinct())
    first = rows.groupBy("_id").agg(F.min(F.struct(*features)).alias("_first"))  # no window: an id may hold most rows
    later = F.struct(*features) != F.col("_first")
    rows = (
        rows.join(F.broadcast(first), "_id")
        .select("_id", F.explode("_ys").alias("_y"), *features, F.when(later, F.xxhash64(*features)).alias("_later"))
        .orderBy(F.asc_nulls_first("_later"), F.xxhash64("_id"), "_id", "_y", *features)
        .limit(max_train)
        .drop("_later")
        .toPandas()
    )
    if not len(rows):
        return RuleModel(0.0, ())
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    x = rows[features].to_numpy(dtype=float)
    y = rows["_y"].to_numpy(dtype=float)
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if y.min() == y.max():
        return RuleModel(prior, ())
    found = extract_rules(x, y)
    if not found:
        return RuleModel(prior, ())
    intercept, weights = lasso_logistic(np.stack([_holds(r, x) for r in found], axis=1).astype(float), y)
    kept = tuple((float(w), r) for w, r in zip(weights, found) if abs(w) > 1e-6)
    return RuleModel(intercept, kept)


def score(docs: DataFrame, model: RuleModel, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1, higher: label 1 likelier) for every row of ``docs``."""
    names = [f"_keep_{i}" for i in range(len(keep))]  # whatever the columns are called, none clashes with a feature
    renamed = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.col(text).alias("_text"))
    scored = with_features(renamed, names, "_text").withColumn("_score", model.score())
    return scored.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], F.col("_score").alias("score"))
