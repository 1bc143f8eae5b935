"""Rule bitmask ledger over document texts (operator 3; DataFrame functions only).

Every rule is evaluated once.  The ledger holds, per document, the
measurements and ``fail_bits``, whose bit i is set when rule i fails.  A policy
is a version name and the mask of the rules it enforces: applying one, or
asking what a rule changes, reads the ledger only and never the texts.

``n_repeat_words`` finds the 3-word windows that occur twice inside one row:
window hashes are made by zipping the word array with itself, sorted with
their places, and neighbours compared.  The sort is skipped for texts whose
windows are all different.

Defined results: a null or empty text, or one of white space only, has no words
and fails ``too_short``; repeated rows repeat their result; all columns of the
input but those listed by ``ledger`` are ignored; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WHITE, WHITE_CHARS, words

# Fixed values of the contract ------------------------------------------------------
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
# ------------------------------------------------------------------------------------
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rules over the measurements.  The order fixes the bit: append, never reorder.
RULES: dict[str, str] = {
    "too_short": f"n_words < {MIN_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_text_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 60 * word_chars",
}
BASE_RULES = ("too_short", "repeated_words")
POLICIES: dict[str, Sequence[str]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbols", "duplicate_lines"),
    "v3": tuple(RULES),
}
CURRENT = "v3"


def mask(rules: Sequence[str]) -> int:
    """Bit mask of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(df: DataFrame, word_col: str, keep: Sequence[str]) -> DataFrame:
    """Adds ``n_repeat_words``: words inside 3-word windows that occur at least twice.

    Each step is a projection of its own, so that no array is computed twice."""
    m = F.col("n_words") - (WINDOW - 1)
    pairs = F.zip_with(
        F.slice(word_col, F.lit(1), m), F.slice(word_col, F.lit(2), m), lambda a, b: F.xxhash64(a, b)
    )
    hashes = F.zip_with(pairs, F.slice(word_col, F.lit(3), m), lambda h, c: F.xxhash64(h, c))
    df = df.select(*keep, F.when(F.col("n_words") > WINDOW, hashes).alias("_h"))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).alias("_s"))
    n = F.size("_s")
    same = F.zip_with(F.slice("_s", F.lit(1), n - 1), F.slice("_s", F.lit(2), n - 1), lambda a, b: a["h"] == b["h"])
    df = df.select(*keep, "_s", same.alias("_e"))
    either = F.zip_with(
        F.concat(F.array(F.lit(False)), F.col("_e")), F.concat(F.col("_e"), F.array(F.lit(False))), lambda a, b: a | b
    )
    places = F.filter(F.zip_with("_s", either, lambda s, e: F.when(e, s["i"])), lambda i: i.isNotNull())
    df = df.select(*keep, F.sort_array(places).alias("_p"))
    k = F.size("_p")
    steps = F.zip_with(
        F.slice("_p", F.lit(1), k - 1), F.slice("_p", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))
    )
    covered = F.aggregate(steps, F.lit(WINDOW), lambda total, s: total + s)
    return df.select(*keep, F.coalesce(F.when(k > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines", "n_capitals")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, measurements)`` of every whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    df = docs.select(F.col(key), body.alias("_t"), words(text).alias("_w"), lines.alias("_l"))
    df = df.select(
        key,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", WHITE_CHARS, "")).cast("long").alias("word_chars"),
        _removed(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_text_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _removed(F.col("_t"), CAPITALS).cast("long").alias("n_capitals"),
    )
    return _repeat_words(df, "_w", [key, *MEASURES])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """``(key, measurements, fail_bits)``: every rule evaluated once per document."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, key, text).withColumn("fail_bits", total)


def passes(policy_mask: int, bits: str = "fail_bits") -> Column:
    """True when no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(policy_mask)) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``policy`` and ``kept`` under it."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", passes(mask(POLICIES[policy])))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of ``policy``: documents that fail it, documents that fail
    it alone, documents kept with and without it.  The ledger is first reduced to
    a count per bit pattern (at most two to the number of rules rows)."""
    names, full = list(RULES), mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(full)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule_rows = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    )
    each = patterns.select("bits", "n", rule_rows.alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
