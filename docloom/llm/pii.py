"""Personal data by weak supervision (operator 2).

Every whole text is scanned once.  The four base kinds follow fixed patterns and
always stay.  Besides them the scan proposes candidate spans of looser
patterns, and a set of labelers votes on each proposal and each base span: a strict
pattern, a checksum, a gazetteer, the words before it and the text around it.
A vote is for, against or abstain.

The labelers' reliabilities are unknown and nothing is labelled by hand.
Expectation-maximisation over the counts of vote patterns (Dawid and Skene, 1979)
estimates how often each labeler votes each way for true and for false spans,
and with it the probability that a pattern is personal data.  A logistic span
classifier is trained on those probabilities, with the votes and the span's
shape as features; it decides which proposals are added.

The counts of patterns are the only thing the driver sees: there are at most
kinds x 3^labelers x shapes of them, whatever the corpus.  They are made from
all documents.

Defined results: a null or empty text has no spans; offsets are code points, end
exclusive; a proposal that overlaps a base span or an earlier proposal of its
text is not made; repeated rows repeat their result; other columns are ignored;
an empty table gives an empty result.  A very long text is scanned whole, in time that grows with
its length and its spans (runs of digits of any length included).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import cut_lineage

# Fixed values of the contract ---------------------------------------------------
BASE_KINDS = ("email", "ip", "card", "phone")
# ---------------------------------------------------------------------------------
EXTRA_KINDS = ("email_spelled", "phone_national", "ssn", "iban", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS
LABELERS = ("strict", "checksum", "gazetteer", "context", "surroundings")
CUT = 0.5  # a proposal is added from this probability on

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its first digit only: later starts match no better
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser proposals
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?[\[(]\s?(?:at|AT)\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[(]\s?(?:dot|DOT)\s?[\])]|\.)\s?[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])"
)
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)[\x20-]?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[\x20.-])[0-9]{3,4}(?:[\x20-]?[0-9]{2,4}){1,2}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
# a run of key characters with a digit in it
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{20,200}={0,2}(?![A-Za-z0-9_+/=-])")

# Gazetteers and context words (fixed values) --------------------------------------
TOP_DOMAINS = frozenset("com org net edu gov int info io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt ie jp cn in br mx ru example test".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "94", "98", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "385", "386", "420", "421", "971", "972")
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "60", "62", "64", "65", "35", "30", "36", "38")
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "IE": 22, "PL": 28, "SE": 24, "DK": 18, "FI": 18, "NO": 15}
CUES = {
    "email": r"mail|contact|kontakt|correo|courriel|adresse|address|write|schreib",
    "ip": r"\bip\b|host|server|addr|login|client|gateway",
    "card": r"card|karte|carte|tarjeta|visa|master|amex|credit|kredit|pay",
    "phone": r"tel|phone|fon|call|mobil|cell|fax|ruf|appel|llam|whatsapp",
    "ssn": r"ssn|social|security|sozial",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "secret": r"token|secret|key|passw|pwd|auth|bearer|credential",
}
SECRET_PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "AKIA", "ASIA", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG-", "hf_", "npm_", "pypi-")
AGAINST = r"(?:version|v|ver|order|invoice|isbn|issn|id|no|nr|ref|page|fig|sku|part|serial|build|release)[\s.:#=]*$"
# ------------------------------------------------------------------------------------
_CUES = {k: re.compile(v, re.I) for k, v in CUES.items()}
_AGAINST = re.compile(r"(?<![A-Za-z])" + AGAINST, re.I)
_FAMILY = {"email_spelled": "email", "phone_national": "phone"}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind as listed and then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # around each @: the run of local characters before it and the domain after it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def proposals(text: str, taken: Sequence[Span]) -> list[Span]:
    """Spans of the looser patterns that overlap neither ``taken`` nor each other."""
    found = []
    if "[" in text or "(" in text:
        found += [("email_spelled", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    for kind, pattern in (("ssn", _SSN), ("iban", _IBAN), ("phone_national", _NATIONAL), ("secret", _SECRET)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    starts, ends = [], []  # the places used, as disjoint intervals in order
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, a, b in found:
        at = bisect.bisect_left(ends, a + 1)  # the first interval that ends after a
        if at == len(starts) or starts[at] >= b:
            out.append((kind, a, b))
            starts.insert(at, a)
            ends.insert(at, b)
    return out


def entropy(s: str) -> float:
    """Bits for each character, by the string's own frequencies."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 abstain."""
    s, d, family = text[a:b], _digits(text[a:b]), _FAMILY.get(kind, kind)
    strict = checksum = gazetteer = 0
    if kind == "email":
        local, _, domain = s.partition("@")
        strict = 1 if local[0] not in ".-%+" and ".." not in s and not domain.startswith("-") else -1
        gazetteer = 1 if domain.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    elif kind == "email_spelled":
        strict = 1 if re.search(r"[\[(]\s?(?:dot|DOT)", s) else 0
        gazetteer = 1 if re.split(r"[\s.\])]+", s.strip())[-1].lower() in TOP_DOMAINS else -1
    elif kind == "ip":
        parts = s.split(".")
        strict = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        gazetteer = -1 if parts[0] == "0" or all(len(p) == 1 for p in parts) else 1
    elif kind == "card":
        checksum = 1 if luhn(d) else -1
        strict = 1 if len(d) in (15, 16) else 0
        gazetteer = 1 if d.startswith(CARD_PREFIXES) else -1
    elif kind == "phone":
        strict = 1 if s.count("(") == s.count(")") and "--" not in s and ".." not in s else -1
        gazetteer = 1 if d.startswith(CALLING_CODES) else -1
    elif kind == "phone_national":
        strict = 1 if 9 <= len(d) <= 12 else -1
        gazetteer = 1 if s[0] in "(0" else 0
    elif kind == "ssn":
        checksum = 1 if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" else -1
    elif kind == "iban":
        flat = s.replace(" ", "")
        moved = flat[4:] + flat[:4]
        checksum = 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
        gazetteer = 1 if IBAN_LENGTHS.get(flat[:2]) == len(flat) else -1
    elif kind == "secret":
        hexes = all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s)
        mixed = any(c.islower() for c in s) and any(c.isupper() for c in s)
        strict = 1 if (hexes and b - a in (32, 40, 48, 64, 96, 128)) or (mixed and not hexes) else -1
        checksum = 1 if entropy(s) >= 3.2 and not s.isdigit() else -1  # random characters in place of a check digit
        gazetteer = 1 if s.startswith(SECRET_PREFIXES) else 0
    before = text[max(0, a - 40) : a]
    context = 1 if _CUES[family].search(before) else 0
    around = -1 if _AGAINST.search(before) else 0
    if not around and (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
        around = -1
    elif not around:
        around = 1 if a == 0 or text[a - 1].isspace() or text[a - 1] in ":=(<\"'" else 0
    return strict, checksum, gazetteer, context, around


def _shape(text: str, a: int, b: int) -> int:
    """Length class and separator class of a span, 0 to 11."""
    n, s = b - a, text[a:b]
    length = 0 if n < 10 else 1 if n < 15 else 2 if n < 22 else 3
    return length * 3 + (0 if s.isalnum() else 1 if " " not in s else 2)


_SPAN = "struct<kind:int,a:int,b:int,pattern:int>"


def _pattern(kind: int, votes: Sequence[int], shape: int) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code * 12 + shape


def _unpack(code: int) -> tuple[int, list[int], int]:
    code, shape = divmod(code, 12)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], shape


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)``: base spans and proposals of every whole text with their vote pattern."""
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string(f"spans array<{_SPAN}>").fields])
    numbers = {k: i for i, k in enumerate(KINDS)}
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("pattern", pa.int32())]))

    def run(batches):
        for batch in batches:
            out = []
            for body in batch.column(1):
                t = body.as_py() or ""
                spans = base_spans(t)
                spans += proposals(t, spans)
                out.append(
                    [
                        {"kind": numbers[k], "a": a, "b": b, "pattern": _pattern(numbers[k], _votes(t, k, a, b), _shape(t, a, b))}
                        for k, a, b in spans
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=arrow)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


# ---------------------------------------------------------------------------------
# reliabilities and the span classifier, on pattern counts


def estimate(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation.  ``votes`` (patterns, labelers) in -1, 0, 1.
    Returns the probability of each pattern and the labelers' rates
    ``(false or true span, labeler, against or for)`` where they vote."""
    p = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.05, 0.95)  # majority vote
    rates = np.full((2, votes.shape[1], 2), 0.5)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        for side, v in enumerate((-1, 1)):
            rates[:, :, side] = weight @ (votes == v).astype(float) + 1.0  # one pseudo-vote each way
        rates /= rates.sum(axis=2, keepdims=True)
        prior = np.array([(weight[1, kinds == k].sum() + 1) / (counts[kinds == k].sum() + 2) for k in range(len(KINDS))])[kinds]
        logs = np.stack([np.log(1 - prior), np.log(prior)])
        for j in range(votes.shape[1]):  # an abstention says nothing
            spoke = votes[:, j] != 0
            logs[:, spoke] += np.log(rates[:, j, (votes[spoke, j] + 1) // 2])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            p = new
            break
        p = new
    return p, rates


def _design(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    parts = [np.ones((len(kinds), 1)), np.eye(len(KINDS))[kinds]]
    parts += [np.stack([votes[:, j] == 1, votes[:, j] == -1], axis=1) for j in range(votes.shape[1])]
    parts += [np.eye(4)[shapes // 3], np.eye(3)[shapes % 3]]
    return np.hstack([x.astype(float) for x in parts])


def train(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, counts as weights."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + ridge * w
        hess = (x * (counts * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_patterns(patterns: Sequence[tuple[int, int]]) -> tuple[set[int], dict]:
    """The patterns the trained classifier accepts, and the labelers' rates, from
    ``(pattern, count)``."""
    if not patterns:
        return set(), {}
    codes = [p for p, _ in sorted(patterns)]
    counts = np.array([n for _, n in sorted(patterns)], dtype=float)
    parts = [_unpack(c) for c in codes]
    kinds = np.array([k for k, _, _ in parts])
    votes = np.array([v for _, v, _ in parts])
    shapes = np.array([s for _, _, s in parts])
    p, rates = estimate(votes, kinds, counts)
    x = _design(kinds, votes, shapes)
    w = train(x, p, counts)
    score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    learned = {n: {"true": rates[1, j].tolist(), "false": rates[0, j].tolist()} for j, n in enumerate(LABELERS)}
    return {c for c, s in zip(codes, score) if s >= CUT and not math.isnan(s)}, learned


def _spell(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_email, n_ip, n_card, n_phone, base, spans)`` for every row: counts of the
    base spans, the base spans and all spans as ``kind:start:end``, by kind and start."""
    scanned = cut_lineage(scan(docs, key, text))
    counted = scanned.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    accepted, _ = fit_patterns([(r["pattern"], r["n"]) for r in counted.collect()])  # bounded: module docstring
    good = docs.sparkSession.sparkContext.broadcast(accepted)
    schema = T.StructType(
        [docs.schema[key], *T._parse_datatype_string("n_email long, n_ip long, n_card long, n_phone long, base string, spans string").fields]
    )
    n_base = len(BASE_KINDS)

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            base, every = [], []
            for row in batch.column(1).to_pylist():
                spans = sorted((s["kind"], s["a"], s["b"]) for s in row if s["kind"] < n_base or s["pattern"] in good.value)
                own = [s for s in spans if s[0] < n_base]
                for i in range(n_base):
                    counts[i].append(sum(s[0] == i for s in own))
                base.append(_spell([(KINDS[k], a, b) for k, a, b in own]))
                every.append(_spell([(KINDS[k], a, b) for k, a, b in spans]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(every, pa.string())],
                names=schema.names,
            )

    return scanned.mapInArrow(run, schema)


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
