"""Quality rules and classifier, personal data and decontamination."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm_fixtures import edges, make_docs  # noqa: F401

from docloom.llm import decontaminate, pii, quality_rules, rule_ensemble
from docloom.llm.queries import held_out

SF01 = "/root/testdata/sf0.01"
SPACE = r"[\x20\x09-\x0D]"


# -- rules ------------------------------------------------------------------------------


def measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(t.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def rule_texts(rnd):
    texts = [" ".join(rnd.choice("a b c dd é 漢 # $$ XX".split()) for _ in range(rnd.randint(0, 90))) for _ in range(150)]
    texts += ["\n".join(rnd.choice(["x y", "x y ", "", " ", "z"]) for _ in range(20)) for _ in range(20)]
    texts += ["a\x0bb\x0cc\rd e", "w " * 40_000, "a b", "a b c", "a b c a b c", None, ""]
    return texts


def test_measurements_equal_brute_force(make_docs):
    texts = rule_texts(random.Random(1))
    rows = quality_rules.ledger(make_docs(list(enumerate(texts)), clash=True)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def test_ledger_bits_policies_and_ablations(make_docs, edges):
    texts = rule_texts(random.Random(2))
    rows = quality_rules.ledger(make_docs(list(enumerate(texts)))).cache()
    bits = {r.doc_id: r.fail_bits for r in rows.collect()}
    names = list(quality_rules.RULES)
    for policy, rules in quality_rules.POLICIES.items():
        mask = quality_rules.mask(rules)
        kept = {r.doc_id: r.kept for r in quality_rules.apply_policy(rows, policy).collect()}
        assert kept == {i: b & mask == 0 for i, b in bits.items()}
        for r in quality_rules.ablations(rows, policy).collect():
            bit = 1 << names.index(r.rule)
            assert r.n_failed == sum(1 for b in bits.values() if b & bit)
            assert r.n_failed_alone == sum(1 for b in bits.values() if b & mask == bit)
            assert r.n_kept == sum(1 for b in bits.values() if b & mask == 0)
            assert r.n_kept_without == sum(1 for b in bits.values() if b & (mask & ~bit) == 0)
    out = quality_rules.apply_policy(quality_rules.ledger(edges)).collect()
    assert len(out) == edges.count() and not any(r.kept for r in out)
    assert quality_rules.ledger(make_docs([])).count() == 0


def test_rules_use_no_python(make_docs):
    plan = quality_rules.apply_policy(quality_rules.ledger(make_docs([(1, "a")])))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- classifier -------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = rule_ensemble.fit(docs, labels.filter(~held_out()))
    assert 0 < len(model.rules) < 200 and model.describe()
    rows = rule_ensemble.score(docs, model).join(labels, "doc_id").filter(held_out()).select("score", "quality").collect()
    right = np.mean([(r.score >= rule_ensemble.THRESHOLD) == (r.quality == 1) for r in rows])
    clean = np.mean([r.score >= rule_ensemble.THRESHOLD for r in rows if r.quality == 1])
    assert len(rows) > 500 and right >= 0.98 and clean >= 0.99


def test_compiled_rules_equal_the_fitted_model(make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(rule_texts(random.Random(3)))], clash=True)
    rnd = np.random.default_rng(0)
    rules = [tuple((int(f), bool(rnd.random() < 0.5), float(rnd.random() * 3)) for f in rnd.integers(0, len(rule_ensemble.FEATURES), 2)) for _ in range(20)]
    model = rule_ensemble.RuleModel(-0.3, tuple((float(w), r) for w, r in zip(rnd.normal(size=20), rules)))
    rows = rule_ensemble.with_features(docs.select("doc_id", "text"), ["doc_id"]).orderBy("doc_id").collect()
    x = np.array([[r[f"_f_{f}"] for f in rule_ensemble.FEATURES] for r in rows])
    want = 1 / (1 + np.exp(-(model.intercept + sum(w * rule_ensemble._holds(r, x) for w, r in model.rules))))
    got = [r.score for r in rule_ensemble.score(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want)


def test_classifier_edges(edges, make_docs, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None), (99, 0)], "doc_id long, quality int")
    for given in (labels, labels.filter("quality = 1"), labels.limit(0)):
        model = rule_ensemble.fit(edges, given)
        rows = rule_ensemble.score(edges, model).collect()
        assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert rule_ensemble.score(make_docs([]), rule_ensemble.fit(make_docs([]), labels)).count() == 0


def test_classifier_fits_at_most_max_train_rows(make_docs, spark, monkeypatch):
    good, bad = "plain words in a plain line", "# $ % & #"
    texts = [(i, f"{good} {'w' * i}" if i % 2 else f"{bad} {'#' * i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fitted = []
    extract = rule_ensemble.extract_rules
    monkeypatch.setattr(rule_ensemble, "extract_rules", lambda x, y: fitted.append((len(y), int(y.sum()))) or extract(x, y))
    model = rule_ensemble.fit(make_docs(texts), labels)
    # one text a hundred times over is one row of the fit
    assert rule_ensemble.fit(make_docs(texts + texts[:1] * 100), labels) == model
    # one id of many texts: the bound holds for rows, and the other ids are all there
    many = texts + [(0, f"{bad} {'%' * i}") for i in range(100)]
    rule_ensemble.fit(make_docs(many), labels, max_train=45)
    assert fitted == [(40, 20), (40, 20), (45, 20)]
    # each of several labels counts
    rule_ensemble.fit(make_docs(texts), labels.unionByName(labels.limit(3)))
    assert fitted[-1][0] == 43


# -- personal data ------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(0)
    for _ in range(30_000):
        text = "".join(rnd.choice("a@.1+2 -(0%é)9") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("9" * 100_000 + "a" * 100_000 + "@") == []  # long runs stay linear


SAMPLES = [
    ("mail me: ann.lee@example.org or call +44 (20) 7946-0958 now", ["email", "phone"]),
    ("card 4111 1111 1111 1111 host 192.168.10.20", ["ip", "card"]),
    ("write to bob [at] example [dot] com", ["email_spelled"]),
    ("IBAN: DE89 3704 0044 0532 0130 00", ["iban"]),
    ("my ssn is 078-05-1120", ["ssn"]),
    ("version 1.2.3 of 2024-05-06, order 12345", []),
]


def test_spans_base_stays_and_method_adds(make_docs):
    texts = [f"{t} x{i}" for i in range(40) for t, _ in SAMPLES]
    rows = sorted(pii.find(make_docs(list(enumerate(texts)), clash=True)).collect(), key=lambda r: r.doc_id)
    for r, text in zip(rows, texts):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text))
        assert r.base == base
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.BASE_KINDS] == [s for s in base.split(",") if s]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in base.split(",")) for k in pii.BASE_KINDS)
    found = {tuple(s.split(":")[0] for s in r.spans.split(",") if s) for r in rows[:6]}
    assert ("email_spelled",) in found and ("iban",) in found and () in found


def test_reliabilities_separate_good_and_bad_labelers():
    rnd = np.random.default_rng(1)
    truth = rnd.random(4000) < 0.6
    noise = [0.05, 0.1, 0.45, 0.2, 0.3]
    votes = np.stack([np.where(rnd.random(4000) < e, ~truth, truth) * 2 - 1 for e in noise], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, rates = pii.estimate(patterns, np.zeros(len(patterns), dtype=int), counts.astype(float))
    by = {tuple(v): x for v, x in zip(patterns, p)}
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes, truth)]) > 0.95
    assert abs(rates[1, 0, 1] - 0.95) < 0.05 and rates[1, 2, 1] < 0.65


def test_pii_edges(edges, make_docs):
    rows = pii.find(edges).collect()
    assert len(rows) == edges.count() and all((r.base, r.spans) == ("", "") for r in rows)
    assert pii.find(make_docs([])).count() == 0


# -- decontamination ------------------------------------------------------------------------


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute_leaks(texts, items, threshold=0.8):
    out = {}
    for i, t in texts.items():
        w = tokens(t)
        for j, item in items.items():
            want = tokens(item)
            if not want:
                continue
            k = min(5, len(want))
            a, b = shingles(w, k), Counter(shingles(want, k))
            m, best = sum(b.values()), 0
            if b.keys().isdisjoint(a):
                continue
            for s in range(max(1, len(a) - m + 1)):
                c = Counter(a[s : s + m])
                both = sum((b & c).values())
                best = max(best, both / (m + sum(c.values()) - both))
            if best >= threshold:
                out[i, j] = round(best, 9)
    return out


def test_leaks_equal_brute_force(spark, make_docs):
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    items = {j: " ".join(rnd.choice(vocab) for _ in range(rnd.choice([7, 20, 40, 60]))) for j in range(12)}
    items |= {50: "", 51: None, 52: "short one", 53: "a a a a a a a a a a a a", 54: "!!"}
    texts = {}
    for i in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        if i % 2:
            leak = tokens(items[rnd.randrange(12)])
            for _ in range(rnd.randint(0, 3)):  # replaced, dropped and added words
                at = rnd.randrange(len(leak))
                leak[at : at + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 1)
            at = rnd.randint(0, len(w))
            w[at:at] = leak
        texts[i] = ", ".join(w).title()
    texts |= {900: "this is a short, ONE?", 901: "a a a a a a a a a a a a a a", 902: None, 903: " ".join(tokens(items[0])[:-1])}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.contaminations(make_docs(list(texts.items()), clash=True), bench).collect()
    want = brute_leaks(texts, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == want
    assert len(want) > 40 and len({x for x in want.values() if x < 1}) > 5


def test_leak_edges_and_native_plan(spark, edges, make_docs):
    bench = spark.createDataFrame([(1, "same text here again and again"), (1, "same text here again and again")], "item_id long, text string")
    rows = decontaminate.contaminations(edges, bench)
    assert {r.doc_id for r in rows.collect()} == {6, 7}
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().toString())
    kept = decontaminate.drop_contaminated(edges, bench)
    assert kept.columns == edges.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5]
    assert decontaminate.contaminations(edges, bench.limit(0)).count() == 0
    assert decontaminate.contaminations(make_docs([]), bench).count() == 0


def test_leak_in_a_very_long_text(spark, make_docs):
    rnd = random.Random(6)
    item = [f"w{rnd.randrange(500)}" for _ in range(400)]
    long = [f"w{rnd.randrange(500)}" for _ in range(60_000)]
    leak = item[:200] + ["other"] + item[201:]
    texts = [(1, " ".join(long)), (2, " ".join(long[:40_000] + leak + long[40_000:])), (3, "w1 " * 50_000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "w1 " * 300)], "item_id long, text string")
    rows = decontaminate.contaminations(make_docs(texts), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.n_words) for r in rows) == [(2, 1, 40_000, 400), (3, 2, 0, 300)]
    assert {r.item_id: r.similarity for r in rows} == {1: round(391 / 401, 9), 2: 1.0}


def test_block_index_finds_all_within_the_radius(spark):
    rnd = random.Random(7)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = [rnd.getrandbits(64) for _ in range(60)]
    near = []
    for _ in range(300):
        x = rnd.choice(prints)
        for b in rnd.sample(range(64), rnd.randint(0, 30)):
            x ^= 1 << b
        near.append(x)
    items = spark.createDataFrame([(i, 9, signed(x)) for i, x in enumerate(prints)], "_no long, n int, _ifp long")
    windows = spark.createDataFrame([(i, 9, signed(x)) for i, x in enumerate(near)], "id long, n int, _fp long")
    for radius in (0, 3, 23):
        got = [(r["id"], r["_no"]) for r in decontaminate.candidates(windows, items, radius).collect()]
        want = [(i, j) for i, x in enumerate(near) for j, y in enumerate(prints) if (x ^ y).bit_count() <= radius]
        assert sorted(got) == sorted(want)


def test_few_windows_of_clean_texts_reach_the_block_index(spark, make_docs):
    rnd = random.Random(8)
    phrases = [" ".join(rnd.choice("abcdefghij") * 2 for _ in range(6)) for _ in range(40)]  # common to texts and items
    body = lambda n: " ".join(rnd.choice(phrases) + f" x{rnd.randrange(10**6)}" for _ in range(n))
    items = {j: body(5) for j in range(20)}
    texts = {i: body(30) + (" " + items[i % 20] if i % 10 == 0 else "") for i in range(100)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    held = decontaminate.benchmark_items(bench).withColumn("_s", F.explode("_ih")).select("n", "k", "m", "_s").distinct()
    hits = decontaminate._hits(make_docs(list(texts.items())), held, "doc_id", "text", 5)
    with_a_hit = sum(len(tokens(t)) for t in texts.values())
    assert decontaminate._windows(hits, 0.8).count() < with_a_hit / 20
    rows = decontaminate.contaminations(make_docs(list(texts.items())), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == set(brute_leaks(texts, items)) == {(i, i % 20) for i in range(0, 100, 10)}


def test_long_runs_of_digits_and_many_spans():
    for n in (5_000, 1_000_000):
        assert pii.base_spans("0" * n + "1.1.1.1") == [("ip", 0, n + 7)]
        assert pii.base_spans("1" * n + ".1.1.1") == []
    text = "call 030 1234567, " * 4000
    base = pii.base_spans(text)
    found = pii.proposals(text, base)
    assert len(found) == 4000 and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_proposals_overlap_neither_base_nor_each_other():
    rnd = random.Random(4)
    for _ in range(300):
        taken = [("ip", a, a + rnd.randint(1, 9)) for a in (rnd.randrange(150) for _ in range(4))]
        text = " ".join(rnd.choice(["555-12-9876", "a1b2c3d4e5f6a7b8c9d0e1f2", "(030) 1234567", "GB82 WEST 1234 5698 7654 32", "word"]) for _ in range(12))
        used = [(a, b) for _, a, b in taken]
        for _, a, b in pii.proposals(text, taken):
            assert all(b <= x or y <= a for x, y in used)
            used.append((a, b))


def test_secrets_are_proposed_and_kept(spark):
    """The tokens of the corpus are beyond the base kinds: all are found, and nothing else is taken for one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r"token\W+([0-9a-f]{40})\b", t)}
    got = set()
    for r in pii.find(docs).collect():
        for s in filter(None, r.spans.split(",")):
            kind, a, b = s.split(":")
            if kind == "secret":
                got.add((r.doc_id, int(a), int(b)))
    assert len(want) > 5 and want <= got
    assert all(re.fullmatch(r"(?=.*[0-9])[0-9a-f]{40}|[A-Za-z0-9_+/=-]{20,}", texts[i][a:b]) for i, a, b in got)
