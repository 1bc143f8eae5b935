from pyspark.sql import functions as F

from docloom.operators import evaluate, language, monitor


def test_sample_is_stable_and_close_to_fraction(spark):
    df = spark.range(4000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"))
    a = {r.request_id for r in monitor.sample_requests(df, "request_id", 0.8).collect()}
    b = {r.request_id for r in monitor.sample_requests(df.repartition(5), "request_id", 0.8).collect()}
    assert a == b
    assert 0.75 < len(a) / 4000 < 0.85
    assert monitor.sample_requests(df, "request_id", 0.0).count() == 0
    assert monitor.sample_requests(df, "request_id", 1.0).count() == 4000


def test_rules(spark):
    df = spark.createDataFrame([
        ("what is the cat", "the cat is on the mat", "Passage: the cat sat on the mat"),
        ("que es", "el gato y la casa de los perros", "nada"),
        ("mail?", "write to jane.doe@example.com or +1 (555) 555-1234", ""),
    ], "request string, response string, context string")
    out = monitor.safety_rule(monitor.language_rule(monitor.relevance(monitor.groundedness(df)), required="es")).collect()
    assert out[0].groundedness == 0.8 and out[0].relevance == 0.75  # "is" is not in the context
    assert out[0].detected_lang == "en" and not out[0].language_ok
    assert out[1].detected_lang == "es" and out[1].language_ok
    assert out[2].safety_hits == 2 and not out[2].safety_ok and out[0].safety_ok
    s = monitor.monitor_summary(monitor.safety_rule(monitor.language_rule(monitor.relevance(monitor.groundedness(df))))).collect()[0]
    assert s.n_requests == 3 and abs(s.safety_pass - 2 / 3) < 1e-12


def test_answer_match(spark):
    df = spark.createDataFrame([("The cat sat", "the cat sat"), ("a a b", "a c"), ("x", None)], "response string, expected_response string")
    out = evaluate.answer_match(df).collect()
    assert (out[0].exact_match, out[0].token_f1) == (1, 1.0)
    assert out[1].exact_match == 0 and abs(out[1].token_f1 - 2 * 1 / 5) < 1e-12


def test_retrieval_metrics_and_summary(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "z")], "item_id long, rank int, path string")
    expected = spark.createDataFrame([(1, "a"), (1, "c"), (2, "y"), (3, "q")], "item_id long, path string")
    m = {r.item_id: r for r in evaluate.retrieval_metrics(hits, expected, k=3).collect()}
    assert (m[1].n_found, m[1].recall, m[1].hit, m[1].reciprocal_rank) == (1, 0.5, 1, 1.0)
    assert abs(m[1].precision_at_k - 2 / 3) < 1e-12
    assert (m[2].hit, m[2].reciprocal_rank) == (0, 0.0)
    assert m[3].n_found == 0
    s = evaluate.summary(evaluate.retrieval_metrics(hits, expected, k=3), ["recall"]).collect()[0]
    assert s.n_questions == 3 and abs(s.mean_recall - 0.5 / 3) < 1e-12


def test_containment_pairs_short_and_long_passages(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "beta gamma"),
                                  (3, "x alphabet gamma")], "doc_id long, text string")
    passages = spark.createDataFrame([(10, "gamma delta epsilon zeta eta theta iota kappa"), (11, "beta gamma"),
                                      (12, "not there")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in evaluate.containment_pairs(docs, passages).collect()}
    assert got == {(1, 10), (1, 11), (2, 11)}


def test_containment_inside_words(spark):
    docs = spark.createDataFrame([(1, "xxalpha beta gammayy"), (2, "alpha beta gamma")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in evaluate.containment_pairs(docs, passages).collect()}
    assert got == {(1, 7), (2, 7)}  # the passage starts and ends inside words of doc 1


def test_language_model_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs.filter(~held_out))
    assert model.languages == tuple(sorted(model.languages)) and model.weights.shape == (len(model.languages), language.BUCKETS)
    scored = monitor.language_rule(docs.filter(held_out), "text", F.col("lang"), model)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    n, ok = scored.agg(F.count(F.lit(1)), F.count_if("language_ok")).first()
    _, by_words = monitor.language_rule(docs.filter(held_out), "text", F.col("lang")).agg(F.count(F.lit(1)), F.count_if("language_ok")).first()
    assert n > 100 and ok / n > 0.9 and ok >= by_words


def test_language_model_edges(spark):
    rows = [("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), (None, "en"), ("x", None), ("", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(df)
    assert model.languages == ("en", "fr")
    texts = [("on the mat",), ("sur le tapis",), (None,), ("",), (" 12 !",), ("z",), ("the cat " * 100_000,), ("\U0001d11e le chat \u6f22",)]
    out = spark.createDataFrame(texts, "text string").select(language.language_by_model("text", model).alias("l")).collect()
    assert [r.l for r in out] == ["en", "fr", None, None, None, "en", "en", "fr"]  # "z": unseen, and en has fewer trigrams
    nothing = language.fit(df.limit(0))
    assert df.select(language.language_by_model("text", nothing).alias("l")).filter("l is not null").count() == 0


def test_language_rule_counts_trigrams_without_a_row_each(spark):
    """fitting and scoring explode no trigram into a row or a fold, and agree with the native column."""
    rows = [("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), (None, "en"), ("x", None), ("", "fr"), ("le \U0001d11e " * 9000, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(df)
    scored = monitor.language_rule(df, "text", F.col("lang"), model)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
    got = [r.detected_lang for r in scored.collect()]
    assert got == [r.l for r in df.select(language.language_by_model("text", model).alias("l")).collect()]
    assert got[:2] == ["en", "fr"] and got[2] is None and got[4] is None
