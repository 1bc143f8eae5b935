import pytest
from pyspark.sql import functions as F

from conftest import SF001
from docloom.operators import chunk, conversation
from docloom.plans import answering, catalog, evaluation, fixtures
from docloom.plans.ingest import TableNames, batch_ingest
from docloom.sources import tables


def test_batch_ingest_writes_each_stage_once(spark, tmp_path):
    raw = fixtures.raw_files(spark, SF001)
    names = TableNames.scratch(spark)
    result = batch_ingest(spark, raw, names, config={"chunker": {"size": 1024}}, method="recursive")
    n_docs = raw.count()
    bad = raw.filter(F.col("length") == 3).count()
    assert result.counts["raw_files"] == n_docs
    assert result.counts["parse_errors"] == bad and result.counts["parsed_docs"] == n_docs - bad
    assert result.counts["chunk_errors"] == 0
    assert result.counts["chunked_docs"] == spark.table(names.chunks).count() > 0
    props = tables.table_tags(spark, names.chunks)
    assert props["quality"] == "gold" and props["chunker__size"] == "1024"
    # failed parses go to their own table, never to the chunks
    err_paths = {r.path for r in spark.table(names.parse_errors).collect()}
    assert not err_paths & {r.path for r in spark.table(names.chunks).select("path").distinct().collect()}


def test_batch_ingest_rejects_bad_settings_and_empty_input(spark, tmp_path):
    raw = fixtures.raw_files(spark, SF001)
    with pytest.raises(ValueError):
        batch_ingest(spark, raw, TableNames.scratch(spark), size=100, overlap=100)
    with pytest.raises(ValueError):
        batch_ingest(spark, raw.filter("false"), TableNames.scratch(spark))


def test_evaluation_set_is_create_only(spark, tmp_path):
    req = fixtures.request_log(spark, SF001)
    alog = fixtures.assessment_log(spark, SF001)
    path = str(tmp_path / "eval_set")
    ev = evaluation.create_evaluation_set(req, alog, "eval_set_t", tie_break=["event_id"], path=path)
    assert ev.columns == ["request", "request_id", "expected_response", "expected_retrieved_context",
                          "source_user", "source_tag"]
    assert ev.count() > 0
    with pytest.raises(Exception):
        evaluation.create_evaluation_set(req, alog, "eval_set_t", tie_break=["event_id"], path=path)
    spark.sql("DROP TABLE eval_set_t")


@pytest.mark.parametrize("query_type", ["keyword", "semantic", "hybrid"])
def test_answering_flow(spark, query_type):
    conv = fixtures.table(spark, SF001, "conversations")
    chunks = catalog.chunk_index_table(spark, SF001)
    prompts = answering.conversation_prompts(conv, chunks, k=4, query_type=query_type)
    rows = prompts.collect()
    with_question = conversation.current_question(conv).filter(F.col("question").isNotNull()).count()
    assert len(rows) == with_question
    assert all(r.prompt[0].role == "system" and r.prompt[-1].role == "user" for r in rows)
    assert all(r.prompt[0].content.count("Passage: ") <= 4 for r in rows)
    answers = answering.answer_conversations(conv, chunks, conversation.per_prompt(conversation.extractive_model), k=4,
                                             query_type=query_type).collect()
    assert len(answers) == len(rows)


def test_unknown_query_type(spark):
    conv = fixtures.table(spark, SF001, "conversations")
    with pytest.raises(ValueError):
        answering.conversation_prompts(conv, catalog.chunk_index_table(spark, SF001), query_type="fuzzy")


def test_tables_laid_out_by_key_skip_files(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from docloom.sources import tables

    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.md5(F.col("id").cast("string"))).alias("key"),
        F.concat(F.lit("text "), "id").alias("text"), F.array("id").alias("more"),
    ).repartition(8, "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tables.save_table(rows, "laid_out_by_key", path=str(tmp_path / "t"), order_by=("key",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = []
    for file in glob.glob(str(tmp_path / "t" / "*.parquet")):
        table = pq.read_table(file, columns=["key"])
        keys = table.column("key").to_pylist()
        assert keys == sorted(keys)
        if keys:
            ranges.append((keys[0], keys[-1], len(keys)))
    key = out.filter("key <> 'hot'").orderBy("key").first()["key"]
    assert sum(lo <= key <= hi for lo, hi, _ in ranges) == 1 < len(ranges)  # the others are skipped by their statistics
    assert sum(lo <= "hot" <= hi for lo, hi, _ in ranges) >= 2 and max(n for *_, n in ranges) < 40_000 / 3
    assert out.exceptAll(rows).isEmpty() and rows.exceptAll(out).isEmpty()
    spark.sql("DROP TABLE laid_out_by_key")
