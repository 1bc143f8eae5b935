import pytest
from pyspark.sql import functions as F

from docloom.operators import quality
from docloom.sources import tables


def test_metrics_and_expectations(spark):
    a = spark.createDataFrame([("x",), (None,)], "content string")
    b = spark.createDataFrame([("p", None), (None, "t")], "path string, parsed_content string")
    m = {r.table_name: (r.total_records, r.null_content_count) for r in quality.quality_metrics(
        [("raw_files", a, "content"), ("parsed_docs", b, "parsed_content")]).collect()}
    assert m == {"raw_files": (2, 1), "parsed_docs": (2, 1)}
    e = {r.rule: (r.failed, r.passed, r.total) for r in quality.expectations(
        b, {"valid_content": "parsed_content IS NOT NULL", "valid_path": "path IS NOT NULL"}).collect()}
    assert e == {"valid_content": (1, 1, 2), "valid_path": (1, 1, 2)}


def test_stage_counts(spark):
    df = spark.range(5)
    got = {r.stage: r.rows for r in quality.stage_counts([("a", df), ("b", df.filter("id > 2"))]).collect()}
    assert got == {"a": 5, "b": 2}


def test_flatten_columns(spark):
    df = spark.createDataFrame([(1, (2, (3, "x")), [1])], "a int, b struct<c:int, d:struct<e:int, f:string>>, g array<int>")
    flat = quality.flatten_columns(df)
    assert flat.columns == ["a", "b__c", "b__d__e", "b__d__f", "g"]
    assert tuple(flat.collect()[0]) == (1, 2, 3, "x", [1])


def test_flatten_config_and_tags(spark, tmp_path):
    cfg = {"pipeline": {"chunker": {"size": 1024, "overlap": 512}, "parser": "text"}, "k": 8}
    flat = tables.flatten_config(cfg)
    assert flat == {"pipeline__chunker__size": "1024", "pipeline__chunker__overlap": "512",
                    "pipeline__parser": "text", "k": "8"}
    spark.sql(f"CREATE TABLE tagged (id INT) USING parquet LOCATION '{tmp_path / 'tagged'}'")
    tags = tables.tag_table(spark, "tagged", cfg)
    props = tables.table_tags(spark, "tagged")
    assert all(props[k] == v for k, v in tags.items())
    assert props["table_source"] == "docloom"
    spark.sql("DROP TABLE tagged")


def test_save_modes_and_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    tables.save_table(df, "t_overwrite")
    tables.save_table(df.withColumn("extra", F.lit(1)), "t_overwrite")  # schema replaced
    assert "extra" in spark.table("t_overwrite").columns
    tables.save_table(df, "t_create_only", mode="errorifexists")
    with pytest.raises(Exception):
        tables.save_table(df, "t_create_only", mode="errorifexists")  # rerun fails (Q20)
    with pytest.raises(ValueError):
        tables.require_rows(df.filter("id > 5"), "source folder")
    spark.sql("DROP TABLE t_overwrite")
    spark.sql("DROP TABLE t_create_only")


def test_gold_questions_literal_rows(spark):
    rows = [{"request": "How are chunks keyed?", "request_id": "g1", "expected_response": "By md5 of the text.",
             "expected_retrieved_context": [{"doc_uri": "src1/1.txt"}]},
            {"request": "Unlabelled", "request_id": "g2", "expected_response": None, "expected_retrieved_context": None}]
    df = tables.gold_questions(spark, rows)
    got = df.orderBy("request_id").collect()
    assert got[0].expected_retrieved_context[0].doc_uri == "src1/1.txt"
    assert got[1].expected_retrieved_context is None
