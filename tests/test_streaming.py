"""Batch = stream: the streamed gold table equals the batch one apart from
the ingest time, and a second run with the same checkpoints adds nothing."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunk, parse
from docloom.plans import ingest
from docloom.sources import tables
from docloom.streaming import pipeline


def write_files(folder, docs):
    os.makedirs(folder, exist_ok=True)
    for name, data in docs.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)


def test_file_stream_pipeline_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    docs = {f"d{i}.txt": (("word%d " % i) * (150 + 37 * i)).encode() for i in range(6)}
    docs["bad.txt"] = b"\xff\xfe"
    write_files(src, docs)
    base = str(tmp_path / "run")
    runs = pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)

    bronze = spark.read.parquet(f"{base}/bronze")
    assert bronze.count() == 7 and "processing_timestamp" in bronze.columns
    silver = {r.path.rsplit("/", 1)[1]: r.parsed_content for r in spark.read.parquet(f"{base}/silver").collect()}
    assert silver["bad.txt"] is None  # kept with null text (Q11)

    raw = spark.read.format("binaryFile").load(src)
    batch_gold = chunk.window_rows(parse.parse_documents(raw, "text", on_error="null"), "parsed_content", 1024, 512)
    stream_gold = spark.read.parquet(f"{base}/gold").drop("processing_timestamp")
    cols = ["path", "chunked_text", "chunk_id"]
    assert sorted(stream_gold.select(cols).collect()) == sorted(batch_gold.select(cols).collect())

    silver_rows = sum(m["rows"] for m in runs["silver"].metrics)
    failed = sum(m["valid_content_failed"] for m in runs["silver"].metrics)
    assert (silver_rows, failed) == (7, 1)

    again = pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    assert spark.read.parquet(f"{base}/gold").count() == stream_gold.count()
    assert sum(m["rows"] for m in again["gold"].metrics) == 0

    write_files(src, {"late.txt": b"late arrival " * 10})
    pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    assert spark.read.parquet(f"{base}/bronze").count() == 8

    vectors = str(tmp_path / "vectors")
    pipeline.sync_vectors(spark, base, vectors, buckets=4)
    keys = {r.chunk_id for r in spark.read.parquet(vectors).collect()}
    assert keys == {r.chunk_id for r in spark.read.parquet(f"{base}/gold").collect()}
    pipeline.sync_vectors(spark, base, vectors, buckets=4)  # nothing new: same table
    assert spark.read.parquet(vectors).count() == len(keys)


def test_vector_sync_keeps_smallest_path_across_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    text = ("shared words " * 60).encode()
    write_files(src, {"b.txt": text})
    base = str(tmp_path / "run")
    vectors = str(tmp_path / "vectors")
    pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    pipeline.sync_vectors(spark, base, vectors, buckets=4)
    write_files(src, {"a.txt": text, "c.txt": text})  # same chunks, smaller and larger paths
    pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    pipeline.sync_vectors(spark, base, vectors, buckets=4)
    paths = {r.path.rsplit("/", 1)[1] for r in spark.read.parquet(vectors).collect()}
    assert paths == {"a.txt"}
    gold = chunk.dedup_chunks(spark.read.parquet(f"{base}/gold").select("path", "chunked_text", "chunk_id"))
    assert spark.read.parquet(vectors).count() == gold.count()


def test_vector_sync_never_overwrites_a_table_it_cannot_read(spark, tmp_path):
    src, base, vectors = str(tmp_path / "src"), str(tmp_path / "run"), str(tmp_path / "vectors")
    write_files(src, {f"d{i}.txt": (f"text number {i} " * 30).encode() for i in range(5)})
    pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    pipeline.sync_vectors(spark, base, vectors, buckets=1)
    files = [os.path.join(d, f) for d, _, names in os.walk(vectors) for f in names if f.endswith(".parquet")]
    kept = {f: open(f, "rb").read() for f in files}
    with open(files[0], "wb") as f:
        f.write(b"not a parquet file")
    write_files(src, {"late.txt": b"late arrival " * 30})
    pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    with pytest.raises(Exception):
        pipeline.sync_vectors(spark, base, vectors, buckets=1)
    for f in files[1:]:
        assert open(f, "rb").read() == kept[f]
    with open(files[0], "wb") as f:
        f.write(kept[files[0]])
    pipeline.sync_vectors(spark, base, vectors)  # the failed batch is taken again
    keys = {r.chunk_id for r in spark.read.parquet(vectors).collect()}
    assert keys == {r.chunk_id for r in spark.read.parquet(f"{base}/gold").collect()}


def test_rule_counts_cover_more_batches_than_the_progress_history(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "run")
    write_files(src, {f"d{i}.txt": b"some words here" for i in range(12)})
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt", 1), base, max_files_per_trigger=1)
        runs = pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt", 1), str(tmp_path / "again"), max_files_per_trigger=1)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert sum(m["rows"] for m in runs["silver"].metrics) == 12


def test_rule_counts_survive_a_lost_driver(spark, tmp_path, monkeypatch):
    src, base = str(tmp_path / "src"), str(tmp_path / "run")
    write_files(src, {"a.txt": b"some words here", "bad.txt": b"\xff\xfe"})

    def lost(*args):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(pipeline, "count_rules", lost)
        with pytest.raises(OSError):
            pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    assert pipeline.rule_table(spark, base, "silver") is None
    write_files(src, {"b.txt": b"more words"})
    pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    counts = pipeline.rule_table(spark, base, "silver").agg({"rows": "sum", "valid_content_failed": "sum"}).first()
    assert sorted(counts) == [1, 3]
    pipeline.run_pipeline(spark, pipeline.bronze_from_files(spark, src, "txt"), base)
    assert pipeline.rule_table(spark, base, "silver").agg({"rows": "sum"}).first()[0] == 3


def test_document_stream_reads_a_folder_table(spark, tmp_path):
    from docloom.plans import catalog

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    base, _ = catalog.streamed_tables(spark, str(tmp_path), failing=False)
    assert spark.read.parquet(f"{base}/silver").count() == 9


def test_streamed_tables_have_comments_and_properties(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "run")
    names = {"bronze": "s6_raw_files", "silver": "s6_parsed_docs", "gold": "s6_chunked_docs"}
    for n in (1, 2):  # a second run adds to the tables that are there
        write_files(src, {f"d{n}.txt": b"some words " * 200})
        pipeline.run_pipeline(
            spark, pipeline.bronze_from_files(spark, src, "txt"), base, names=names, config={"chunk": {"size": 1024}}
        )
        for level, name in names.items():
            assert spark.table(name).count() == spark.read.parquet(f"{base}/{level}").count() > 0
            assert spark.catalog.getTable(name).description == tables.COMMENTS[level]
            props = tables.table_tags(spark, name)
            assert (props["quality"], props["chunk__size"], props["table_source"]) == (level, "1024", "docloom")
    assert spark.table(names["bronze"]).count() == 2


def test_batch_tables_have_comments(spark, tmp_path):
    raw = spark.createDataFrame([("a.txt", bytearray(b"some words " * 200))], "path string, content binary")
    names = ingest.TableNames(**{n: f"s6_batch_{n}" for n in ("raw", "parsed_staging", "parse_errors", "parsed", "chunk_staging", "chunk_errors", "chunks")},
                              base_path=str(tmp_path / "lake"))
    ingest.batch_ingest(spark, raw, names)
    for level, name in (("bronze", names.raw), ("silver", names.parsed), ("gold", names.chunks)):
        assert spark.catalog.getTable(name).description == tables.COMMENTS[level]


def test_vector_sync_keeps_no_second_copy(spark, tmp_path):
    """a batch is grouped and written to its buckets; keys seen before keep the smallest path."""
    import os

    from docloom.session import ensure_checkpoint_dir
    from docloom.streaming import pipeline

    base, vectors = str(tmp_path / "base"), str(tmp_path / "vectors")
    tables = f"{ensure_checkpoint_dir(spark)}/tables".removeprefix("file:")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    for rows in ([("b", "one two", "k1"), ("c", "three", "k2")], [("a", "one two", "k1"), ("d", "four", "k3"), ("z", "three", "k2")]):
        spark.createDataFrame(rows, "path string, chunked_text string, chunk_id string").write.mode("append").parquet(f"{base}/gold")
        pipeline.sync_vectors(spark, base, vectors, buckets=2)
    got = {r.chunk_id: (r.path, r.chunked_text, sum(r.vector)) for r in spark.read.parquet(vectors).collect()}
    assert got == {"k1": ("a", "one two", 2.0), "k2": ("c", "three", 1.0), "k3": ("d", "four", 1.0)}
    assert (set(os.listdir(tables)) if os.path.isdir(tables) else set()) == before


def test_sync_shuffles_the_texts_once(spark, tmp_path, monkeypatch):
    """chunks go straight to the task that writes them, a repeated one a few times per task only."""
    from docloom.operators import changes, chunk

    base, vectors = str(tmp_path / "s"), str(tmp_path / "v")
    plans, dealt = [], changes.dealt

    def spy(df, *args):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), df.count()))
        return dealt(df, *args)

    monkeypatch.setattr(changes, "dealt", spy)
    rows = [(f"p{i}", "same" if i % 3 == 0 else f"text {i % 50}") for i in range(300)]
    for some in (rows[:200], rows):
        gold = spark.createDataFrame(some, "path string, chunked_text string").withColumn("chunk_id", chunk.chunk_key("chunked_text"))
        gold.coalesce(1).write.mode("append").parquet(f"{base}/gold")
        pipeline.sync_vectors(spark, base, vectors, buckets=2)
    assert len(plans) == 2 and not any("Exchange" in plan for plan, _ in plans)
    want = {}
    for path, text in rows:
        want[text] = min(path, want.get(text, path))
    assert plans[0][1] <= len(want)
    got = spark.read.parquet(vectors).collect()
    assert {r.chunked_text: r.path for r in got} == want and len(got) == len(want)
    assert all(sum(r.vector) == len(r.chunked_text.split()) for r in got)
