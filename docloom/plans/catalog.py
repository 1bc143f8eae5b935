"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs one operator (or a short composition) over the driver's
whole tables.  Nested results are flattened to strings in the registered
form so that an independent SQL engine can check them value by value; the
operators themselves keep their nested types.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import TOKENS_COL, tokens, user_key
from docloom.operators import changes, chunk, conversation, embed, evaluate, feedback, indexes, language, monitor, parse, quality, retrieve
from docloom.plans import fixtures
from docloom.session import cut_lineage, ensure_checkpoint_dir, prepare
from docloom.sources import files, tables
from docloom.streaming import monitoring, pipeline, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CHUNK_SIZE = chunk.DEFAULT_CHUNK_SIZE
CHUNK_OVERLAP = chunk.DEFAULT_CHUNK_OVERLAP
K = retrieve.DEFAULT_K


def register(fn):
    """Add a query; it prepares any session it is given (package shipped to
    the workers, checkpoint folder set) before building its plan."""

    @functools.wraps(fn)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__.removeprefix("q_")] = query
    return query


# ---------------------------------------------------------------------------
# shared steps


def window_chunk_rows(spark: SparkSession, sf_dir: str, with_ordinal: bool = False) -> DataFrame:
    docs = fixtures.parsed_docs(spark, sf_dir)
    rows = chunk.window_rows(docs, "parsed_content", CHUNK_SIZE, CHUNK_OVERLAP)
    return rows if with_ordinal else rows.drop("chunk_index")


def chunk_index_table(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Unique chunk keys of the window chunks (the table a search index syncs).

    Searches read this table several times (statistics, scoring, joining
    the text back), so it is written once to the shared checkpoint folder,
    as a pipeline writes its gold table before indexing it."""
    index = chunk.dedup_chunks(window_chunk_rows(spark, sf_dir))
    if not materialize:
        return index
    return cut_lineage(index.withColumn(TOKENS_COL, tokens("chunked_text")))


def keyword_hits(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    index = index if index is not None else chunk_index_table(spark, sf_dir)
    return retrieve.topk_keyword(fixtures.questions(spark, sf_dir), index, k=K)


# ---------------------------------------------------------------------------
# step 0: documents -> chunks -> keys -> keyword top-k -> context


@register
def q_chunk_windows(spark, sf_dir):
    rows = window_chunk_rows(spark, sf_dir, with_ordinal=True)
    return rows.select("path", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id",
                       F.length("chunked_text").cast("long").alias("chunk_chars"))


@register
def q_chunk_rows(spark, sf_dir):
    return window_chunk_rows(spark, sf_dir).select("path", "chunked_text", "chunk_id")


@register
def q_dedup_chunks(spark, sf_dir):
    return chunk_index_table(spark, sf_dir, materialize=False).select("chunk_id", "path", "chunked_text")


@register
def q_topk_keyword(spark, sf_dir):
    return keyword_hits(spark, sf_dir).select("item_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "path")


@register
def q_build_context(spark, sf_dir):
    return retrieve.build_context(keyword_hits(spark, sf_dir))


@register
def q_source_list(spark, sf_dir):
    src = retrieve.source_list(keyword_hits(spark, sf_dir))
    return src.select("item_id", F.array_join("sources", "|").alias("sources"))


# ---------------------------------------------------------------------------
# step 1: feedback -> evaluation set


TIE = ("event_id",)


def _alog(spark, sf_dir):
    return fixtures.assessment_log(spark, sf_dir)


def _deduped(spark, sf_dir):
    return feedback.dedup_assessments(_alog(spark, sf_dir), TIE)


def _ratings_text(col):
    """'position:value|...' of a rating list, for value comparison."""
    return F.array_join(
        F.transform(col, lambda r: F.concat(r["position"].cast("string"), F.lit(":"), r["ratings"]["answer_correct"]["value"])),
        "|",
    )


def _uris_text(col):
    return F.array_join(F.transform(col, lambda c: c["doc_uri"]), "|")


@register
def q_dedup_latest(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    latest = feedback.dedup_latest(ev, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return latest.select("user_id", "event_id", "event_type", "ts")


@register
def q_dedup_text(spark, sf_dir):
    d = feedback.dedup_text(_alog(spark, sf_dir), TIE)
    return d.select(
        "request_id",
        F.col("source.id").alias("source_id"),
        "step_id",
        "timestamp",
        F.col("text_assessment.ratings")["answer_correct"]["value"].alias("is_correct"),
        F.col("text_assessment.suggested_output").alias("suggested_output"),
        "event_id",
    )


@register
def q_dedup_retrieval(spark, sf_dir):
    d = feedback.dedup_retrieval(_alog(spark, sf_dir), TIE)
    return d.select(
        "request_id",
        F.col("source.id").alias("source_id"),
        F.col("retrieval_assessment.step_id").alias("step_id"),
        F.col("retrieval_assessment.position").cast("long").alias("position"),
        F.col("retrieval_assessment.ratings")["answer_correct"]["value"].alias("rating"),
        "event_id",
    )


@register
def q_nest_retrieval(spark, sf_dir):
    n = feedback.nest_retrieval(feedback.dedup_retrieval(_alog(spark, sf_dir), TIE), TIE)
    return n.select(
        "request_id",
        F.col("source.id").alias("source_id"),
        "step_id",
        "timestamp",
        _ratings_text("retrieval_assessments").alias("ratings"),
    )


@register
def q_merge_assessments(spark, sf_dir):
    m = _deduped(spark, sf_dir)
    return m.select(
        "request_id",
        "step_id",
        "timestamp",
        F.col("source.id").alias("source_id"),
        F.col("text_assessment.ratings")["answer_correct"]["value"].alias("is_correct"),
        F.col("text_assessment.suggested_output").alias("suggested_output"),
        _ratings_text("retrieval_assessment").alias("ratings"),
    )


@register
def q_attach_feedback(spark, sf_dir):
    a = feedback.attach_feedback(fixtures.request_log(spark, sf_dir), _deduped(spark, sf_dir))
    return a.select(
        "request_id", "request", "response", "is_correct", "suggested_output", "source_user",
        _ratings_text("retrieval_assessment").alias("ratings"),
    )


@register
def q_feedback_class(spark, sf_dir):
    a = feedback.attach_feedback(fixtures.request_log(spark, sf_dir), _deduped(spark, sf_dir))
    c = feedback.feedback_class(a)
    return c.select("request_id", "source_user", "is_correct", "expected_response", "source_tag")


@register
def q_chunk_ratings(spark, sf_dir):
    a = feedback.attach_feedback(fixtures.request_log(spark, sf_dir), _deduped(spark, sf_dir))
    r = feedback.chunk_ratings(a)
    return r.select("request_id", "source_user", F.array_join("chunk_at_i_relevance", "|").alias("chunk_at_i_relevance"))


@register
def q_trace_chunks(spark, sf_dir):
    t = feedback.trace_chunks(fixtures.request_log(spark, sf_dir))
    return t.select("request_id", _uris_text("retrieved_chunks").alias("doc_uris"),
                    F.size("retrieved_chunks").cast("long").alias("n_chunks"))


@register
def q_expected_context(spark, sf_dir):
    a = feedback.attach_feedback(fixtures.request_log(spark, sf_dir), _deduped(spark, sf_dir))
    e = feedback.expected_context(feedback.trace_chunks(a))
    return e.select("request_id", "source_user", _uris_text("expected_retrieved_context").alias("expected_uris"))


@register
def q_eval_set(spark, sf_dir):
    e = feedback.eval_set(fixtures.request_log(spark, sf_dir), _alog(spark, sf_dir), TIE)
    return e.select(
        "request", "request_id", "expected_response",
        _uris_text("expected_retrieved_context").alias("expected_retrieved_context"),
        "source_user", "source_tag",
    )


@register
def q_eval_set_table(spark, sf_dir):
    """The evaluation set written create-only and read back."""
    from docloom.plans.evaluation import create_evaluation_set

    name = f"eval_set_{uuid.uuid4().hex}"
    e = create_evaluation_set(
        fixtures.request_log(spark, sf_dir), _alog(spark, sf_dir), name, tie_break=TIE, path=_scratch(spark, name)
    )
    return e.select("request_id", "expected_response", _uris_text("expected_retrieved_context").alias("expected_uris"), "source_user", "source_tag")


# ---------------------------------------------------------------------------
# step 2: conversations -> question, history, search text, prompt


def _conv(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "conversations")


def _messages_text(col):
    return F.array_join(F.transform(col, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n---\n")


def conversation_prompts(spark, sf_dir):
    """Prompts with hybrid retrieval, the source system's default search."""
    from docloom.plans import answering

    return answering.conversation_prompts(_conv(spark, sf_dir), chunk_index_table(spark, sf_dir), k=K)


@register
def q_current_question(spark, sf_dir):
    conv = _conv(spark, sf_dir)
    last_user = conversation.current_question(conv, "last_user")
    last_any = conversation.current_question(conv, "last").withColumnRenamed("question", "last_message")
    return last_user.join(last_any, "conv_id")


@register
def q_history_rows(spark, sf_dir):
    return conversation.history_rows(_conv(spark, sf_dir)).select("conv_id", "turn", "role", "text")


@register
def q_format_history(spark, sf_dir):
    conv = _conv(spark, sf_dir)
    a = conversation.format_history(conv)
    b = conversation.format_history(conv, labels="user_assistant_only").withColumnRenamed("history_text", "history_chat_roles")
    return a.join(b, "conv_id")


@register
def q_history_messages(spark, sf_dir):
    h = conversation.history_messages(_conv(spark, sf_dir))
    return h.select("conv_id", _messages_text("history_messages").alias("history_messages"),
                    F.size("history_messages").cast("long").alias("n_messages"))


@register
def q_search_text(spark, sf_dir):
    view = conversation.conversation_view(_conv(spark, sf_dir))
    v = conversation.search_text(view, conversation.last_turn_rewriter)
    return v.select("conv_id", "question", "rewrite_prompt", "search_text")


@register
def q_build_prompt(spark, sf_dir):
    p = conversation_prompts(spark, sf_dir)
    return p.select("conv_id", _messages_text("prompt").alias("prompt"), F.size("prompt").cast("long").alias("n_messages"))


@register
def q_batch_answer(spark, sf_dir):
    return conversation.answer(conversation_prompts(spark, sf_dir), conversation.per_prompt(conversation.extractive_model))


# ---------------------------------------------------------------------------
# step 3: vectors, exact / approximate / hybrid top-k


def _label_centroids(spark, sf_dir):
    emb = fixtures.table(spark, sf_dir, "embeddings")
    return emb, embed.centroids(emb, "label", "embedding")


def chunk_vectors(spark, sf_dir, index=None):
    index = index if index is not None else chunk_index_table(spark, sf_dir)
    return embed.embed(index, "chunked_text")


def question_vectors(spark, sf_dir):
    return embed.embed(fixtures.questions(spark, sf_dir), "text")


def semantic_hits(spark, sf_dir, index=None):
    return retrieve.topk_semantic(question_vectors(spark, sf_dir), chunk_vectors(spark, sf_dir, index), k=K)


@register
def q_embed_chunks(spark, sf_dir):
    v = chunk_vectors(spark, sf_dir)
    return v.select(
        "chunk_id",
        F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_tokens"),
        F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_buckets"),
        F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).cast("long").alias("sq_norm"),
    )


@register
def q_embed_tfidf(spark, sf_dir):
    v = embed.embed(chunk_index_table(spark, sf_dir), "chunked_text", "vector", method="tfidf")
    return v.select(
        "chunk_id",
        F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_buckets"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 9).alias("weight_sum"),
        F.round(F.array_max("vector"), 9).alias("weight_max"),
    )


@register
def q_topk_semantic(spark, sf_dir):
    emb, cents = _label_centroids(spark, sf_dir)
    hits = retrieve.topk_semantic(cents, emb, k=K, qid="label", qvec="centroid", key="vec_id", vec="embedding")
    return hits.select(F.col("label").cast("long").alias("label"), F.col("rank").cast("long").alias("rank"), "vec_id")


@register
def q_semantic_search(spark, sf_dir):
    return semantic_hits(spark, sf_dir).select("item_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@register
def q_topk_hybrid(spark, sf_dir):
    fused = retrieve.topk_hybrid(fixtures.questions(spark, sf_dir), chunk_index_table(spark, sf_dir), k=K)
    return fused.select("item_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@register
def q_topk_ann(spark, sf_dir):
    emb, cents = _label_centroids(spark, sf_dir)
    # all cells are probed, which is exact; tests measure the recall of fewer probes
    index = retrieve.build_ivf(emb, "vec_id", "embedding")
    hits = retrieve.topk_ann(
        cents, emb, k=K, qid="label", qvec="centroid", key="vec_id", vec="embedding", index=index, n_probe=index[1].count()
    )
    return hits.select(F.col("label").cast("long").alias("label"), F.col("rank").cast("long").alias("rank"), "vec_id")


def _index_folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/indexes/{uuid.uuid4().hex}"


@register
def q_ann_search(spark, sf_dir):
    """Every 20th vector asked against all, through an index on disk with its measured probe count."""
    emb, path = fixtures.table(spark, sf_dir, "embeddings"), _index_folder(spark)
    indexes.write_vector_index(emb, path, "vec_id", "embedding", k=K)
    asks = emb.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("ask_id"), "embedding")
    hits = indexes.search_vector_index(spark, path, asks, qid="ask_id", qvec="embedding")
    return hits.select("ask_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@register
def q_keyword_postings(spark, sf_dir):
    path = _index_folder(spark)
    index = chunk_index_table(spark, sf_dir, materialize=False)
    # read several times for its keys and tokens only: the texts are not stored
    indexes.write_postings(cut_lineage(index.select("chunk_id", tokens("chunked_text").alias(TOKENS_COL))), path)
    hits = indexes.topk_postings(spark, path, fixtures.questions(spark, sf_dir), k=K)
    return hits.select("item_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


# ---------------------------------------------------------------------------
# step 4: files, parse and chunk jobs


WORD_SIZE, WORD_OVERLAP = 200, 50


def parsed_stream_shape(spark, sf_dir):
    return parse.parse_documents(fixtures.raw_files(spark, sf_dir), "text", on_error="null")


DOCS_PER_FILE = 64


def landed_documents(spark, sf_dir) -> str:
    """The documents as text files of about ``DOCS_PER_FILE`` texts each, in folders
    ``bucket=n``; returns the landing folder."""
    docs = fixtures.table(spark, sf_dir, "documents")
    base = _scratch(spark, "landed-docs")
    n = docs.count() // DOCS_PER_FILE + 1
    files.land_text_files(docs.withColumn("bucket", F.col("doc_id") % n), base, "bucket", "text")
    return base


def file_texts(scanned):
    """``(bucket, text_md5)`` of every text in scanned files: where it was landed and what it holds."""
    texts = F.split(F.decode("content", "UTF-8"), "\u0000")
    each = scanned.select("path", F.explode(F.slice(texts, 1, F.size(texts) - 1)).alias("text"))
    return each.select(F.regexp_extract("path", r"bucket=(\d+)/", 1).cast("long").alias("bucket"), F.md5("text").alias("text_md5"))


@register
def q_scan_files(spark, sf_dir):
    return file_texts(files.scan_files(spark, landed_documents(spark, sf_dir), "txt"))


@register
def q_land_pages(spark, sf_dir):
    landed = files.land_pages(fixtures.table(spark, sf_dir, "pages"), "/landing/pages")
    return landed.select("path", "page_id", "length", "status")


@register
def q_parse_text(spark, sf_dir):
    staged = parse.parse_documents(fixtures.raw_files(spark, sf_dir), "text")
    return staged.select(
        "path",
        F.col("parsing.doc_parsed_contents")["num_pages"].alias("num_pages"),
        F.col("parsing.doc_parsed_contents")["parsed_content"].alias("parsed_content"),
        F.col("parsing.parser_status").alias("parser_status"),
    )


@register
def q_parse_html(spark, sf_dir):
    landed = files.land_pages(fixtures.table(spark, sf_dir, "pages"), "/landing/pages")
    staged = parse.parse_documents(landed.drop("status"), "html")
    return staged.select("page_id", F.col("parsing.doc_parsed_contents")["parsed_content"].alias("text"),
                         F.col("parsing.parser_status").alias("parser_status"))


@register
def q_parse_nullable(spark, sf_dir):
    return parsed_stream_shape(spark, sf_dir).select("path", "parsed_content")


@register
def q_parse_split(spark, sf_dir):
    staged = parse.parse_documents(fixtures.raw_files(spark, sf_dir), "text")
    good = parse.parsed_ok(staged)
    return good.select("path", "length", F.length(F.col("doc_parsed_contents")["parsed_content"]).cast("long").alias("n_chars"))


@register
def q_parse_errors(spark, sf_dir):
    staged = parse.parse_documents(fixtures.raw_files(spark, sf_dir), "text")
    return parse.status_counts(staged)


@register
def q_chunk_recursive(spark, sf_dir):
    docs = fixtures.parsed_docs(spark, sf_dir)
    chunked = chunk.chunk_documents(docs, "parsed_content", CHUNK_SIZE, CHUNK_OVERLAP, method="recursive")
    rows = chunk.chunk_rows(chunked, with_ordinal=True)
    return rows.select("path", "chunk_index", "chunk_id", F.length("chunked_text").cast("long").alias("chunk_chars"))


@register
def q_chunk_words(spark, sf_dir):
    rows = chunk.word_window_rows(fixtures.parsed_docs(spark, sf_dir), "parsed_content", WORD_SIZE, WORD_OVERLAP)
    return rows.select("path", "chunk_index", "chunk_id")


@register
def q_chunk_errors(spark, sf_dir):
    docs = fixtures.parsed_docs(spark, sf_dir)
    chunked = chunk.chunk_documents(docs, "parsed_content", CHUNK_SIZE, CHUNK_OVERLAP, method="windows")
    return parse.status_counts(chunked, "chunked.chunker_status")


# ---------------------------------------------------------------------------
# step 5: quality, stage counts, flattening


@register
def q_quality_metrics(spark, sf_dir):
    raw = fixtures.raw_files(spark, sf_dir)
    parsed = parsed_stream_shape(spark, sf_dir)
    chunks = chunk.window_rows(parsed, "parsed_content", CHUNK_SIZE, CHUNK_OVERLAP)
    return quality.quality_metrics(
        [("raw_files", raw, "content"), ("parsed_docs", parsed, "parsed_content"), ("chunked_docs", chunks, "chunked_text")]
    )


PARSED_RULES = {"valid_content": "parsed_content IS NOT NULL", "valid_path": "path IS NOT NULL"}
CHUNK_RULES = {"valid_chunk": "chunked_text IS NOT NULL", "valid_chunk_id": "chunk_id IS NOT NULL"}


@register
def q_expectations(spark, sf_dir):
    parsed = parsed_stream_shape(spark, sf_dir)
    chunks = chunk.window_rows(parsed, "parsed_content", CHUNK_SIZE, CHUNK_OVERLAP)
    return quality.expectations(parsed, PARSED_RULES, "parsed_docs").unionByName(
        quality.expectations(chunks, CHUNK_RULES, "chunked_docs")
    )


@register
def q_stage_counts(spark, sf_dir):
    raw = fixtures.raw_files(spark, sf_dir)
    staged = parse.parse_documents(raw, "text")
    good = parse.parsed_ok(staged)
    text = good.select("path", F.col("doc_parsed_contents")["parsed_content"].alias("text"))
    chunks = chunk.window_rows(text, "text", CHUNK_SIZE, CHUNK_OVERLAP)
    return quality.stage_counts([("raw_files", raw), ("parsed_docs", good), ("chunked_docs", chunks)])


@register
def q_flatten_columns(spark, sf_dir):
    flat = quality.flatten_columns(fixtures.assessment_log(spark, sf_dir))
    maps = [f.name for f in flat.schema.fields if f.dataType.typeName() == "map"]
    return flat.select(*[F.to_json(c).alias(c) if c in maps else F.col(c) for c in flat.columns])


@register
def q_user_key(spark, sf_dir):
    conv = _conv(spark, sf_dir)
    address = F.concat(F.lit("Rev."), F.col("role"), F.lit(".No"), F.col("conv_id").cast("string"), F.lit("@Example.org"))
    return conv.select("conv_id", "turn", user_key(address).alias("user_key"))


# ---------------------------------------------------------------------------
# step 6: change sets, upserts, streaming


def _lang_snapshots(spark, sf_dir):
    """Two versions of the chunk index: the old one lacks German documents,
    the new one lacks French documents (German added, French removed)."""
    docs = fixtures.parsed_docs(spark, sf_dir)
    def index(d):
        return chunk.dedup_chunks(chunk.window_rows(d, "parsed_content", CHUNK_SIZE, CHUNK_OVERLAP))
    return index(docs.filter(F.col("lang") != "de")), index(docs.filter(F.col("lang") != "fr"))


@register
def q_table_changes(spark, sf_dir):
    old, new = _lang_snapshots(spark, sf_dir)
    return changes.table_changes(old, new, "chunk_id", ["path"])


@register
def q_apply_changes(spark, sf_dir):
    old, new = _lang_snapshots(spark, sf_dir)
    delta = changes.table_changes(old, new, "chunk_id", ["path", "chunked_text"])
    return changes.apply_changes(old, delta, "chunk_id").select("chunk_id", "path")


def _scratch(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def document_stream(spark, sf_dir, max_files: int = 1, failing: bool = True):
    """The driver's ``documents`` table (a file or a folder) read as a stream, turned into file rows."""
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern: a stream may then start from one file as well as from a folder
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files)).parquet(path[:-1] + "[t]")
    return fixtures.raw_files_from(docs, failing).withColumn("processing_timestamp", F.current_timestamp())


def _stream_names(base: str) -> dict[str, str]:
    """Table names of the streamed stages, unique per run."""
    tag = base.rsplit("-", 1)[1][:12]
    return {level: f"{name}_{tag}" for level, name in (("bronze", "raw_files"), ("silver", "parsed_docs"), ("gold", "chunked_docs"))}


def streamed_tables(spark, sf_dir, failing: bool = True, rules: bool = False):
    base = _scratch(spark, "stream")
    stream = document_stream(spark, sf_dir, failing=failing)
    runs = pipeline.run_pipeline(spark, stream, base, names=_stream_names(base), rules=rules)
    return base, runs


@register
def q_stream_files(spark, sf_dir):
    landed, base = landed_documents(spark, sf_dir), _scratch(spark, "stream")
    stage = pipeline.run_stage(pipeline.bronze_from_files(spark, landed, "txt"), base, "bronze")
    return file_texts(spark.read.parquet(stage.output))


@register
def q_stream_parsed(spark, sf_dir):
    base, _ = streamed_tables(spark, sf_dir)
    return spark.read.parquet(f"{base}/silver").select("path", "parsed_content")


@register
def q_stream_chunks(spark, sf_dir):
    base, _ = streamed_tables(spark, sf_dir, failing=False)
    return spark.read.parquet(f"{base}/gold").select("path", "chunked_text", "chunk_id")


@register
def q_stream_expectations(spark, sf_dir):
    base, _ = streamed_tables(spark, sf_dir, rules=True)
    out = None
    for table_name, stage, rules in (("parsed_docs", "silver", pipeline.PARSED_RULES), ("chunked_docs", "gold", pipeline.CHUNK_RULES)):
        failed = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("failed")) for r in rules]))
        counts = pipeline.rule_table(spark, base, stage).select("rows", failed.alias("_f")).groupBy("_f.rule").agg(
            F.sum("_f.failed").alias("failed"), F.sum("rows").alias("total")
        )
        part = counts.select(F.lit(table_name).alias("table_name"), "rule", "failed", (F.col("total") - F.col("failed")).alias("passed"), "total")
        out = part if out is None else out.unionByName(part)
    return out


@register
def q_stream_sync(spark, sf_dir):
    """Two syncs of one vector table: the documents that are not German, then all
    documents, so that most keys come back with a second path."""
    base = _scratch(spark, "stream")
    source, vectors = f"{base}/source", f"{base}/vectors"
    docs = fixtures.table(spark, sf_dir, "documents")
    for landing in (docs.filter(F.col("lang") != "de"), docs):
        landing.write.mode("append").option("compression", changes.CODEC).parquet(source)
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", "100").parquet(source)
        stream = fixtures.raw_files_from(stream, failing=False).withColumn("processing_timestamp", F.current_timestamp())
        pipeline.run_pipeline(spark, stream, base, names=_stream_names(base), rules=False)
        pipeline.sync_vectors(spark, base, vectors)
    v = spark.read.parquet(vectors)
    return v.select(
        "chunk_id",
        "path",
        F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_tokens"),
        F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_buckets"),
        F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).cast("long").alias("sq_norm"),
    )


SECOND_LANDING = 10_000_000  # seconds by which the files of the second landing are newer


def resynced(spark, sf_dir):
    """A vector table after two landings, and its version after the first.  First the documents that
    are not German.  Then the German ones, the Spanish ones with another text, and the French ones deleted."""
    base = _scratch(spark, "sync")
    docs = fixtures.table(spark, sf_dir, "documents")
    later = F.col("modificationTime") + F.make_dt_interval(secs=F.lit(SECOND_LANDING))
    edited = F.when(F.col("lang") == "es", F.concat(F.lit("Second edition. "), "text")).when(F.col("lang") != "fr", F.col("text"))
    first = fixtures.raw_files_from(docs.filter(F.col("lang") != "de"), failing=False)
    second = fixtures.raw_files_from(docs.filter(F.col("lang").isin("de", "es", "fr")).withColumn("text", edited), failing=False)
    versions = []
    for landing in (first, second.withColumn("modificationTime", later)):
        landing.write.mode("append").option("compression", changes.CODEC).parquet(f"{base}/source")
        stream = spark.readStream.schema(landing.schema).option("maxFilesPerTrigger", "100").parquet(f"{base}/source")
        table = sync.sync_documents(parse.parse_documents(stream, "text", on_error="null"), f"{base}/table")
        versions.append(table.version())
    return table, versions[0]


@register
def q_stream_resync(spark, sf_dir):
    table, _ = resynced(spark, sf_dir)
    n_tokens = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long")
    return table.vectors().select("chunk_id", "path", "n_refs", n_tokens.alias("n_tokens"))


@register
def q_change_feed(spark, sf_dir):
    table, first = resynced(spark, sf_dir)
    value = F.coalesce("new", "old")
    return table.changes_since(first).select("chunk_id", "change_type", value["path"].alias("path"), value["n_refs"].alias("n_refs"))


# ---------------------------------------------------------------------------
# step 7: evaluation and monitoring


RETRIEVAL_METRICS = ["recall", "precision_at_k", "hit", "reciprocal_rank"]


def gold_pairs(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    return evaluate.containment_pairs(docs, fixtures.questions(spark, sf_dir))


def expected_uris(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", fixtures.doc_path().alias("path"))
    return gold_pairs(spark, sf_dir).join(docs, "doc_id").select("item_id", "path")


def retrieval_table(spark, sf_dir):
    hits = evaluate.expand_paths(keyword_hits(spark, sf_dir), window_chunk_rows(spark, sf_dir))
    return evaluate.retrieval_metrics(hits, expected_uris(spark, sf_dir), K)


def served_traffic(spark, sf_dir, fraction: float | None = None):
    """Served requests (user turns with a response) with the context the
    keyword retriever gives for the request text.  With ``fraction`` the
    stable request sample is taken first: a request's context does not
    depend on the other requests, so only sampled requests are searched."""
    req = fixtures.request_log(spark, sf_dir).filter(F.col("response").isNotNull())
    if fraction is not None:
        req = monitor.sample_requests(req, "request_id", fraction)
    hits = retrieve.topk_keyword(req.select("request_id", "request"), chunk_index_table(spark, sf_dir), k=K,
                                 qid="request_id", qtext="request")
    ctx = retrieve.build_context(hits, qid="request_id")
    return req.join(ctx, "request_id", "left")


def monitored(spark, sf_dir):
    sample = served_traffic(spark, sf_dir, fraction=0.8)
    scored = monitor.groundedness(sample)
    scored = monitor.relevance(scored)
    scored = monitor.language_rule(scored, required="es")
    return monitor.safety_rule(scored)


@register
def q_gold_pairs(spark, sf_dir):
    return gold_pairs(spark, sf_dir)


@register
def q_retrieval_metrics(spark, sf_dir):
    return retrieval_table(spark, sf_dir)


@register
def q_eval_summary(spark, sf_dir):
    s = evaluate.summary(retrieval_table(spark, sf_dir), RETRIEVAL_METRICS)
    return s.select("n_questions", *[F.round(f"mean_{m}", 9).alias(f"mean_{m}") for m in RETRIEVAL_METRICS])


@register
def q_answer_match(spark, sf_dir):
    a = feedback.attach_feedback(fixtures.request_log(spark, sf_dir), _deduped(spark, sf_dir))
    rows = feedback.feedback_class(a).filter(F.col("expected_response").isNotNull())
    m = evaluate.answer_match(rows, "response", "expected_response")
    return m.select("request_id", "source_user", "exact_match", "token_f1")


@register
def q_sample_requests(spark, sf_dir):
    return monitor.sample_requests(fixtures.request_log(spark, sf_dir), "request_id", 0.8).select("request_id")


@register
def q_groundedness(spark, sf_dir):
    return monitor.groundedness(served_traffic(spark, sf_dir)).select("request_id", "groundedness")


@register
def q_relevance(spark, sf_dir):
    return monitor.relevance(fixtures.request_log(spark, sf_dir)).select("request_id", "relevance")


@register
def q_language_rule(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    return monitor.language_rule(docs, "text", F.col("lang")).select("doc_id", "lang", "detected_lang", "language_ok")


@register
def q_language_model_rule(spark, sf_dir):
    """Trigram naive Bayes fitted on all documents, and the rule with it."""
    docs = tables.spread(fixtures.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    rows = monitor.language_rule(docs, "text", F.col("lang"), language.fit(docs))
    return rows.select("doc_id", "lang", "detected_lang", "language_ok")


@register
def q_safety_rule(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    return monitor.safety_rule(docs, "text").select("doc_id", "safety_hits", "safety_ok")


@register
def q_monitor_summary(spark, sf_dir):
    return monitor.monitor_summary(monitored(spark, sf_dir))


@register
def q_stream_monitor(spark, sf_dir):
    """The sampled traffic lands in two halves; the monitoring stream is stopped between them."""
    base = _scratch(spark, "monitor")
    traffic = served_traffic(spark, sf_dir, fraction=0.8).withColumn(
        "timestamp", F.timestamp_seconds(F.regexp_extract("request_id", r"r(\d+)_", 1).cast("long") * 60)
    )
    traffic = cut_lineage(traffic)
    for half in (0, 1):
        traffic.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == half).write.mode("append").parquet(f"{base}/traffic")
        stream = spark.readStream.schema(traffic.schema).option("maxFilesPerTrigger", "100").parquet(f"{base}/traffic")
        monitoring.monitor_stream(monitoring.score(stream), f"{base}/table")
    return monitoring.monitor_total(spark, f"{base}/table")


# ---------------------------------------------------------------------------
# end-to-end plans


@register
def q_ingest_gold(spark, sf_dir):
    from docloom.plans.ingest import TableNames, batch_ingest

    result = batch_ingest(spark, fixtures.raw_files(spark, sf_dir, failing=False), TableNames.scratch(spark),
                          config={"chunker": {"size": CHUNK_SIZE, "overlap": CHUNK_OVERLAP}},
                          method="windows")
    return result.chunks.select("path", "chunked_text", "chunk_id")


@register
def q_layout_lookup(spark, sf_dir):
    """Ingest with its tables laid out by key, then the chunks of one range of keys."""
    from docloom.plans.ingest import LAYOUT, TableNames, batch_ingest

    result = batch_ingest(spark, fixtures.raw_files(spark, sf_dir, failing=False), TableNames.scratch(spark),
                          method="windows", layout=LAYOUT)
    some = result.chunks.filter(F.col("chunk_id").between("80", "8f"))
    return some.select("path", "chunked_text", "chunk_id")


@register
def q_ingest_counts(spark, sf_dir):
    from docloom.plans.ingest import TableNames, batch_ingest

    result = batch_ingest(spark, fixtures.raw_files(spark, sf_dir), TableNames.scratch(spark), method="windows")
    return spark.createDataFrame(sorted(result.counts.items()), "stage string, rows long")
