"""Inputs derived from the driver's tables (recipes of FIXTURES.md §3).

Each recipe is a plain projection/filter of a driver table, expressed with
functions that exist in both Spark and DuckDB so the SQL oracle can rebuild
the same rows.  Every recipe reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.tables import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the recipes ------------------------------------------------
PARSE_FAILURE_EVERY = 97  # in the parse and quality queries, documents with doc_id % 97 = 0 stand for parse failures
UNREVIEWED_EVERY = 3  # requests of conversations with conv_id % 3 = 0 get no review
TRACE_LENGTH = 8  # retrieved chunks per request
TRACE_URIS = 20  # distinct document uris in traces
# -----------------------------------------------------------------------------


# Text-heavy tables: per-row work (chunking, tokenizing, parsing) dominates, so
# a scan with fewer partitions than task slots is spread before that work.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def doc_path(source="source", doc_id="doc_id"):
    return F.concat(F.col(source), F.lit("/"), F.col(doc_id).cast("string"), F.lit(".txt"))


def parsed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-shaped parsed documents ``(path, doc_id, lang, parsed_content)``, whole texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(doc_path().alias("path"), "doc_id", "lang", F.col("text").alias("parsed_content"))


def raw_files(spark: SparkSession, sf_dir: str, failing: bool = True) -> DataFrame:
    """File-shaped documents ``(path, modificationTime, length, content)``: the
    UTF-8 bytes of each document.  With ``failing`` every 97th document is not
    valid UTF-8 (a file the text parser rejects)."""
    return raw_files_from(table(spark, sf_dir, "documents"), failing)


def raw_files_from(docs: DataFrame, failing: bool = True) -> DataFrame:
    """The raw-file recipe over any ``documents``-shaped frame (batch or stream)."""
    content = F.encode(F.col("text"), "UTF-8")
    if failing:
        content = F.when(F.col("doc_id") % PARSE_FAILURE_EVERY == 0, F.unhex(F.lit("FFFE00"))).otherwise(content)
    return docs.select(
        doc_path().alias("path"),
        F.timestamp_seconds(F.col("doc_id")).alias("modificationTime"),
        F.length(content).cast("long").alias("length"),
        content.alias("content"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions ``(item_id, text)``."""
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def request_key():
    return F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as requests: ``request_id = 'r' || conv_id || '_' || turn``,
    response = text of the next turn (if any), trace = 8 retrieved chunks."""
    conv = table(spark, sf_dir, "conversations")
    nxt = conv.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    users = conv.filter(F.col("role") == "user").join(nxt, ["conv_id", "turn"], "left")
    entries = F.transform(
        F.sequence(F.lit(0), F.lit(TRACE_LENGTH - 1)),
        lambda i: F.struct(
            F.concat(F.lit("d"), ((F.col("conv_id") + i) % TRACE_URIS).cast("string")).alias("doc_uri"),
            F.concat(F.lit("c"), i.cast("string")).alias("content"),
        ),
    )
    return users.select(
        request_key().alias("request_id"),
        F.col("text").alias("request"),
        "response",
        F.to_json(F.struct(entries.alias("retrieved"))).alias("trace"),
    )


def _reviewed(events: DataFrame, conv: DataFrame) -> DataFrame:
    """``events`` with the ``(conv_id, turn)`` of the request each one reviews."""
    n_conv = int(conv.agg(F.max("conv_id")).first()[0] or 0) + 1
    by_conv = Window.partitionBy("conv_id")
    users = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", (F.row_number().over(by_conv.orderBy("turn")) - 1).cast("long").alias("_nth")
    )
    counts = conv.filter(F.col("role") == "user").groupBy("conv_id").agg(F.count(F.lit(1)).alias("_users"))
    first = F.col("event_id") % n_conv
    picked = F.when(first % UNREVIEWED_EVERY == 0, (first + 1) % n_conv).otherwise(first)
    placed = events.select("*", picked.alias("conv_id"), F.floor(F.col("event_id") / n_conv).alias("_round")).join(counts, "conv_id")
    placed = placed.withColumn("_nth", F.col("_round") % F.col("_users"))
    return placed.join(users, ["conv_id", "_nth"]).drop("_nth", "_round", "_users")


def assessment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer clicks from ``events``.  Every event belongs to a request: it picks
    conversation ``event_id % conversations`` (the next one where that is a
    multiple of 3, so some requests stay without a review) and there the user
    turn number ``event_id // conversations``, counted round.  purchase / error
    / view are answer ratings (positive / negative / unknown); click / signup
    rate the retrieved chunk at position ``props.k % 8`` (true / false).
    ``event_id`` is kept as tie-break."""
    ev = _reviewed(table(spark, sf_dir, "events"), table(spark, sf_dir, "conversations"))
    answer = (
        F.when(F.col("event_type") == "purchase", "positive")
        .when(F.col("event_type") == "error", "negative")
        .when(F.col("event_type") == "view", "unknown")
    )
    chunk_rating = F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "signup", "false")
    step = F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string"))
    position = F.get_json_object("props", "$.k").try_cast("int") % TRACE_LENGTH
    text_assessment = F.when(
        answer.isNotNull(),
        F.struct(
            F.create_map(F.lit("answer_correct"), F.struct(answer.alias("value"))).alias("ratings"),
            F.when(F.col("value") > 35, F.concat(F.lit("edit "), F.col("event_id").cast("string")))
            .otherwise(F.lit(""))
            .alias("suggested_output"),
        ),
    )
    retrieval_assessment = F.when(
        chunk_rating.isNotNull(),
        F.struct(
            position.alias("position"),
            step.alias("step_id"),
            F.create_map(F.lit("answer_correct"), F.struct(chunk_rating.alias("value"))).alias("ratings"),
        ),
    )
    return ev.select(
        request_key().alias("request_id"),
        F.col("ts").alias("timestamp"),
        F.struct(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("id")).alias("source"),
        step.alias("step_id"),
        text_assessment.alias("text_assessment"),
        retrieval_assessment.alias("retrieval_assessment"),
        "event_id",
    )
