"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark
decontamination and best-fit packing.

Each stage works on all rows its predecessor kept, and all but the last return
the columns of ``documents``.  A stage decides on slim tables (ids and
verdicts) and takes the decision into effect with one anti join, so whole texts
are shuffled at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, line_dedup, packing, rule_ensemble, simhash_dedup
from docloom.llm.common import anti_join_ids, read
from docloom.llm.queries import held_out
from docloom.session import cut_lineage, prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.  Rows that share a
    doc_id go when all of them are rejected; a row without one stays."""
    prepare(spark)
    model = rule_ensemble.fit(docs, read(spark, sf_dir, "labels").filter(~held_out()))
    scored = cut_lineage(rule_ensemble.score(docs, model))
    best = scored.groupBy("doc_id").agg(F.max("score").alias("score"))
    return anti_join_ids(docs, best.filter(F.col("score") < rule_ensemble.THRESHOLD))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of smaller id holds; a null text
    stays null, and ``n_chars`` follows the text."""
    prepare(spark)
    rows = line_dedup.LineIndex(spark).insert(docs).clean(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    prepare(spark)
    return simhash_dedup.keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and the sequences they are packed into."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", pack),
]

# A fitted classifier and SimHash (XXH64) are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
