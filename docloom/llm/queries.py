"""Registered queries of the training-data operators: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import collocations, conversation_trie, decontaminate, embedding_dedup, line_dedup, packing, pii, quality_rules, rule_ensemble, sharding, simhash_dedup, suffix_dedup, warc
from docloom.llm.common import read
from docloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    @functools.wraps(fn)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = query
    return query


@register
def op1_simhash_dedup(spark, sf_dir):
    groups = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_dedup.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@register
def op2_pii(spark, sf_dir):
    rows = pii.find(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans"
    )


@register
def op3_quality_rules(spark, sf_dir):
    rows = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes(quality_rules.mask(quality_rules.BASE_RULES))).alias("base_failed"),
        "kept",
        "fail_bits",
        "policy",
    )


@register
def op4_sharding(spark, sf_dir):
    rows = sharding.shard(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register
def op5_line_dedup(spark, sf_dir):
    rows = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@register
def op6_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@register
def op7_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


@register
def op8_quality_classifier(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = rule_ensemble.fit(docs, labels.filter(~held_out()))
    rows = rule_ensemble.score(docs, model)
    predicted = F.when(F.col("score") >= rule_ensemble.THRESHOLD, 1).otherwise(0)
    return rows.select("doc_id", held_out().alias("held_out"), "score", predicted.cast("int").alias("predicted"))


@register
def op9_warc(spark, sf_dir):
    index = warc.write_archives(read(spark, sf_dir, "pages"))
    rows = warc.read_records(index, payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op11_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@register
def op12_conversation_trie(spark, sf_dir):
    return conversation_trie.shared_prefix_trie(read(spark, sf_dir, "conversations"))


@register
def op13_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))
