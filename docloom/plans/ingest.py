"""Batch ingest: files -> bronze -> silver -> gold.

Each stage is written once and read back; every later count, split and
error report reads the written table, so no parse or chunk job runs twice
(the reference recomputed them per action).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunk, parse, quality
from docloom.session import ensure_checkpoint_dir
from docloom.sources import files, tables

LAYOUT = {"bronze": "path", "silver": "path", "gold": "chunk_id"}  # key that each level is looked up by


@dataclass
class TableNames:
    """Names of the pipeline's tables (one config object, Q19)."""

    raw: str = "raw_files"
    parsed_staging: str = "parsed_docs_staging"
    parse_errors: str = "parse_errors"
    parsed: str = "parsed_docs"
    chunk_staging: str = "chunked_docs_staging"
    chunk_errors: str = "chunk_errors"
    chunks: str = "chunked_docs"
    base_path: str | None = None  # external tables under this folder when set

    def path(self, name: str) -> str | None:
        return f"{self.base_path.rstrip('/')}/{name}" if self.base_path else None

    @staticmethod
    def scratch(spark: SparkSession) -> "TableNames":
        """Uniquely named external tables in the shared checkpoint folder."""
        tag = uuid.uuid4().hex[:12]
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{tag}"
        return TableNames(*(f"{n}_{tag}" for n in (
            "raw_files", "parsed_docs_staging", "parse_errors", "parsed_docs",
            "chunked_docs_staging", "chunk_errors", "chunked_docs")), base_path=base)


@dataclass
class IngestResult:
    raw: DataFrame
    parsed: DataFrame
    chunks: DataFrame
    parse_errors: DataFrame
    chunk_errors: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def batch_ingest(
    spark: SparkSession,
    raw_files: DataFrame | str,
    names: TableNames | None = None,
    config: Mapping[str, Any] | None = None,
    parser: str | Callable[[bytes], list[str]] = "text",
    method: str = "recursive",
    size: int = chunk.DEFAULT_CHUNK_SIZE,
    overlap: int = chunk.DEFAULT_CHUNK_OVERLAP,
    file_format: str | None = None,
    layout: Mapping[str, str] | None = None,
) -> IngestResult:
    """Run the batch pipeline.  ``raw_files`` is a folder (scanned with S1)
    or a file-rows DataFrame.  Chunk parameters are checked before any job.
    ``layout`` (level -> key, such as ``LAYOUT``) lays the files of a level out by a key."""
    chunk.check_chunk_params(size, overlap)
    names = names or TableNames()
    config = dict(config or {})
    order = {level: (key,) for level, key in (layout or {}).items()}
    raw = files.scan_files(spark, raw_files, file_format) if isinstance(raw_files, str) else raw_files

    bronze = tables.save_table(raw, names.raw, path=names.path(names.raw), order_by=order.get("bronze", ()))
    tables.require_rows(bronze, "the source")  # S10
    _tag(spark, names.raw, config, "bronze")

    staged = tables.save_table(parse.parse_documents(bronze, parser), names.parsed_staging,
                               path=names.path(names.parsed_staging))
    errors = tables.save_table(parse.parse_failures(staged), names.parse_errors, path=names.path(names.parse_errors))
    silver = tables.save_table(parse.parsed_ok(staged), names.parsed, path=names.path(names.parsed),
                               order_by=order.get("silver", ()))
    _tag(spark, names.parsed, config, "silver")

    text = silver.select("path", F.col("doc_parsed_contents")["parsed_content"].alias("parsed_content"))
    chunked = tables.save_table(
        chunk.chunk_documents(text, "parsed_content", size, overlap, method=method).select("path", "chunked"),
        names.chunk_staging,
        path=names.path(names.chunk_staging),
    )
    chunk_errs = tables.save_table(chunk.chunk_errors(chunked), names.chunk_errors, path=names.path(names.chunk_errors))
    gold = tables.save_table(chunk.chunk_rows(chunked), names.chunks, path=names.path(names.chunks),
                             order_by=order.get("gold", ()))
    _tag(spark, names.chunks, config, "gold")

    counts = {r["stage"]: int(r["rows"]) for r in quality.stage_counts(
        [("raw_files", bronze), ("parsed_docs", silver), ("parse_errors", errors),
         ("chunk_errors", chunk_errs), ("chunked_docs", gold)]).collect()}  # five rows
    return IngestResult(bronze, silver, gold, errors, chunk_errs, counts)


def _tag(spark: SparkSession, name: str, config: Mapping[str, Any], level: str) -> None:
    tables.tag_table(spark, name, {**config, "quality": level}, comment=tables.COMMENTS[level])
