"""File sources (S1, S2, S9): binary files in, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schemas import RAW_FILES


def scan_files(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Every file under ``path`` (recursively), optionally only
    ``*.{file_format}``, as ``(path, modificationTime, length, content)``.
    Filters on ``length`` / ``modificationTime`` reach the file listing, and
    ``content`` is only read when selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if file_format:
        reader = reader.option("pathGlobFilter", f"*.{file_format}")
    return reader.load(path)


def stream_files(spark: SparkSession, path: str, file_format: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as an incremental stream (new files only, tracked by
    the query checkpoint), with ``processing_timestamp`` of the micro-batch."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(RAW_FILES)
        .option("recursiveFileLookup", "true")
    )
    if file_format:
        reader = reader.option("pathGlobFilter", f"*.{file_format}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).withColumn("processing_timestamp", F.current_timestamp())


def land_text_files(docs: DataFrame, base: str, key: str, text_col: str) -> None:
    """Write the texts of each ``key`` value into ``{base}/{key}={value}/part-*.txt``
    (a partitioned text write done by the executors; rows end with NUL)."""
    docs.select(key, text_col).repartition(key).write.mode("overwrite").option("lineSep", "\u0000").partitionBy(
        key
    ).text(base)


def land_pages(pages: DataFrame, base: str, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """One file row per fetched page, path ``{base}/page_{id}.pdf``.

    A page that came back empty is reported with a status and no content;
    the other pages go on.  (The HTTP export itself is outside Spark; this is
    the table job over what was fetched.)"""
    ok = F.col(body_col).isNotNull() & (F.length(F.col(body_col)) > 0)
    content = F.when(ok, F.encode(F.col(body_col), "UTF-8"))
    return pages.select(
        F.concat(F.lit(base.rstrip("/") + "/page_"), F.col(id_col).cast("string"), F.lit(".pdf")).alias("path"),
        F.col(id_col),
        F.when(ok, F.length(content)).cast("long").alias("length"),
        content.alias("content"),
        F.when(ok, F.lit("SUCCESS")).otherwise(F.concat(F.lit("ERROR: page "), F.col(id_col).cast("string"), F.lit(" is empty"))).alias(
            "status"
        ),
    )
