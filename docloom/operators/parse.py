"""Parse jobs (P1-P4): file rows ``(path, ..., content binary)`` -> text.

Output shape (batch): ``parsing struct<doc_parsed_contents map<string,string>,
parser_status string>`` with map keys ``num_pages`` and ``parsed_content``;
a failure gives status ``ERROR: ...`` and empty contents.  The stream shape
(``on_error="null"``) is a nullable ``parsed_content`` string.

Built-in parsers are native expressions:
* ``text``: UTF-8 text; pages are separated by form feeds (P3).
* ``html``: visible text of a page (comments, scripts, styles, tags removed).
An injected parser (``bytes -> list of page texts``) runs in ``mapInArrow``:
one plan node, Arrow batches, the parser built once per task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import html_to_text
from docloom.schemas import PARSING

SUCCESS = "SUCCESS"
PAGE_BREAK = "\f"  # fixed value: form feed separates pages in text files


def _contents(num_pages: Column, text: Column) -> Column:
    return F.create_map(F.lit("num_pages"), num_pages, F.lit("parsed_content"), text)


def _status(ok: Column, message: str) -> Column:
    return F.when(ok, F.lit(SUCCESS)).otherwise(F.lit(f"ERROR: {message}"))


def _native_parsing(content: Column, parser: str) -> Column:
    text = content.cast("string")
    ok = content.isNotNull() & F.is_valid_utf8(text)
    if parser == "text":
        pages = F.split(text, PAGE_BREAK)
        parsed = F.array_join(pages, "\n")
        num = F.size(pages).cast("string")
    elif parser == "html":
        parsed = html_to_text(text)
        num = F.lit("1")
    else:
        raise ValueError(f"unknown parser {parser!r}")
    empty = _contents(F.lit(""), F.lit(""))
    return F.struct(
        F.when(ok, _contents(num, parsed)).otherwise(empty).alias("doc_parsed_contents"),
        _status(ok, "content is not valid UTF-8 text" if parser == "text" else "page is not valid UTF-8").alias(
            "parser_status"
        ),
    )


def _python_parsing(df: DataFrame, parser: Callable[[bytes], list[str]], content_col: str) -> DataFrame:
    schema = T.StructType(
        [f for f in df.schema.fields if f.name != content_col] + [T.StructField("parsing", PARSING, True)]
    )
    keep = [f.name for f in df.schema.fields if f.name != content_col]
    map_type = pa.map_(pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            maps, statuses = [], []
            for raw in batch.column(content_col).to_pylist():
                try:
                    if raw is None:
                        raise ValueError("no content")
                    pages = list(parser(raw))
                    maps.append([("num_pages", str(len(pages))), ("parsed_content", "\n".join(pages))])
                    statuses.append(SUCCESS)
                except Exception as exc:  # reported per document, the job goes on
                    maps.append([("num_pages", ""), ("parsed_content", "")])
                    statuses.append(f"ERROR: {exc}")
            parsing = pa.StructArray.from_arrays(
                [pa.array(maps, type=map_type), pa.array(statuses, type=pa.string())],
                names=["doc_parsed_contents", "parser_status"],
            )
            cols = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays(cols + [parsing], names=keep + ["parsing"])

    return df.mapInArrow(run, schema)


def parse_documents(
    raw: DataFrame,
    parser: str | Callable[[bytes], list[str]] = "text",
    content_col: str = "content",
    on_error: str = "status",
) -> DataFrame:
    """Parse every file row; ``content`` is dropped.

    ``on_error="status"`` (batch) adds ``parsing``; ``on_error="null"``
    (stream) adds ``parsed_content`` that is null when parsing failed.
    """
    if isinstance(parser, str):
        out = raw.withColumn("parsing", _native_parsing(F.col(content_col), parser)).drop(content_col)
    else:
        out = _python_parsing(raw, parser, content_col)
    if on_error == "status":
        return out
    if on_error != "null":
        raise ValueError("on_error must be 'status' or 'null'")
    text = F.when(
        F.col("parsing.parser_status") == SUCCESS, F.col("parsing.doc_parsed_contents")["parsed_content"]
    )
    return out.withColumn("parsed_content", text).drop("parsing")


def parsed_ok(staged: DataFrame) -> DataFrame:
    """P4, good side: successful rows with ``doc_parsed_contents`` lifted out."""
    return (
        staged.filter(F.col("parsing.parser_status") == SUCCESS)
        .withColumn("doc_parsed_contents", F.col("parsing.doc_parsed_contents"))
        .drop("parsing")
    )


def parse_failures(staged: DataFrame) -> DataFrame:
    """P4, bad side: rows whose parser failed."""
    return staged.filter(F.col("parsing.parser_status") != SUCCESS)


def status_counts(staged: DataFrame, status_col: str = "parsing.parser_status") -> DataFrame:
    """A4: rows per status (``SUCCESS`` / each error text)."""
    return staged.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n"))
