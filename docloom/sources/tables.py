"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN_TYPES = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Rebalance a scan that yields fewer partitions than the cluster has task
    slots (for example one large single-row-group file) before per-row heavy
    work.  Inputs that already have enough partitions are left untouched, so
    on a large table this adds no shuffle."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` dealt by ranges of ``keys`` and sorted inside its partitions, so that the
    files written from it hold narrow key ranges and a lookup by key skips most of
    them.  Rows of one key are dealt on by a hash of their other plain columns, so a key
    with a large share of the rows spans several files.  The ranges come from a
    sample of the keys: ``df`` should read a table, as it is scanned twice."""
    plain = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, PLAIN_TYPES)]
    rest = [F.xxhash64(*plain)] if plain else []
    return df.repartitionByRange(*[F.col(k) for k in keys], *rest).sortWithinPartitions(*keys)


def save_table(
    df: DataFrame, name: str, mode: str = "overwrite", partition_by: Sequence[str] = (), path: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Write ``df`` as a table and return the table read back.

    ``mode="overwrite"`` replaces data and schema (S4); ``mode="errorifexists"``
    is the create-only write of the evaluation set (S5), which fails on a
    rerun.  With ``path`` the table is external, stored at that folder.  With
    ``order_by`` its files are laid out by these keys (``ordered``).
    """
    writer = (ordered(df, order_by) if order_by else df).write.mode(mode)
    if path:
        writer = writer.option("path", path)
    if mode == "overwrite":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when ``df`` is empty (one bounded job: ``isEmpty``)."""
    if df.isEmpty():
        raise ValueError(f"{what} does not contain any rows")
    return df


def flatten_config(config: Mapping[str, Any], sep: str = "__") -> dict[str, str]:
    """Tags of a nested configuration: the path to each leaf, its keys joined by
    ``sep``, with the leaf as text, in the order of the configuration."""
    open_paths: list[tuple[tuple[str, ...], Any]] = [((), config)]
    tags: dict[str, str] = {}
    while open_paths:
        path, value = open_paths.pop()
        if isinstance(value, Mapping):
            open_paths.extend([((*path, str(key)), below) for key, below in reversed(list(value.items()))])
        else:
            tags[sep.join(path)] = str(value)
    return tags


def _sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# quality level -> comment of the tables of the batch and the streamed ingest
COMMENTS = {
    "bronze": "Raw files",
    "silver": "Parsed document contents",
    "gold": "Chunked document contents for vector search",
}


def register_folder(spark: SparkSession, name: str, path: str) -> None:
    """A catalog table over the parquet folder ``path`` (external: dropping it leaves the files)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION {_sql_string(path)}")
    spark.catalog.refreshTable(name)


def tag_table(
    spark: SparkSession, name: str, config: Mapping[str, Any], source: str = "docloom", comment: str | None = None
) -> dict[str, str]:
    """Record the flattened configuration, and the table source, as table
    properties (``ALTER TABLE ... SET TBLPROPERTIES``), and ``comment`` as the
    table's comment.  Returns the tags."""
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {name} IS {_sql_string(comment)}")
    tags = flatten_config(config)
    tags["table_source"] = source
    props = ", ".join(f"{_sql_string(k)} = {_sql_string(v)}" for k, v in sorted(tags.items()))
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({props})")
    return tags


def table_tags(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    return {r["key"]: r["value"] for r in rows}


def gold_questions(spark: SparkSession, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Literal question rows with the nested evaluation schema."""
    from docloom.schemas import GOLD_QUESTIONS

    return spark.createDataFrame(
        [
            (
                r.get("request"),
                r.get("request_id"),
                r.get("expected_response"),
                [(c.get("doc_uri"),) for c in r["expected_retrieved_context"]]
                if r.get("expected_retrieved_context") is not None
                else None,
            )
            for r in rows
        ],
        GOLD_QUESTIONS,
    )
