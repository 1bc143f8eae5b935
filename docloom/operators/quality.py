"""Data-quality jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_counts(df: DataFrame, name: str, column: str) -> DataFrame:
    """One row ``(table_name, total_records, null_content_count)``."""
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col(column).isNull()).alias("null_content_count"),
    )


def quality_metrics(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Row and null counts of several tables, one row each
    (``UNION ALL`` of one-row aggregates; each is a partial + final
    aggregate, so no table is ever gathered in one place)."""
    parts = [null_counts(df, name, col) for name, df, col in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expectations(df: DataFrame, rules: Mapping[str, str], table_name: str = "") -> DataFrame:
    """A3: for each named SQL rule, rows that pass and fail (rows are kept;
    a null rule result counts as a failure)."""
    aggs = []
    for name, sql in rules.items():
        ok = F.coalesce(F.expr(sql), F.lit(False))
        aggs += [F.count_if(~ok).alias(f"{name}__failed"), F.count_if(ok).alias(f"{name}__passed")]
    row = df.agg(F.count(F.lit(1)).alias("total"), *aggs)
    stacked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    F.col(f"{name}__failed").alias("failed"),
                    F.col(f"{name}__passed").alias("passed"),
                )
                for name in rules
            ]
        )
    )
    return row.select(F.lit(table_name).alias("table_name"), "total", stacked.alias("r")).select(
        "table_name", "r.rule", "r.failed", "r.passed", "total"
    )


def stage_counts(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Row count per pipeline stage."""
    parts = [df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows")) for name, df in stages]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _flat_fields(schema: T.StructType, sep: str, prefix: tuple[str, ...] = ()) -> list[tuple[Column, str]]:
    out: list[tuple[Column, str]] = []
    for field in schema.fields:
        path = prefix + (field.name,)
        if isinstance(field.dataType, T.StructType):
            out += _flat_fields(field.dataType, sep, path)
        else:
            col = F.col(path[0])
            for name in path[1:]:
                col = col[name]
            out.append((col, sep.join(path)))
    return out


def flatten_columns(df: DataFrame, sep: str = "__") -> DataFrame:
    """every nested struct field becomes a top-level column named
    ``a__b__c`` (arrays and maps are left as they are).  A pure projection."""
    return df.select(*[c.alias(name) for c, name in _flat_fields(df.schema, sep)])
