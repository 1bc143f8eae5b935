"""Shared building blocks: size-checked broadcast and per-group top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Runs one bounded job (``limit`` stops the scan early), so the check costs
    at most ``max_rows + 1`` rows however large ``df`` is.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def top_k_per_group(
    df: DataFrame,
    group: Sequence[Column | str],
    order: Sequence[Column | str],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the first ``k`` rows of each group, numbered 1..k in ``rank_col``.

    ``row_number() <= k`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so a hot group ships at most ``k`` rows per input
    partition; the final sort per group then sees a bounded number of rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
