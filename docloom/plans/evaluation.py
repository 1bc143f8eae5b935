"""Feedback logs -> saved evaluation set (E7 + S5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from docloom.operators import feedback
from docloom.sources import tables


def create_evaluation_set(
    request_log: DataFrame,
    assessment_log: DataFrame,
    name: str,
    mode: str = "errorifexists",
    tie_break: Sequence[str] = (),
    relevant_values: Sequence[str] = feedback.RELEVANT,
    path: str | None = None,
) -> DataFrame:
    """Build the six-column evaluation set and save it.  The default mode is
    create-only, so a rerun fails instead of replacing reviewed data (Q20)."""
    ev = feedback.eval_set(request_log, assessment_log, tie_break, relevant_values)
    return tables.save_table(ev, name, mode=mode, path=path)
