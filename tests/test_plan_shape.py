"""Plan properties that must hold at any scale."""

import pytest

import __spark_entry__ as entry
from conftest import SF001


def _plan(spark, name):
    return entry.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["topk_keyword", "topk_semantic", "dedup_text", "dedup_retrieval", "topk_hybrid"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_binary_scan_prunes_content(spark, tmp_path):
    from docloom.sources import files

    (tmp_path / "a.txt").write_text("x")
    plan = files.scan_files(spark, str(tmp_path), "txt").select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
