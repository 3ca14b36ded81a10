"""Plan-shape guards: no pair-producing joins, pushdown, map-side top-k."""

import re

import pytest

import __spark_entry__ as E
from parley.operators.sequence import release_shared
from parley.sources import testdata as TD

SF = "/root/testdata/sf0.001"
# fits and iterations run jobs while they are built; all other queries must not
RUN_WHILE_BUILT = {"session_topics", "label_classifier", "session_tier_model", "pipeline_report", "textrank_summary",
                   "textrank_scores", "leaderboard", "split_pairs", "split_labelled",
                   "rouge_l_tiles", "label_classifier_relational", "labelled_scan", "pair_sources", "checked_pairs", "results_sink"}
NAMES = sorted(n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n))


def physical(df):
    """The plan with the plans of all cached tables below it (they print as part of it)."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_whole_plan_has_no_nested_loop_or_cartesian(spark, name, monkeypatch):
    read = {t: TD.table(spark, SF, t) for t in ("conversations", "documents", "embeddings", "events", "labels")}
    monkeypatch.setattr(TD, "table", lambda spark, sf_dir, t: read[t])  # reading a schema is a job of its own
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        df = E.queries()[name](spark, SF)
        jobs = len(tracker.getJobIdsForGroup(group))
        plan = physical(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDFs
    if name not in RUN_WHILE_BUILT:
        assert jobs == 0
        assert re.search(r"Scan parquet|FileScan", plan)  # down to the input
    release_shared()


def test_projection_reaches_scan(spark):
    plan = physical(E.queries()["corpus_profile"](spark, SF))
    assert "ReadSchema: struct<conv_id:bigint>" in plan


def test_top_k_is_limited_map_side(spark):
    plan = physical(E.queries()["top_terms"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
