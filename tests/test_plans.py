"""Plan shape: top-k, no Python workers, anti joins, pushdown, pre-aggregation."""

import pytest

from cohortlens.operators import erasure
from cohortlens.plans import reports as R
from cohortlens.plans.registry import REPORTS
from cohortlens.sources.idlist import ids_frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_take_ordered(tables001):
    assert "TakeOrderedAndProject" in plan(R.events_top_participants(tables001))


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_python_udfs(tables001, name):
    p = plan(REPORTS[name](tables001))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                 "MapInPandas", "PythonUDF"):
        assert node not in p


def test_erase_uses_anti_join_with_broadcast(spark, tables001):
    e = erasure.materialize_erase_set(ids_frame(spark, ["3"]), tables001.participants)
    p = plan(erasure.retained(tables001.events, e))
    assert "LeftAnti" in p and "BroadcastHashJoin" in p
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(erasure.retained(tables001.events, e))
        assert "LeftAnti" in p and "BroadcastHashJoin" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_not_null_filters_reach_the_scan(spark, tables001, scratch):
    from cohortlens.sources.snapshots import create_store
    stored = create_store(spark, scratch, tables001).tables()
    p = plan(R.participants_finished(stored))
    assert "PushedFilters: [IsNotNull(started_at), IsNotNull(ended_at)]" in p
    assert "ReadSchema: struct<started_at:string,ended_at:string>" in p


def test_single_erase_is_a_pushed_predicate(spark, tables001, scratch):
    from cohortlens.sources.snapshots import create_store
    stored = create_store(spark, scratch, tables001).tables()
    e = erasure.erase_set_of(spark, ["3"], stored.participants)
    p = plan(erasure.rows_of(stored.events, e))
    assert "EqualTo(participant_id,3)" in p and "Join" not in p
    for t, df in stored.items():
        p = plan(erasure.retained(df, e))
        assert "Join" not in p and "Exchange" not in p, t
    p = plan(erasure.plan_counts(stored, e))
    assert "Exchange hashpartitioning(participant_id" not in p


def test_building_a_report_runs_no_single_task_probe(tables001):
    for fn in (R.feedback_means_by_intervention, R.feedback_means_by_skill, R.feedback_means_onepass):
        text = plan(fn(tables001))
        assert "GlobalLimit" not in text and "LocalLimit" not in text


def test_preaggregation_below_join(tables001):
    df = R.feedback_means_by_intervention(tables001)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    # the aggregate over participant_id sits below the join
    join_at = text.index("Join LeftOuter")
    assert "Aggregate [participant_id" in text[join_at:]


def test_column_pruning(tables001):
    p = plan(R.events_by_type(tables001))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_preaggregate_join_shuffles_each_side_once(spark, tables001):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = R.feedback_means_by_intervention(tables001)
        p = plan(df)
        assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p
        # fact side: partial aggregate, one exchange, final aggregate, then the join
        # reuses that partitioning; participants: one exchange
        assert p.count("Exchange hashpartitioning(participant_id") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_no_python_workers_in_any_registered_query(spark):
    from cohortlens.plans import registry
    from tests.conftest import SF001
    for name, q in registry.queries().items():
        p = plan(q(spark, SF001))
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                     "MapInPandas", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in p, (name, node)


def test_long_report_reads_each_table_once(tables001):
    df = R.report_long_onepass(tables001)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # one scan each of submissions, feedback and events, participants for the counts and as labels, and
    # the median's values (written from one more scan of participants)
    assert final.count("FileScan") <= 6
