"""Properties: margins, one-pass = separate, pre-aggregated = direct, erase laws."""

from contextlib import contextmanager
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.operators import erasure
from cohortlens.operators.durations import exact_median
from cohortlens.plans import reports as R
from cohortlens.sources.idlist import ids_frame


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_label_counts_sum_to_total(tables001):
    total = R.participants_total(tables001).first()[0]
    for fn in (R.participants_by_skill_level, R.participants_by_intervention_type,
               R.participants_by_snippet_id):
        assert sum(r["n"] for r in fn(tables001).collect()) == total


def test_cross_tab_margins(tables001):
    p5 = R.participants_skill_x_intervention(tables001).collect()
    margin = {}
    for r in p5:
        margin[r["skill_level"]] = margin.get(r["skill_level"], 0) + r["n"]
    assert margin == {r[0]: r[1] for r in R.participants_by_skill_level(tables001).collect()}


def test_counts_onepass_equals_separate(tables001):
    one = R.participants_counts_onepass(tables001).collect()
    by_set = {}
    for r in one:
        by_set.setdefault(r["grouping_set"], set()).add(
            tuple(v for k, v in r.asDict().items() if k != "grouping_set" and v is not None))
    assert by_set["total"] == as_set(R.participants_total(tables001))
    assert by_set["skill_level"] == as_set(R.participants_by_skill_level(tables001))
    assert by_set["intervention_type"] == as_set(R.participants_by_intervention_type(tables001))
    assert by_set["snippet_id"] == as_set(R.participants_by_snippet_id(tables001))
    assert by_set["skill_level,intervention_type"] == as_set(
        R.participants_skill_x_intervention(tables001))
    assert by_set["skill_level,snippet_id"] == as_set(R.participants_skill_x_snippet(tables001))


def test_means_onepass_equals_separate(tables001):
    one = R.feedback_means_onepass(tables001)
    for key, fn in [("intervention_type", R.feedback_means_by_intervention),
                    ("skill_level", R.feedback_means_by_skill),
                    ("snippet_id", R.feedback_means_by_snippet)]:
        sub = one.where(f"grouping_set = '{key}'").select(key, "n", *R.RATINGS)
        assert as_set(sub) == as_set(fn(tables001))
    total = one.where("grouping_set = 'total'").select(*R.RATINGS)
    assert as_set(total) == as_set(R.feedback_means_overall(tables001))


@contextmanager
def shuffled_joins(spark):
    """No join may be a broadcast, whatever its size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n in names:
            spark.conf.unset(n)


def test_join_plans_agree(spark, tables001):
    fns = (R.feedback_means_by_intervention, R.feedback_means_by_skill, R.feedback_means_onepass)
    want = [as_set(fn(tables001)) for fn in fns]
    with shuffled_joins(spark):
        assert [as_set(fn(tables001)) for fn in fns] == want


def test_retained_plus_erased_is_original(spark, tables001):
    e = erasure.materialize_erase_set(ids_frame(spark, ["3", "7", "11", "nope"]),
                                      tables001.participants)
    for name, df in tables001.items():
        kept = erasure.retained(df, e).count()
        gone = erasure.rows_of(df, e).count()
        assert kept + gone == df.count(), name
    # erasing from the retained tables again removes nothing
    once = erasure.retained_tables(tables001, e)
    e2 = erasure.materialize_erase_set(ids_frame(spark, ["3", "7", "11"]), once.participants)
    assert e2.n == 0


def test_shuffled_erase_equals_broadcast(spark, tables001):
    ids = ids_frame(spark, ["3", "7"])
    small = erasure.materialize_erase_set(ids, tables001.participants)
    want = as_set(erasure.retained(tables001.events, small))
    with shuffled_joins(spark):
        assert as_set(erasure.retained(tables001.events, small)) == want
    pushed = erasure.erase_set_of(spark, ["3", "7", "nobody"], tables001.participants)
    assert pushed.values == ["3", "7"] and pushed.n == 2
    assert as_set(erasure.retained(tables001.events, pushed)) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-2**62, max_value=2**62), min_size=1, max_size=60),
       st.sampled_from([(8, 2), (8, 20), (200, 5), (4096, 1 << 17)]))
def test_exact_median_matches_statistics(spark, values, how):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    _, twice = exact_median(df, "v", k=how[0], most=how[1])
    s = sorted(values)
    n = len(s)
    assert twice == s[(n - 1) // 2] + s[n // 2]
    # against the standard library, in exact arithmetic where it is exact
    if n % 2:
        assert twice == 2 * statistics.median(values)  # an int for odd n
    elif max(abs(v) for v in values) < 2**52:
        assert twice / 2 == statistics.median(values)


def test_long_report_onepass_equals_separate(tables001):
    separate = R.report_long(R.section_report(tables001, "all"))
    onepass = R.report_long_onepass(tables001)
    assert as_set(onepass) == as_set(separate)
    assert onepass.count() == 284


def test_section_report_choices(tables001):
    from cohortlens.schema import StudyError
    assert list(R.section_report(tables001, "events")) == ["events_by_type",
                                                          "events_top_participants"]
    try:
        R.section_report(tables001, "users")
    except StudyError:
        pass
    else:  # pragma: no cover
        raise AssertionError("unknown section accepted")


def test_hot_participant_all_strategies_agree(spark, tables001):
    """One participant owns about a third of all feedback rows; another third
    of events has a NULL id. Every join plan must give the same answers."""
    from pyspark.sql import functions as F
    fb = tables001.feedback
    hot = fb.limit(30000).withColumn("participant_id", F.lit("3"))
    ev = tables001.events
    null_ev = ev.limit(5000).withColumn("participant_id", F.lit(None).cast("string"))
    skewed = tables001.with_table("feedback", fb.unionByName(hot)) \
        .with_table("events", ev.unionByName(null_ev))
    want = as_set(R.feedback_means_by_intervention(skewed)), as_set(R.feedback_means_onepass(skewed))
    ids = ids_frame(spark, ["3"])
    small = erasure.materialize_erase_set(ids, skewed.participants)
    pushed = erasure.erase_set_of(spark, ["3"], skewed.participants)
    kept = {name: erasure.retained(skewed.get(name), small) for name in ("feedback", "events")}
    counts = {name: df.count() for name, df in kept.items()}
    with shuffled_joins(spark):
        assert (as_set(R.feedback_means_by_intervention(skewed)), as_set(R.feedback_means_onepass(skewed))) == want
        for name, df in kept.items():
            again = erasure.retained(skewed.get(name), small)
            assert again.count() == counts[name] and again.exceptAll(df).count() == 0
            assert erasure.retained(skewed.get(name), pushed).exceptAll(df).count() == 0


def test_onepass_takes_arm_from_participants_even_if_feedback_has_one(tables001):
    from pyspark.sql import functions as F
    fb = tables001.feedback.withColumn("intervention_type", F.lit("bogus"))
    t = tables001.with_table("feedback", fb)
    one = R.feedback_means_onepass(t).where("grouping_set = 'intervention_type'")
    assert as_set(one.select("intervention_type", "n", *R.RATINGS)) == \
        as_set(R.feedback_means_by_intervention(tables001))
