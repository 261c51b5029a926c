"""Expected values at sf0.01 (FIXTURES.md §3), in order where order matters."""

import pytest

from cohortlens.operators import erasure
from cohortlens.plans import reports as R
from cohortlens.plans.registry import ID_FILE_TEXT, write_id_file
from cohortlens.sources.idlist import ids_frame, scan_id_list


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_totals(tables001):
    assert rows(R.participants_total(tables001)) == [(1500,)]
    assert rows(R.submissions_total(tables001)) == [(15000,)]


def test_label_counts_in_order(tables001):
    assert rows(R.participants_by_skill_level(tables001)) == [
        ("machinery", 308), ("furniture", 303), ("building", 302), ("automobile", 298),
        ("(null)", 289)]
    assert rows(R.participants_by_intervention_type(tables001)) == [
        ("(null)", 375), ("arm_a", 375), ("arm_b", 375), ("arm_c", 375)]
    assert rows(R.participants_by_snippet_id(tables001)) == [
        ("(null)", 302), ("snip_2", 262), ("snip_1", 239), ("snip_3", 239), ("snip_4", 231),
        ("snip_0", 227)]
    assert rows(R.submissions_by_status(tables001)) == [
        ("ok", 4630), ("PASSED", 4535), ("Failed", 4471), ("(null)", 1364)]


def test_cross_tabs(tables001):
    p5 = rows(R.participants_skill_x_intervention(tables001))
    assert len(p5) == 20 and p5[0] == ("(null)", "(null)", 74)
    assert p5[-1] == ("machinery", "arm_c", 73)
    p6 = rows(R.participants_skill_x_snippet(tables001))
    assert len(p6) == 30 and p6[0] == ("(null)", "(null)", 69)
    assert p6[-1] == ("machinery", "snip_4", 48)


def test_durations(tables001):
    assert rows(R.participants_finished(tables001)) == [(1312,)]
    (n, avg), = rows(R.participants_duration_avg(tables001))
    assert n == 1180 and avg == pytest.approx(1810.4875)
    assert rows(R.participants_duration_median(tables001)) == [(1800,)]
    assert rows(R.duration_cast_policy(tables001)) == [(1255, 1180, 75)]


def test_strict_mode_skips_stats(tables001):
    assert rows(R.participants_duration_avg(tables001, mode="strict")) == [(None, None)]
    assert rows(R.participants_duration_median(tables001, mode="strict")) == [(None,)]


def test_submission_stats(tables001):
    assert rows(R.submissions_pass_rate(tables001)) == [(15000, 7818, 52.12)]
    assert rows(R.submissions_time_stats(tables001)) == [(13500, 250707.0, 1013, 499978)]


def test_feedback_means(tables001):
    assert rows(R.feedback_means_overall(tables001)) == [
        (3.22, 2.99, 3.0, 2.85, 5.0, 5.02, 5.0, 2.99)]
    f2 = rows(R.feedback_means_by_intervention(tables001))
    assert [r[:2] for r in f2] == [("(null)", 26439), ("arm_b", 11245), ("arm_a", 11198),
                                   ("arm_c", 11118)]
    assert f2[1][2:] == (3.23, 3.01, 2.98, 2.86, 5.0, 5.01, 5.0, 2.97)
    f3 = rows(R.feedback_means_by_skill(tables001))
    assert [r[:2] for r in f3] == [("(null)", 23742), ("building", 9183), ("machinery", 9109),
                                   ("furniture", 9047), ("automobile", 8919)]
    assert f3[1][2:] == (3.21, 2.87, 2.98, 2.83, 5.02, 5.06, 5.01, 2.98)
    f4 = rows(R.feedback_means_by_snippet(tables001))
    assert [r[:2] for r in f4] == [("snip_1", 10885), ("snip_2", 10836), ("snip_3", 10654),
                                   ("snip_4", 10257), ("snip_0", 10172), ("(null)", 7196)]
    assert f4[0][2:] == (3.2, 3.0, 2.0, 2.85, 5.03, 4.98, 5.05, 2.98)


def test_events(tables001):
    assert rows(R.events_by_type(tables001)) == [
        ("error", 1951), ("click", 1947), ("signup", 1941), ("view", 1922), ("purchase", 1916),
        (None, 323)]
    e2 = rows(R.events_top_participants(tables001))
    assert len(e2) == 50
    assert e2[:3] == [(None, 104), ("149", 86), ("41", 85)]
    assert e2[-2:] == [("54", 70), ("67", 70)]


def test_onepass_row_count(tables001):
    assert R.participants_counts_onepass(tables001).count() == 66


def _erase(spark, tables, ids):
    return erasure.materialize_erase_set(ids, tables.participants)


def test_erase_plans(spark, tables001):
    for pid, expected in [("3", {"participants": 1, "code_submissions": 12, "feedback": 33,
                                 "events": 59}),
                          ("7", {"participants": 1, "code_submissions": 10, "feedback": 28,
                                 "events": 80})]:
        e = _erase(spark, tables001, ids_frame(spark, [pid]))
        plan = {r["table_name"]: r["n_rows"] for r in erasure.plan_counts(tables001, e).collect()}
        assert plan == expected


def test_erase_batch(spark, tables001):
    ids = scan_id_list(spark, write_id_file(spark, ID_FILE_TEXT))
    assert rows(erasure.batch_status(ids, tables001.participants).orderBy("line_no")) == [
        (1, "3", True), (3, "7", True), (4, "7", True), (5, "99999", False), (6, "1999", False)]
    e = _erase(spark, tables001, ids)
    assert e.n == 2
    assert rows(erasure.batch_summary(tables001, e)) == [(2, 2, 22, 61, 139, 224)]
    kept = {t: erasure.retained(df, e).count() for t, df in tables001.items()}
    assert kept == {"participants": 1498, "code_submissions": 14978, "feedback": 59939,
                    "events": 9861}
    # all NULL-id events and the 27 rows of the orphan id 1999 stay
    ev = erasure.retained(tables001.events, e)
    assert ev.where("participant_id IS NULL").count() == 104
    fb = erasure.retained(tables001.feedback, e)
    assert fb.where("participant_id = '1999'").count() == 27
