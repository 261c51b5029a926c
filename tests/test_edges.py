"""Small hand-made tables: truth tables, text timestamps, medians, CSV, guards."""

import os
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.exprs import passed_expr, round_half_up
from cohortlens.operators.durations import (cast_report, duration_median, duration_stats,
                                            exact_median)
from cohortlens.operators.erasure import (batch_confirmation, clear_table, erase_participant,
                                          erase_participants)
from cohortlens.operators.rates import rate
from cohortlens.schema import StudyError, validate
from cohortlens.sources.idlist import scan_id_list
from cohortlens.sources.sinks import CSV_OPTIONS, csv_text, export_all_csv, export_table_csv
from cohortlens.sources.snapshots import SnapshotStore, create_store
from cohortlens.sources.tables import StudyTables, scan_table

S3_ROWS = [
    (1, 4, 4, "failed", True),
    (2, 4, 3, "pass", False),
    (3, 0, 0, "OK", True),
    (4, None, 2, "Success", True),
    (5, 3, None, "error", False),
    (6, None, None, None, None),
    (7, 0, 0, None, None),
    (8, 2, 2, None, True),
]


def test_pass_truth_table(spark):
    df = spark.createDataFrame(
        S3_ROWS, "id int, tests_total int, tests_passed int, status string, expected boolean")
    got = df.select("id", passed_expr().alias("passed"), "expected").collect()
    for r in got:
        assert r["passed"] == r["expected"], r
    assert [tuple(r) for r in rate(df, passed_expr(), total="t", hits="h", percent="p")
            .collect()] == [(8, 4, 50.0)]
    empty = df.where(F.lit(False))
    assert [tuple(r) for r in rate(empty, passed_expr()).collect()] == [(0, 0, None)]


def test_round_half_up(spark):
    df = spark.createDataFrame([(1.005,), (8.325,), (-2.675,)], "x double")
    assert [r[0] for r in df.select(round_half_up("x", 2)).collect()] == [1.01, 8.33, -2.68]


TS = [
    ("2024-01-01T00:00:00Z", "2024-01-01T00:00:10Z", 10_000_000),
    ("2024-01-01 00:00:00+00", "2024-01-01 00:00:10+0000", 10_000_000),
    (" 2024-01-01 00:00:00 UTC ", "2024-01-01T00:00:00+02:00", -7_200_000_000),
    ("2024-01-01T00:00:00.123456+00:00", "2024-01-01T00:00:01Z", 876_544),
    ("2024-01-01", "2024-01-01T00:00", 0),
    ("2024-01-01T00:00:00Z", "not-a-time", None),
    ("2024-01-01T00:00:00Z", "12:30", None),
    ("2024-01-01T00:00:00Z", "20240101T101010Z", 36_610_000_000),  # basic ISO form
    ("2024-01-01T00:00:00Z", "Jan 3 2024 10:00", None),
    ("2024-01-01T00:00:00Z", "T", None),
]


def _participants(spark, pairs):
    rows = [(str(i), None, None, None, s, e) for i, (s, e) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "participant_id string, skill_level string, intervention_type string, "
              "snippet_id string, started_at string, ended_at string")


def test_timestamp_text_forms(spark):
    from cohortlens.operators.durations import US, duration_frame
    df = _participants(spark, [(s, e) for s, e, _ in TS] + [("unknown", "17"), (None, "x")])
    got = [r[US] for r in duration_frame(df).collect()]
    assert got == [us for _, _, us in TS]  # 'unknown'/'17' and NULL are not candidates
    assert [tuple(r) for r in cast_report(df).collect()] == [(10, 6, 4)]
    (n, avg), = duration_stats(df).collect()
    assert n == 6


def test_median_cases(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 4, 9]], "v long")
    first, twice = exact_median(df, "v", figures=[F.sum("v").alias("total")])
    assert twice == 6 and first["total"] == 16  # median 3.0
    empty = df.where(F.lit(False))
    first, twice = exact_median(empty, "v")
    assert twice is None and first["n"] == 0
    # -2.7 s median truncates toward zero
    neg = _participants(spark, [("2024-01-01T00:00:02.700Z", "2024-01-01T00:00:00Z")])
    assert duration_median(neg).first()["median_secs"] == -2
    assert duration_median(neg.where(F.lit(False))).first()["median_secs"] is None


def test_median_many_passes(spark):
    import random
    rng = random.Random(7)
    values = [rng.randint(-10**15, 10**15) for _ in range(2001)] + [5] * 1000
    df = spark.createDataFrame([(v,) for v in values], "v long")
    _, twice = exact_median(df, "v", k=8, most=4)  # a coarse sketch: brackets are narrowed and widened
    assert twice == 2 * statistics.median(values)
    even = values[:2000]
    _, twice = exact_median(spark.createDataFrame([(v,) for v in even], "v long"), "v", k=200, most=16)
    assert twice == int(2 * statistics.median(even))
    tied = [rng.choice([1, 1, 1, 2, 2, 2, 7, 10**12]) for _ in range(5000)] + [-3] * 1500
    _, twice = exact_median(spark.createDataFrame([(v,) for v in tied], "v long"), "v", k=200, most=8)
    assert twice == int(2 * statistics.median(tied))


def test_median_takes_two_scans_and_writes_nothing(spark, tables001):
    from cohortlens.session import work_dir
    root = work_dir(spark)
    root = root[len("file:"):] if root.startswith("file:") else root
    before = set(os.listdir(root))
    group = "median-scans"
    spark.sparkContext.setJobGroup(group, group)
    try:
        duration_median(tables001.participants).collect()
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(os.listdir(root)) == before
    assert len(stages) <= 10  # two scans with an aggregate each, and the one-row result


def test_csv_quoting_and_nulls(spark, scratch):
    df = spark.createDataFrame([("a,b", None, 'q"z', True, "")],
                               "c1 string, c2 string, c3 string, c4 boolean, c5 string")
    out = os.path.join(scratch, "q")
    csv_text(df).coalesce(1).write.options(**CSV_OPTIONS).csv(out)
    part = [f for f in os.listdir(out) if f.startswith("part-")][0]
    text = open(os.path.join(out, part)).read()
    assert text == 'c1,c2,c3,c4,c5\n"a,b",,"q""z",True,\n'


def test_csv_timestamps(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS a, "
                   "TIMESTAMP'2024-01-01 00:00:00.25' AS b, "
                   "TIMESTAMP_NTZ'2024-01-01 10:00:00.000001' AS c")
    assert tuple(csv_text(df).first()) == (
        "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.250000+00:00",
        "2024-01-01T10:00:00.000001")


def test_empty_export_writes_nothing(spark, scratch):
    df = spark.createDataFrame([], "participant_id string, event_type string")
    status, n, path = export_table_csv(df, "events", scratch)
    assert (status, n) == ("empty", 0) and not os.path.exists(path)


def test_id_file_parsing(spark, scratch):
    path = os.path.join(scratch, "ids.txt")
    os.makedirs(scratch, exist_ok=True)
    with open(path, "w", newline="") as fh:
        fh.write(" 3 \n\n7\r\n7\n99999\n\t\n")
    got = [tuple(r) for r in scan_id_list(spark, path).orderBy("line_no").collect()]
    assert got == [(1, "3"), (3, "7"), (4, "7"), (5, "99999")]


def test_id_file_guards(spark, scratch):
    with pytest.raises(StudyError):
        scan_id_list(spark, os.path.join(scratch, "missing.txt"))
    os.makedirs(scratch, exist_ok=True)
    blank = os.path.join(scratch, "blank.txt")
    with open(blank, "w") as fh:
        fh.write("\n  \n")
    with pytest.raises(StudyError):
        scan_id_list(spark, blank)


def test_table_guards(spark, tables001):
    with pytest.raises(StudyError):
        scan_table(spark, "users", "/nonexistent")
    with pytest.raises(StudyError):
        validate(tables001.events.drop("event_type"), "events")
    validate(tables001.feedback, "feedback")


def _small_tables(spark):
    p = spark.createDataFrame([("a", "x", "arm_a", "s1", None, None), ("b", None, None, None,
                                                                        None, None)],
                              "participant_id string, skill_level string, intervention_type "
                              "string, snippet_id string, started_at string, ended_at string")
    s = spark.createDataFrame([("a", "ok", 1, 1, 10), ("z", "ok", 1, 1, 5)],
                              "participant_id string, status string, tests_total int, "
                              "tests_passed int, time_taken_ms bigint")
    f = spark.createDataFrame([("a", "s1", *[1] * 8), (None, None, *[2] * 8)],
                              "participant_id string, snippet_id string, " + ", ".join(
                                  f"{c} int" for c in ["length", "jargon", "sentence_structure",
                                                       "vocabulary", "intrinsic_load",
                                                       "extraneous_load", "germane_load",
                                                       "authoritativeness"]))
    e = spark.createDataFrame([("a", "click"), ("a", "view"), (None, "view"), ("b", None)],
                              "participant_id string, event_type string")
    return StudyTables(participants=p, code_submissions=s, feedback=f, events=e)


def test_erase_guards_and_snapshots(spark, scratch):
    store = create_store(spark, scratch, _small_tables(spark))
    assert store.latest_version() == 1
    with pytest.raises(StudyError):
        erase_participant(store, "  ", "YES")
    # unknown id: success, nothing written
    out = erase_participant(store, "nobody", "YES")
    assert out.status == "nothing_to_do" and store.latest_version() == 1
    # wrong confirmation: cancelled, nothing written
    out = erase_participant(store, "a", "yes")
    assert out.status == "cancelled" and store.latest_version() == 1
    out = erase_participant(store, "a", "YES")
    assert out.status == "erased" and out.version == 2
    t = store.tables()
    assert t.participants.count() == 1
    assert [tuple(r) for r in t.events.orderBy("event_type").collect()] == [("b", None),
                                                                           (None, "view")]
    assert [tuple(r) for r in out.frames["result"].collect()] == [(1, 0, 5)]
    # old version still readable
    assert store.tables(1).events.count() == 4
    # erasing again changes nothing
    assert erase_participant(store, "a", "YES").status == "nothing_to_do"


def test_batch_confirmation(spark, scratch):
    store = create_store(spark, scratch, _small_tables(spark))
    ids = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "q")],
                                "line_no bigint, participant_id string")
    out = erase_participants(store, ids, "DELETE ALL 3 PARTICIPANTS")
    assert out.status == "cancelled" and out.expected_confirmation == batch_confirmation(2)
    out = erase_participants(store, ids, batch_confirmation(2))
    assert out.status == "erased"
    assert store.tables().participants.count() == 0
    assert store.tables().events.count() == 1  # the NULL-id event stays


def test_clear_table(spark, scratch):
    store = create_store(spark, scratch, _small_tables(spark))
    with pytest.raises(StudyError):
        clear_table(store, "users", "YES")
    assert clear_table(store, "events", "no").status == "cancelled"
    out = clear_table(store, "events", "YES")
    assert out.status == "cleared"
    ev = store.tables().events
    assert ev.count() == 0 and ev.columns == ["participant_id", "event_type"]
    assert [tuple(r) for r in out.frames["status"].collect()] == [("events", 4)]
    assert clear_table(store, "events", "YES").status == "nothing_to_do"


def test_export_all_manifest(spark, scratch):
    man = export_all_csv(spark, _small_tables(spark), scratch)
    got = {r["table_name"]: (r["status"], r["n_rows"]) for r in man.collect()}
    assert got == {"participants": ("exported", 2), "code_submissions": ("exported", 2),
                   "feedback": ("exported", 2), "events": ("exported", 4)}


def test_store_versions_never_overwrite(spark, scratch):
    store = create_store(spark, scratch, _small_tables(spark))
    with pytest.raises(StudyError):
        create_store(spark, scratch, _small_tables(spark))
    assert SnapshotStore(spark, scratch).manifest()["events"].n_rows == 4


def test_duplicate_participants_refused(spark, tables001):
    from cohortlens.sources.tables import check_unique_ids
    check_unique_ids(tables001.participants)
    dup = tables001.participants.unionByName(tables001.participants.where("participant_id = '3'"))
    with pytest.raises(StudyError, match="'3' x2"):
        check_unique_ids(dup)
    with pytest.raises(StudyError):
        tables001.with_table("participants", dup).validated(check_keys=True)


def test_load_study_from_store_layout(spark, scratch, tables001):
    from cohortlens.sources.tables import load_study
    for name, df in tables001.items():
        df.write.parquet(os.path.join(scratch, name))
    t = load_study(spark, scratch, check_keys=True)
    assert t.events.count() == tables001.events.count()


def test_csv_round_trip(spark, scratch, tables001):
    from cohortlens.sources.sinks import read_back_csv
    src = tables001.participants
    _, n, path = export_table_csv(src, "participants", scratch)
    back = read_back_csv(spark, path, src.columns)
    assert n == src.count()
    # text columns survive unchanged (NULL stays NULL; no '' in this table)
    assert back.exceptAll(src).count() == 0 and src.exceptAll(back).count() == 0


def test_id_list_without_line_numbers(spark, scratch):
    os.makedirs(scratch, exist_ok=True)
    path = os.path.join(scratch, "ids.txt")
    with open(path, "w", newline="") as fh:
        fh.write(" 3 \n\n7\r\n7\n")
    got = sorted(r[0] for r in scan_id_list(spark, path, line_numbers=False).collect())
    assert got == ["3", "7", "7"]


def test_approx_median_option(spark, tables001):
    from cohortlens.plans import reports as R
    exact = R.participants_duration_median(tables001).first()["median_secs"]
    approx = duration_median(tables001.participants, method="approx").first()["median_secs"]
    assert abs(approx - exact) <= 60
    with pytest.raises(ValueError):
        duration_median(tables001.participants, method="mean")


def test_inspect_actions(spark, scratch):
    from cohortlens.plans.actions import inspect
    store = create_store(spark, scratch, _small_tables(spark))
    rep = inspect(store, section="events")
    assert rep.action == "reports"
    assert [tuple(r) for r in rep.frames["events_by_type"].collect()] == [
        ("view", 2), ("click", 1), (None, 1)]
    # precedence: removal wins over export and reports; wrong confirmation writes nothing
    out = inspect(store, remove_participant="a", export_all=True, confirm="no")
    assert out.action == "remove_participant" and not out.ok and store.latest_version() == 1
    out = inspect(store, clear_table="events", confirm="YES")
    assert out.action == "clear_table" and out.ok and store.tables().events.count() == 0
    ex = inspect(store, export_table="participants", output_dir=os.path.join(scratch, "x"))
    assert ex.detail["status"] == "exported" and ex.detail["n_rows"] == 2
    path = os.path.join(scratch, "ids.txt")
    with open(path, "w") as fh:
        fh.write("a\nq\n")
    out = inspect(store, remove_participants_file=path,
                  confirm=lambda pending: batch_confirmation(pending.n_participants))
    assert out.ok and out.outcome.status == "erased"
    assert [tuple(r) for r in out.frames["status"].orderBy("line_no").collect()] == [
        (1, "a", True), (2, "q", False)]


def test_line_numbers_across_many_splits(spark, scratch):
    """Force the id file into many input splits; line numbers must still be
    the physical ones (per file), as Python's own enumeration gives them."""
    import random
    from cohortlens.sources.idlist import numbered_lines
    rng = random.Random(3)
    os.makedirs(scratch, exist_ok=True)
    expected = {}
    for f in range(2):
        lines = [rng.choice(["", "  ", f"id{rng.randint(0, 50)}", f" x{i} "]) for i in range(700)]
        path = os.path.join(scratch, f"ids{f}.txt")
        with open(path, "w", newline="") as fh:
            fh.write("\r\n".join(lines) + "\n")
        expected[f"ids{f}.txt"] = [(i + 1, v) for i, v in enumerate(lines)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = numbered_lines(spark, scratch)
        assert df.rdd.getNumPartitions() > 10
        got = {}
        for r in df.collect():
            got.setdefault(os.path.basename(r["file"]), []).append((r["line_no"], r["value"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_store_tables_keep_a_broadcast_join(spark, scratch, tables001):
    from cohortlens.plans import reports as R
    store = create_store(spark, scratch, tables001)
    t = store.tables()
    entries = store.manifest()
    assert entries["participants"].n_rows == 1500 and entries["feedback"].n_rows == 60000
    # a small label table is broadcast by Spark's own threshold
    df = R.feedback_means_by_intervention(t)
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert df.collect() == R.feedback_means_by_intervention(tables001).collect()


def test_export_summary(spark, scratch):
    from cohortlens.sources.sinks import export_summary
    small = _small_tables(spark)
    empty_events = small.with_table("events", small.events.where(F.lit(False)))
    man = export_all_csv(spark, empty_events, scratch)
    got = {r["table_name"]: r["status"] for r in man.collect()}
    assert got["events"] == "empty" and got["participants"] == "exported"
    row = export_summary(man).first()
    assert (row["tables_succeeded"], row["tables_total"], row["total_rows"]) == (4, 4, 6)
    assert row["output_dir"] == scratch


def test_strict_median_when_all_parse(spark):
    ok = _participants(spark, [("2024-01-01T00:00:00Z", f"2024-01-01T00:00:{s:02d}Z")
                               for s in (10, 20, 40)])
    assert duration_median(ok, mode="strict").first()["median_secs"] == 20
    assert duration_median(ok, mode="strict", method="approx").first()["median_secs"] == 20
    bad = ok.unionByName(_participants(spark, [("2024-01-01T00:00:00Z", "not-a-time")]))
    assert duration_median(bad, mode="strict").first()["median_secs"] is None
    assert duration_median(bad, mode="strict", method="approx").first()["median_secs"] is None
    assert duration_median(bad).first()["median_secs"] == 20


def test_exact_means_of_large_values_and_halves(spark):
    from fractions import Fraction
    from math import floor

    from cohortlens.operators.means import means
    cases = [[10**11, 10**11 + 1], [2, 2, 2, 3], [-1, -2], [2**62, 2**62 - 1, 2**62], [1] * 199 + [2], [None, None]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values], "v bigint")
        got = means(df, ["v"], digits=2).first()[0]
        known = [v for v in values if v is not None]
        if not known:
            assert got is None
            continue
        m = Fraction(sum(known), len(known))
        units = floor(abs(m) * 100 + Fraction(1, 2)) * (1 if m >= 0 else -1)
        assert got == float(units) / 100
    ints = spark.createDataFrame([(1.005,), (1.005,)], "v double")
    assert means(ints, ["v"]).first()[0] == 1.01
    dec = spark.sql("SELECT CAST(x AS DECIMAL(6,3)) AS v FROM VALUES (1.005), (1.005) AS t(x)")
    assert means(dec, ["v"]).first()[0] == 1.01


def test_timestamp_forms(spark):
    from cohortlens.functions.exprs import parse_ts
    good = {"20240103T101010Z": "2024-01-03 10:10:10", "20240103T101010+0200": "2024-01-03 08:10:10",
            "2024-01-03T10:10:10.5+02": "2024-01-03 08:10:10.5", "2024-01-03 10:10": "2024-01-03 10:10:00",
            "2024-01-03": "2024-01-03 00:00:00"}
    bad = ["2024-01", "2024-01-03 10", "12:30", "not-a-time", "20241340T101010Z", "2024-13-01T00:00:00Z", ""]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    got = {r["x"]: r["t"] for r in rows.select("x", parse_ts("x").cast("string").alias("t")).collect()}
    assert {k: got[k] for k in good} == good
    assert all(got[k] is None for k in bad)


def test_unicode_blanks_are_stripped(spark):
    from cohortlens.functions.exprs import strip_ws
    texts = [b + "id 7" + b for b in (" ", "\t", "\u00a0", "\u3000", "\x1f", "\u2009", "\u0085", "\u200b")]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert {(r[0], r[1]) for r in rows.select("x", strip_ws("x")).collect()} == {(x, x.strip()) for x in texts}


def test_export_replaces_and_reports_failures(spark, scratch):
    from cohortlens.plans.actions import inspect
    from cohortlens.sources.tables import StudyTables
    store = create_store(spark, os.path.join(scratch, "store"), _small_tables(spark))
    out = os.path.join(scratch, "out")
    for _ in range(2):  # the second replaces the first
        assert inspect(store, export_table="participants", output_dir=out).ok
    done = inspect(store, export_all=True, output_dir=out)
    assert done.ok and done.detail["tables_succeeded"] == 4
    small = _small_tables(spark)
    broken = StudyTables(**{t: df for t, df in small.items() if t != "feedback"},
                         feedback=small.feedback.withColumn("length", F.raise_error(F.lit("broken row")).cast("int")))
    statuses = {r["table_name"]: r["status"] for r in export_all_csv(spark, broken, out).collect()}
    assert statuses["feedback"].startswith("failed: ") and statuses["events"] == "exported"


def test_failed_publish_can_be_retried(spark, scratch):
    store = create_store(spark, scratch, _small_tables(spark))
    bad = store.tables().events.withColumn("event_type", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):  # noqa: B017
        store.publish({"events": bad, "participants": store.tables().participants.limit(1)})
    assert store.latest_version() == 1
    assert store.publish({"events": store.tables().events.limit(1)}) == 2
    from cohortlens.sources.snapshots import SnapshotStore
    other = SnapshotStore(spark, scratch)
    assert other.publish({"events": other.tables().events.limit(0)}) == 3
    assert store.tables().events.count() == 0  # another writer's version is seen


def test_erase_keeps_untouched_tables_and_removal_is_final(spark, scratch):
    tables = _small_tables(spark)
    store = create_store(spark, scratch, tables.with_table("code_submissions", tables.code_submissions.where(
        "participant_id <> 'a' OR participant_id IS NULL")))
    before = store.manifest()
    home = next(p for p, f in before["participants"].folders.items()
                if spark.read.parquet(f.path).where("participant_id = 'a'").count())
    out = erase_participant(store, "a", "YES")
    after = store.manifest()
    assert out.status == "erased"
    assert after["code_submissions"] == before["code_submissions"]
    # only the folder of the erased id is written anew (here nothing is left in it)
    assert home in before["events"].folders and home not in after["events"].folders
    assert after["events"].folders == {p: f for p, f in before["events"].folders.items() if p != home}
    with pytest.raises(StudyError):
        store.remove_superseded("no")
    gone = store.remove_superseded("YES")
    assert before["events"].folders[home].path in gone
    assert not {f.path for e in after.values() for f in e.folders.values()} & set(gone)
    assert store.tables().events.count() == 2
    left = [os.path.join(d, f) for d, _, fs in os.walk(scratch) for f in fs if f.endswith(".parquet")]
    for path in left:
        rows = spark.read.parquet(path)
        if "participant_id" in rows.columns:
            assert rows.where("participant_id = 'a'").count() == 0, path


def test_erase_rewrites_only_folders_with_an_erased_id(spark, scratch, tables001):
    store = create_store(spark, scratch, tables001, parts=8)
    before = store.manifest()
    assert all(len(before[t].folders) >= 8 for t in ("participants", "events", "feedback"))
    assert erase_participant(store, "3", "YES").status == "erased"
    after = SnapshotStore(spark, scratch, parts=99).manifest()  # the stored number of folders counts
    for t, old in before.items():
        moved = {p for p, f in old.folders.items() if after[t].folders.get(p) != f}
        assert len(moved) <= 1, t
        assert after[t].n_rows == tables001.get(t).where("participant_id <> '3' OR participant_id IS NULL").count()
        assert store.tables().get(t).schema.fieldNames() == tables001.get(t).schema.fieldNames()
    assert after["participants"].n_rows == before["participants"].n_rows - 1
    rest = store.tables().events
    assert rest.exceptAll(tables001.events).count() == 0 and rest.where("participant_id = '3'").count() == 0


def test_a_hot_participant_is_written_by_several_tasks(spark, scratch):
    small = _small_tables(spark)
    hot = spark.range(60_000).selectExpr("'a' AS participant_id", "sha2(cast(id AS string), 512) AS event_type")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        store = create_store(spark, scratch, small.with_table("events", hot.repartition(6)))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (folder,) = store.manifest()["events"].folders.values()
    assert folder.n_rows == 60_000
    assert len([f for f in os.listdir(folder.path) if f.endswith(".parquet")]) > 1


def test_refused_batch_leaves_no_erase_set(spark, scratch):
    from cohortlens.session import work_dir
    store = create_store(spark, scratch, _small_tables(spark))
    base = work_dir(spark).removeprefix("file:")
    sets = lambda: {d for d in os.listdir(base) if d.startswith("erase-set")}
    before = sets()
    ids = spark.createDataFrame([(1, "a")], "line_no bigint, participant_id string")
    assert erase_participants(store, ids, "no").status == "cancelled"
    assert sets() == before


def test_jdbc_options_per_table():
    from cohortlens.sources.tables import table_options
    bounds = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    got = table_options("feedback", "jdbc", {"url": "jdbc:postgresql://h/db"}, {"feedback": bounds})
    assert got == {"url": "jdbc:postgresql://h/db", "dbtable": "feedback", **bounds}
    assert table_options("events", "parquet", {"mergeSchema": "true"}) == {"mergeSchema": "true"}


def test_strict_statistics_over_clean_times(spark):
    from cohortlens.plans import registry
    q = registry.queries()
    row = q["participants_duration_avg_strict_clean"](spark, "/root/testdata/sf0.001").first()
    assert row["n_durations"] > 0 and row["avg_secs"] is not None
    assert q["participants_duration_median_strict_clean"](spark, "/root/testdata/sf0.001").first()[0] is not None
