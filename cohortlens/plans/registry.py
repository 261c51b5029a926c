"""Registered queries over the fixture study tables, and their oracles.

Reports are pure functions of the study tables. Data-management queries
(erasure, clearing, export) write into a fresh folder under the shared
checkpoint directory and return frames that Spark derives from the tables
or from what was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import erasure
from cohortlens.plans import oracle, reports
from cohortlens.schema import STUDY_TABLES, StudyError
from cohortlens.session import apply_defaults, new_work_path
from cohortlens.sources.fixtures import fixture_tables
from cohortlens.sources.idlist import scan_id_list
from cohortlens.sources.sinks import export_all_csv, export_summary, export_table_csv, read_back_csv
from cohortlens.sources.snapshots import SnapshotStore, create_store
from cohortlens.sources.tables import load_study

Query = Callable[[SparkSession, str], DataFrame]

# Fixed test inputs of the erasure queries: one id for the single erase, and
# the text of an id file (surrounding blanks, a blank line, a CRLF line end,
# a repeated id, an unknown id, and an id with feedback but no participant).
SINGLE_ERASE_ID = "3"
ID_FILE_TEXT = " 3 \n\n7\r\n7\n99999\n1999"
# (line number, id) as the id file reader must see them
ID_FILE_LINES = [(1, "3"), (3, "7"), (4, "7"), (5, "99999"), (6, "1999")]

# malformed times of the fixture and what stands for them in the clean view
CLEAN_TIMES = (("started_at", "unknown", "20240102T093000Z"), ("ended_at", "not-a-time", "20240131T124510.5+0200"))

REPORTS: dict[str, Callable] = {
    **{name: fn for section in reports.SECTIONS.values() for name, fn in section.items()},
    "participants_counts_onepass": reports.participants_counts_onepass,
    "feedback_means_onepass": reports.feedback_means_onepass,
    "participants_duration_avg_strict": reports.participants_duration_avg_strict,
    "participants_duration_median_strict": reports.participants_duration_median_strict,
}


def _report_query(fn: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return fn(fixture_tables(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


def _report_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return reports.report_long_onepass(fixture_tables(spark, sf_dir))


# -- erasure -----------------------------------------------------------------


def write_id_file(spark: SparkSession, text: str) -> str:
    """Write ``text`` as an id file in the shared folder; return its path."""
    path = new_work_path(spark, "ids")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _single_erase_set(spark: SparkSession, sf_dir: str):
    tables = fixture_tables(spark, sf_dir)
    return tables, erasure.erase_set_of(spark, [SINGLE_ERASE_ID], tables.participants)


_ID_FILES: dict[str, str] = {}


def fixture_id_file(spark: SparkSession) -> str:
    """The fixture id file, written once per application (an input file)."""
    key = spark.sparkContext.applicationId
    if key not in _ID_FILES:
        _ID_FILES[key] = write_id_file(spark, ID_FILE_TEXT)
    return _ID_FILES[key]


def _batch_inputs(spark: SparkSession, sf_dir: str, line_numbers: bool = False):
    tables = fixture_tables(spark, sf_dir)
    ids = scan_id_list(spark, fixture_id_file(spark), line_numbers=line_numbers)
    return tables, ids


def _erase_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    tables, erase = _single_erase_set(spark, sf_dir)
    return erasure.plan_counts(tables, erase)


def _erase_retained(table: str, batch: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        if batch:
            tables, ids = _batch_inputs(spark, sf_dir)
            erase = erasure.planned_erase_set(ids, tables.participants)
        else:
            tables, erase = _single_erase_set(spark, sf_dir)
        return erasure.retained(tables.get(table), erase)
    return run


def _batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    tables, ids = _batch_inputs(spark, sf_dir, line_numbers=True)
    return erasure.batch_status(ids, tables.participants)


def _batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    tables, ids = _batch_inputs(spark, sf_dir)
    return erasure.batch_summary(tables, erasure.planned_erase_set(ids, tables.participants))


# The fixture study tables published once per application; every erase or
# clear query works on its own branch of it (a manifest naming the same
# files), as on a study database that already exists.
_BASE_STORES: dict[tuple[str, str], SnapshotStore] = {}


def fixture_store(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BASE_STORES:
        _BASE_STORES[key] = create_store(spark, new_work_path(spark, "study"),
                                         fixture_tables(spark, sf_dir))
    # the same files under a manifest of their own: a fixture only
    fresh = SnapshotStore(spark, new_work_path(spark, "store"))
    fresh._write_manifest(1, _BASE_STORES[key].manifest(), None, "fixture")
    return fresh


def _batch_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batch erase on a fresh snapshot store; rows before minus after."""
    apply_defaults(spark)
    _, ids = _batch_inputs(spark, sf_dir)
    store = fixture_store(spark, sf_dir)
    # confirm as a user would: with the text the summary asks for
    outcome = erasure.erase_participants(
        store, ids, lambda pending: erasure.batch_confirmation(pending.n_participants))
    if outcome.status != "erased":
        raise StudyError(f"batch erase did not run: {outcome.status}")
    return outcome.frames["result"]


def _clear_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    store = fixture_store(spark, sf_dir)
    outcome = erasure.clear_table(store, "events", "YES")
    if outcome.status != "cleared":
        raise StudyError(f"clear did not run: {outcome.status}")
    after = store.tables().events
    # rows cleared (from the old version) and rows left (from the new one)
    return outcome.frames["status"].unionByName(
        after.agg(F.lit("events_after").alias("table_name"),
                  F.count(F.lit(1)).alias("n_rows_cleared")))


# -- export ------------------------------------------------------------------


def _export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export the four tables, then count what was written by reading it back."""
    apply_defaults(spark)
    out_dir = new_work_path(spark, "export")
    tables = fixture_tables(spark, sf_dir)
    manifest = export_all_csv(spark, tables, out_dir)
    written, empty = None, []
    for r in manifest.collect():  # four manifest rows
        if r["status"] != "exported":
            empty.append((r["table_name"], r["status"], 0))
            continue
        rows = read_back_csv(spark, r["path"], tables.get(r["table_name"]).columns).select(
            F.lit(r["table_name"]).alias("table_name"), F.lit(r["status"]).alias("status"))
        written = rows if written is None else written.union(rows)
    schema = "table_name string, status string, n_rows bigint"
    if written is None:
        return spark.createDataFrame(empty, schema)
    # one aggregate over the read-back rows of all exported tables
    out = written.groupBy("table_name", "status").agg(F.count(F.lit(1)).alias("n_rows"))
    return out.union(spark.createDataFrame(empty, schema)) if empty else out


def _export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export events (timestamps, NULLs) and read the text back."""
    apply_defaults(spark)
    out_dir = new_work_path(spark, "export")
    events = fixture_tables(spark, sf_dir).events
    _, _, path = export_table_csv(events, "events", out_dir)
    return read_back_csv(spark, path, events.columns)


def _export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals that the export's own writes counted."""
    apply_defaults(spark)
    manifest = export_all_csv(spark, fixture_tables(spark, sf_dir), new_work_path(spark, "export"))
    return export_summary(manifest).select("tables_succeeded", "tables_total", "total_rows")


def _export_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export values with outer blanks and line ends, and read them back."""
    apply_defaults(spark)
    events = fixture_tables(spark, sf_dir).events
    odd = events.select("event_id", F.concat(F.lit("  "), "participant_id", F.lit("\t")).alias("participant_id"),
                        F.concat("event_type", F.lit(" \n \"x\" ")).alias("event_type"))
    _, _, path = export_table_csv(odd, "events", new_work_path(spark, "export"))
    return read_back_csv(spark, path, odd.columns)


def _batch_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    tables, ids = _batch_inputs(spark, sf_dir)
    return erasure.batch_detail(tables, erasure.planned_erase_set(ids, tables.participants))


def _clean_participants(spark: SparkSession, sf_dir: str):
    """Every participant, with each malformed time replaced by a valid one (some in basic ISO form)."""
    tables = fixture_tables(spark, sf_dir)
    p = tables.participants
    for name, bad, good in CLEAN_TIMES:
        p = p.withColumn(name, F.when(F.col(name) == bad, good).otherwise(F.col(name)))
    return tables.with_table("participants", p)


def _clean_report(fn: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return fn(_clean_participants(spark, sf_dir))
    return run


def _large_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of values far above 1e10 (epoch milliseconds and more)."""
    apply_defaults(spark)
    tables = fixture_tables(spark, sf_dir)
    big = tables.code_submissions.withColumn("time_taken_ms", F.col("time_taken_ms") * 1000000 + 1700000000001)
    return reports.submissions_time_stats(tables.with_table("code_submissions", big))


_STUDIES: dict[tuple[str, str], str] = {}


def _loaded_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section's reports over a study loaded from its four stored tables."""
    apply_defaults(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:  # the stored study, written once per application (an input)
        root = new_work_path(spark, "study-tables")
        for name, df in fixture_tables(spark, sf_dir).items():
            df.write.parquet(f"{root}/{name}")
        _STUDIES[key] = root
    study = load_study(spark, _STUDIES[key])
    return reports.report_long(reports.section_report(study, "submissions"))


DATA_QUERIES: dict[str, Query] = {
    "export_manifest": _export_manifest,
    "export_table_csv_blanks": _export_blanks,
    "erase_batch_detail": _batch_detail,
    "participants_duration_avg_strict_clean": _clean_report(reports.participants_duration_avg_strict),
    "participants_duration_median_strict_clean": _clean_report(reports.participants_duration_median_strict),
    "submissions_time_stats_large": _large_times,
    "section_report_submissions": _loaded_section,
    "erase_plan": _erase_plan,
    **{f"erase_retained_{t}": _erase_retained(t, batch=False) for t in STUDY_TABLES},
    "erase_batch_status": _batch_status,
    "erase_batch_summary": _batch_summary,
    **{f"erase_batch_retained_{t}": _erase_retained(t, batch=True) for t in STUDY_TABLES},
    "erase_batch_result": _batch_result,
    "clear_table": _clear_events,
    "export_all_csv": _export_all,
    "export_table_csv": _export_events,
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _report_query(fn) for name, fn in REPORTS.items()}
    out["report_long"] = _report_long
    out.update(DATA_QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {**oracle.REPORT_SQL, **oracle.data_sql(SINGLE_ERASE_ID, ID_FILE_LINES), **oracle.extra_sql(CLEAN_TIMES, ID_FILE_LINES),
           "report_long": oracle.report_long_sql()}
    names = queries()
    return {k: v for k, v in out.items() if k in names}
