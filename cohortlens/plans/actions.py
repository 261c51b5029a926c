"""One entry point with the source system's choice of action.

``inspect(store, ...)`` does what the study's inspection command does for the
same options: erase one participant, erase the ids of a file, clear a table,
export one table, export all tables, or (when none of these is given) build
the reports of a section. Only the first applicable action runs, in that
order. Confirmations are arguments (text or a callable prompt) instead of
console input, and results are DataFrames and outcome objects instead of
printed tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cohortlens.operators import erasure
from cohortlens.plans.reports import report_long, report_long_onepass, section_report
from cohortlens.sources.idlist import scan_id_list
from cohortlens.sources.sinks import export_all_csv, export_summary, export_table_csv
from cohortlens.sources.snapshots import SnapshotStore


@dataclass
class ActionResult:
    action: str
    ok: bool
    frames: dict[str, DataFrame] = field(default_factory=dict)
    outcome: erasure.EraseOutcome | None = None
    detail: dict = field(default_factory=dict)


def inspect(store: SnapshotStore, *, section: str = "all", clear_table: str | None = None,
            export_table: str | None = None, export_all: bool = False,
            output_dir: str | None = None, remove_participant: str | None = None,
            remove_participants_file: str | None = None,
            confirm: erasure.Confirm = None) -> ActionResult:
    """Run the first requested action on the latest snapshot of ``store``."""
    spark = store.spark
    if remove_participant:
        out = erasure.erase_participant(store, remove_participant, confirm)
        return ActionResult("remove_participant", out.ok, out.frames, out)
    if remove_participants_file:
        # per-id status and rows against the version the erase starts from (its files stay)
        before = store.tables()
        status = erasure.batch_status(scan_id_list(spark, remove_participants_file), before.participants)
        ids = scan_id_list(spark, remove_participants_file, line_numbers=False)
        detail = erasure.batch_detail(before, erasure.planned_erase_set(ids, before.participants))
        out = erasure.erase_participants(store, ids, confirm)
        return ActionResult("remove_participants_file", out.ok,
                            {"status": status, "detail": detail, **out.frames}, out)
    if clear_table:
        out = erasure.clear_table(store, clear_table, confirm)
        return ActionResult("clear_table", out.ok, out.frames, out)
    tables = store.tables()
    if export_table:
        status, n, path = export_table_csv(tables.get(export_table), export_table, output_dir)
        return ActionResult("export_table", True,
                            detail={"status": status, "n_rows": n, "path": path})
    if export_all:
        manifest = export_all_csv(spark, tables, output_dir)
        summary = export_summary(manifest)
        done = summary.first()  # one row over four
        return ActionResult("export_all", done["tables_succeeded"] == done["tables_total"],
                            {"manifest": manifest, "summary": summary}, detail=done.asDict())
    if section == "all":  # the long form, from shared scans
        return ActionResult("reports", True, {"report_long": report_long_onepass(tables)})
    reports = section_report(tables, section)
    return ActionResult("reports", True, {**reports, "report_long": report_long(reports)})
