"""Erasing participants from all study tables, and clearing a table.

Deleting becomes keeping: each table's retained rows are a LEFT ANTI JOIN
against the erase set (the listed ids that are participants), written as a
new snapshot. ``left_anti`` keeps rows whose id is NULL, as ``id = v`` never
matches NULL in the source system (a ``NOT IN`` would drop them). Ids that are
not participants are never erased, even if child tables hold rows for them.

Ids given in code reach the scans as pushed predicates. The erase set of an id file is written
once to the shared checkpoint folder and counted in the same job, so that the four table
scans don't recompute it; Spark chooses the joins by bytes. A set too large for Spark to broadcast would
make it shuffle every row of the big tables: then a Bloom filter of the set, of bounded size, goes ahead of the exact
join, and only the rows that pass it are shuffled (``keyfilter``). The big tables are never collected.

On a stored study only the folders that can hold an erased id are searched, and only those
that hold a row to erase are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortlens.operators import keyfilter
from cohortlens.schema import ERASE_ORDER, ID_COLUMN, STUDY_TABLES, StudyError, check_table_name
from cohortlens.session import new_work_path, remove_path
from cohortlens.sources.snapshots import SnapshotStore, id_part
from cohortlens.sources.tables import StudyTables

# Order of the per-table plan lines (the source system lists children first).
PLAN_ORDER = ("code_submissions", "feedback", "events", "participants")


def batch_confirmation(n_participants: int) -> str:
    """The text a batch erase must be confirmed with."""
    return f"DELETE ALL {n_participants} PARTICIPANTS"


@dataclass
class EraseSet:
    """Distinct ids to erase.

    Ids given in code are ``values`` and reach the scans as pushed predicates; ids from a
    file are the frame ``ids``, written once at ``path``, and meet the tables in joins whose
    plan Spark chooses by size, behind ``filter`` if there is one.
    """

    ids: DataFrame
    n: int | None
    values: list[str] | None = None
    path: str | None = None
    filter: keyfilter.KeyFilter | None = None

    def drop(self) -> None:
        """Remove the written ids; frames over them must have been used before."""
        if self.path is not None:
            remove_path(self.ids.sparkSession, self.path)


def erase_ids(ids: DataFrame, participants: DataFrame) -> DataFrame:
    """Lazy erase set: listed ids that exist in ``participants`` (distinct)."""
    listed = ids.select(ID_COLUMN).where(F.col(ID_COLUMN).isNotNull())
    return participants.select(ID_COLUMN).join(listed, ID_COLUMN, "left_semi").distinct()


def materialize_erase_set(ids: DataFrame, participants: DataFrame) -> EraseSet:
    """Write the erase set once to the shared folder and count it.

    One job: the semi join runs once, its row count is observed in the same
    write, and the four table joins read the small written table instead of
    recomputing it (this also cuts the lineage back to the id file).
    """
    spark = participants.sparkSession
    path = new_work_path(spark, "erase-set")
    obs = Observation("erase_set")
    erase_ids(ids, participants).observe(obs, F.count(F.lit(1)).alias("n")) \
        .write.mode("errorifexists").parquet(path)
    written, n = spark.read.parquet(path), obs.get["n"]
    pruned = None if keyfilter.broadcast_by_spark(written) else keyfilter.build(written, ID_COLUMN, n)
    return EraseSet(written, n, path=path, filter=pruned)


def planned_erase_set(ids: DataFrame, participants: DataFrame) -> EraseSet:
    """The erase set as a plan: nothing is written, counted or left behind (for reading only)."""
    return EraseSet(erase_ids(ids, participants), None)


def erase_set_of(spark, ids: list[str], participants: DataFrame) -> EraseSet:
    """Erase set for ids given in code: those that are participants, found by a
    pushed predicate (at most ``len(ids)`` come back)."""
    listed = sorted(set(ids))
    found = [] if not listed else sorted(
        r[0] for r in participants.where(F.col(ID_COLUMN).isin(*listed)).select(ID_COLUMN).distinct().collect())
    frame = spark.createDataFrame([(i,) for i in found], f"{ID_COLUMN} string")
    return EraseSet(frame, len(found), values=found)


def rows_of(table: DataFrame, erase: EraseSet) -> DataFrame:
    """Rows of ``table`` that the erase removes."""
    key = F.col(ID_COLUMN)
    if erase.values is not None:
        return table.where(key.isin(*erase.values) if erase.values else F.lit(False))
    rows = erase.filter.passing(table, ID_COLUMN) if erase.filter else table.where(key.isNotNull())
    return rows.join(erase.ids, ID_COLUMN, "left_semi").select(*table.columns)


def retained(table: DataFrame, erase: EraseSet) -> DataFrame:
    """Rows of ``table`` that survive the erase (same columns, same order).

    Rows whose id is NULL never match. In a join they would all be hashed to one
    partition, however many there are, so they go around it.
    """
    key = F.col(ID_COLUMN)
    if erase.values is not None:
        return table.where(key.isNull() | ~key.isin(*erase.values)) if erase.values else table
    if erase.filter:  # what the filter stops, rows without an id among it, stays without a join
        doubtful, other = erase.filter.passing(table, ID_COLUMN), erase.filter.stopped(table, ID_COLUMN)
    else:
        doubtful, other = table.where(key.isNotNull()), table.where(key.isNull())
    return doubtful.join(erase.ids, ID_COLUMN, "left_anti").select(*table.columns).unionByName(other)


def retained_tables(tables: StudyTables, erase: EraseSet) -> StudyTables:
    return StudyTables(**{t: retained(df, erase) for t, df in tables.items()})


def _tagged_rows(frames: list[tuple[str, DataFrame]], value: int = 1) -> DataFrame:
    """One ``(k, v)`` row per input row, tagged with its frame's name.

    Counting several frames through one union and one aggregate costs one
    small shuffle, not one per frame; no data column is read.
    """
    parts = [df.select(F.lit(k).alias("k"), F.lit(value).alias("v")) for k, df in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def plan_counts(tables: StudyTables, erase: EraseSet, order=PLAN_ORDER) -> DataFrame:
    """``(table_name, id_column, n_rows)`` for every table with rows to erase."""
    rows = _tagged_rows([(t, rows_of(tables.get(t), erase)) for t in order])
    rank = F.create_map(*[x for i, t in enumerate(order) for x in (F.lit(t), F.lit(i))])
    return (rows.groupBy(F.col("k").alias("table_name"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(rank[F.col("table_name")])
            .select("table_name", F.lit(ID_COLUMN).alias("id_column"), "n_rows"))


def batch_summary(tables: StudyTables, erase: EraseSet) -> DataFrame:
    """One row: participants to erase and rows per table, and the total."""
    rows = _tagged_rows([("__ids", erase.ids)]
                        + [(t, rows_of(tables.get(t), erase)) for t in STUDY_TABLES])
    k = F.col("k")
    return rows.agg(F.count_if(k == "__ids").alias("n_participants"),
                    *[F.count_if(k == t).alias(f"rows_{t}") for t in STUDY_TABLES],
                    F.count_if(k != "__ids").alias("total_rows"))


def batch_status(ids: DataFrame, participants: DataFrame) -> DataFrame:
    """``(line_no, participant_id, found)`` for every listed id, repeats kept,
    in file order.

    The listed ids probe participants with a semi join (the id list is the
    small side); the found ids are then left-joined back to the list.
    """
    found = (participants.select(ID_COLUMN)
             .join(ids.select(ID_COLUMN), ID_COLUMN, "left_semi")
             .distinct().withColumn("found", F.lit(True)))
    return (ids.select("line_no", ID_COLUMN)
            .join(found, ID_COLUMN, "left")
            .select("line_no", ID_COLUMN, F.coalesce("found", F.lit(False)).alias("found"))
            .orderBy("line_no"))


def batch_detail(tables: StudyTables, erase: EraseSet) -> DataFrame:
    """``(participant_id, rows_<table>..., total_rows)``: what the erase removes for each id.

    The erased rows of all tables go through one union and one aggregate on the id.
    """
    parts = [rows_of(df, erase).select(ID_COLUMN, F.lit(t).alias("t")) for t, df in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy(ID_COLUMN).agg(
        *[F.count_if(F.col("t") == t).alias(f"rows_{t}") for t in STUDY_TABLES],
        F.count(F.lit(1)).alias("total_rows"))


def batch_result(spark, n: int, before: dict[str, int], after: dict[str, int]) -> DataFrame:
    """One row: erased and failed participants and rows removed, from the row counts
    that the writes of the two versions recorded."""
    gone = before["participants"] - after["participants"]
    total = sum(before[t] - after[t] for t in STUDY_TABLES)
    return spark.createDataFrame(
        [(min(gone, n), max(n - gone, 0), total)],
        "successful_deletions bigint, failed_deletions bigint, total_rows_deleted bigint")


# -- whole operations on a snapshot store ------------------------------------


@dataclass
class EraseOutcome:
    """What an erase or clear did. ``status`` is one of ``erased``,
    ``cleared``, ``nothing_to_do``, ``cancelled``."""

    status: str
    version: int | None = None
    n_participants: int = 0
    expected_confirmation: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.status != "cancelled"


Confirm = str | None | Callable[["EraseOutcome"], str | None]


def folder_counts(tables: StudyTables, erase: EraseSet, parts: int) -> dict[str, dict[int, int]]:
    """Rows to erase in each folder of each stored table, where there are any.

    One union and one aggregate; at most ``parts`` rows for each table come back.
    """
    frames = [rows_of(df, erase).select(F.lit(t).alias("t"), id_part(parts).alias("part"))
              for t, df in tables.items()]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.union(frame)
    found: dict[str, dict[int, int]] = {t: {} for t in STUDY_TABLES}
    for r in rows.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["t"]][r["part"]] = r["n"]
    return found


def _erase(store: SnapshotStore, version: int, erase: EraseSet, expected: str,
           confirm: Confirm) -> EraseOutcome:
    entries, spark = store.manifest(version), store.spark
    hit: dict[str, dict[int, int]] = {t: {} for t in STUDY_TABLES}
    if erase.n:
        parts = entries["participants"].parts
        hit = folder_counts(store.tables(version, _folders_of(erase.ids, parts)), erase, parts)
    rows = {t: sum(hit[t].values()) for t in STUDY_TABLES}
    frames = {
        "summary": spark.createDataFrame(
            [(erase.n, *(rows[t] for t in STUDY_TABLES), sum(rows.values()))],
            "n_participants bigint, " + ", ".join(f"rows_{t} bigint" for t in STUDY_TABLES) + ", total_rows bigint"),
        "plan": spark.createDataFrame([(t, ID_COLUMN, rows[t]) for t in PLAN_ORDER if rows[t]],
                                      "table_name string, id_column string, n_rows bigint")}
    if erase.n == 0:
        return EraseOutcome("nothing_to_do", n_participants=0, frames=frames)
    if callable(confirm):
        confirm = confirm(EraseOutcome("pending", n_participants=erase.n, frames=frames))
    if confirm != expected:
        return EraseOutcome("cancelled", n_participants=erase.n,
                            expected_confirmation=expected, frames=frames)
    # children first, then participants; all in one version; a table or folder without a
    # matching row keeps its files
    only = {t: set(hit[t]) for t in ERASE_ORDER if hit[t]}
    changes = {t: retained(store.read(entries[t].within(only[t])), erase) for t in only}
    done = store.publish(changes, note=f"erase {erase.n} participants", only=only)
    before, after = ({t: e.n_rows for t, e in m.items()} for m in (entries, store.manifest(done)))
    frames["result"] = batch_result(spark, erase.n, before, after)
    return EraseOutcome("erased", done, erase.n, expected, frames)


def _folders_of(ids: DataFrame, parts: int) -> set[int]:
    """Numbers of the folders that can hold ``ids`` (at most ``parts``)."""
    return {r["part"] for r in ids.select(id_part(parts).alias("part")).distinct().collect()}


def erase_participants(store: SnapshotStore, ids: DataFrame, confirm: Confirm) -> EraseOutcome:
    """Erase the listed participants from all four tables as one new version.

    The confirmation must be ``DELETE ALL <n> PARTICIPANTS`` with ``n`` the
    number of distinct listed ids that are participants. ``confirm`` may be
    the text itself or a callable that receives the pending outcome (with
    its summary frames and ``n_participants``) and returns the text, as an
    interactive prompt would. A wrong confirmation returns ``cancelled`` and
    leaves nothing written; the outcome then carries the summary and the expected
    confirmation. The erased rows stay in the version before until
    ``store.remove_superseded`` is called.
    """
    version = store.latest_version()
    erase = materialize_erase_set(ids, store.tables(version).participants)
    try:
        return _erase(store, version, erase, batch_confirmation(erase.n), confirm)
    finally:
        erase.drop()


def erase_participant(store: SnapshotStore, participant_id: str, confirm: Confirm) -> EraseOutcome:
    """Erase one participant (confirmed with ``YES``), found by pushed predicates."""
    if not participant_id or not participant_id.strip():
        raise StudyError("no participant id given")
    version = store.latest_version()
    erase = erase_set_of(store.spark, [participant_id], store.tables(version).participants)
    return _erase(store, version, erase, "YES", confirm)


def clear_table(store: SnapshotStore, table: str, confirm: Confirm) -> EraseOutcome:
    """Empty one table (schema kept) as a new version; confirmed with ``YES``."""
    check_table_name(table)
    n = store.manifest()[table].n_rows
    status = store.spark.createDataFrame([(table, n)], "table_name string, n_rows_cleared bigint")
    if n == 0:
        return EraseOutcome("nothing_to_do", frames={"status": status})
    if callable(confirm):
        confirm = confirm(EraseOutcome("pending", n_participants=0, frames={"status": status}))
    if confirm != "YES":
        return EraseOutcome("cancelled", expected_confirmation="YES", frames={"status": status})
    version = store.publish({table: store.tables().get(table).limit(0)}, note=f"clear {table}")
    return EraseOutcome("cleared", version, frames={"status": status})
