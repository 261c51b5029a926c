"""Snapshots of the four study tables.

Spark tables are immutable files, so a delete writes the changed data anew under a fresh folder,
and then a small manifest that names the folders and row counts of all four tables. Readers follow
manifests only: a failed run leaves files that nothing names, and can simply be tried again.

Every table is laid out in ``parts`` folders by a hash of the participant id, rows without an id in
a folder of their own. Erasing participants reads and rewrites the folders that hold them; the new
manifest names all others where they are. Rows are rebalanced on the folder number before the write,
so that AQE spreads a folder with a hot participant over several tasks and packs small ones together.
Within a file rows are sorted by id, and the id column has Parquet's Bloom filters (or a dictionary): a lookup
of an id reads the row groups and pages that hold it, not the whole folder. Rows are counted by folder from the
footers of the files written. Two writers at once are not kept apart.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.schema import ID_COLUMN, STUDY_TABLES, StudyError, check_table_name
from cohortlens.session import path_exists, remove_path
from cohortlens.sources.tables import StudyTables

MANIFEST_SCHEMA = ("table_name string, parts int, schema string, "
                   "folders array<struct<part int, path string, n_rows bigint>>, parent bigint, note string")

PART = "cohortlens_part"
NO_ID = -1  # folder of the rows without a participant id

#: the filters' size follows the ids of each row group, up to Parquet's limit
ID_FILTERS = {f"parquet.bloom.filter.enabled#{ID_COLUMN}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def id_part(parts: int) -> Column:
    """Folder number of a row of a study table."""
    key = F.col(ID_COLUMN)
    return F.when(key.isNull(), NO_ID).otherwise(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


@dataclass(frozen=True)
class Folder:
    path: str
    n_rows: int


@dataclass(frozen=True)
class Entry:
    """A table of a version: its folders that hold rows, by folder number."""

    table_name: str
    parts: int
    schema: str
    folders: dict[int, Folder]

    @property
    def n_rows(self) -> int:
        return sum(f.n_rows for f in self.folders.values())

    def within(self, only: Iterable[int] | None) -> Entry:
        """The table as far as it lies in the folders ``only`` (None: all)."""
        if only is None:
            return self
        return Entry(self.table_name, self.parts, self.schema,
                     {p: f for p, f in self.folders.items() if p in set(only)})


class SnapshotStore:
    """Study tables under ``root``, published as numbered versions.

    A manifest is never changed once written, so each is read at most once; which
    version is the latest is looked up every time. ``parts`` counts for a store without a
    version; later the number that its manifests hold.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 16):
        self.spark = spark
        self.root = root.rstrip("/")
        self.parts = parts
        self._entries: dict[int, dict[str, Entry]] = {}

    # -- reading -------------------------------------------------------------

    def latest_version(self) -> int | None:
        """Newest published version (``None`` for an empty store)."""
        folder = f"{self.root}/_manifests"
        if not path_exists(self.spark, folder):
            return None
        return (self.spark.read.schema(MANIFEST_SCHEMA + ", version int").json(folder)
                .agg(F.max("version").alias("v")).first()["v"])

    def manifest(self, version: int | None = None) -> dict[str, Entry]:
        """Table entries of ``version`` (default: the latest)."""
        v = self.latest_version() if version is None else version
        if v is None:
            raise StudyError(f"no published snapshot under {self.root!r}")
        if v not in self._entries:
            rows = self.spark.read.schema(MANIFEST_SCHEMA).json(self._manifest_path(v)).collect()
            self._entries[v] = {
                r["table_name"]: Entry(r["table_name"], r["parts"], r["schema"],
                                       {f["part"]: Folder(f["path"], f["n_rows"]) for f in r["folders"]})
                for r in rows}
        return self._entries[v]

    def read(self, entry: Entry) -> DataFrame:
        """The rows of the folders that ``entry`` names."""
        schema = T.StructType.fromJson(json.loads(entry.schema))
        paths = [f.path for _, f in sorted(entry.folders.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def tables(self, version: int | None = None, only: Iterable[int] | None = None) -> StudyTables:
        """The tables of ``version`` (of their folders ``only``)."""
        entries = {t: e.within(only) for t, e in self.manifest(version).items()}
        return StudyTables(**{t: self.read(entries[t]) for t in STUDY_TABLES})

    # -- writing -------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifests/version={version:08d}"

    def _table_path(self, table: str) -> str:
        """A fresh folder: what a failed publish has left is never in the way."""
        return os.path.join(self.root, "tables", table, uuid.uuid4().hex)

    def _write(self, name: str, rows: DataFrame, parts: int) -> Entry:
        """Write a table's rows in folders, sorted by id; footers give the rows of each folder."""
        path = self._table_path(name)
        (rows.withColumn(PART, id_part(parts)).hint("rebalance", F.col(PART)).sortWithinPartitions(PART, ID_COLUMN)
         .write.mode("errorifexists").options(**ID_FILTERS).partitionBy(PART).parquet(path))
        written = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(PART, T.IntegerType())]))
        n = {r[PART]: r["n"] for r in written.parquet(path).groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()}
        return Entry(name, parts, rows.schema.json(),
                     {p: Folder(os.path.join(path, f"{PART}={p}"), n[p]) for p in sorted(n)})

    def publish(self, changes: dict[str, DataFrame], note: str = "",
                only: dict[str, Iterable[int]] | None = None) -> int:
        """Write the changed tables and then the manifest; return the version.

        The first publish must give all four tables. A table in ``only`` is changed in those
        folders (its frame holds their rows), and keeps its others.
        """
        for name in changes:
            check_table_name(name)
        parent = self.latest_version()
        base = self.manifest(parent) if parent is not None else {}
        missing = [t for t in STUDY_TABLES if t not in changes and t not in base]
        if missing:
            raise StudyError(f"first snapshot needs all tables; missing {', '.join(missing)}")
        version = (parent or 0) + 1

        def write(name: str) -> Entry:
            new = self._write(name, changes[name], base[name].parts if name in base else self.parts)
            if only is None or name not in only:
                return new
            stay = base[name].within(set(base[name].folders) - set(only[name]))
            return Entry(name, new.parts, stay.schema, {**stay.folders, **new.folders})

        # The tables are independent jobs: submit them together so that small
        # tables do not leave the cluster idle while a big one finishes.
        with ThreadPoolExecutor(max_workers=max(1, len(changes))) as pool:
            written = {e.table_name: e for e in pool.map(write, list(changes))}
        self._write_manifest(version, {**base, **written}, parent, note)
        return version

    def _write_manifest(self, version: int, entries: dict[str, Entry], parent: int | None,
                        note: str) -> None:
        rows = [(e.table_name, e.parts, e.schema, [(p, f.path, f.n_rows) for p, f in e.folders.items()],
                 parent, note) for e in entries.values()]
        (self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
         .write.mode("errorifexists").json(self._manifest_path(version)))
        self._entries[version] = dict(entries)

    def remove_superseded(self, confirm: str | None) -> list[str]:
        """Delete for good what the latest version doesn't name; confirmed with ``YES``.

        Earlier versions, and whatever failed publishes left, can't be read afterwards.
        Returns the folders removed.
        """
        if confirm != "YES":
            raise StudyError("removing superseded data must be confirmed with YES")
        latest = self.latest_version()
        keep = {f.path for e in self.manifest(latest).values() for f in e.folders.values()}
        gone = []
        for table in STUDY_TABLES:
            for written in self._children(os.path.join(self.root, "tables", table)):
                folders = self._children(written)
                superseded = [path for path in folders if path not in keep]
                # a whole write goes at once if nothing of it is named any more
                for path in superseded if keep.intersection(folders) else [written]:
                    remove_path(self.spark, path)
                gone += [path for path in superseded if os.path.basename(path).startswith(PART)]
        for path in self._children(f"{self.root}/_manifests"):
            if path != self._manifest_path(latest):
                remove_path(self.spark, path)
        self._entries = {latest: self._entries[latest]}
        return gone

    def _children(self, folder: str) -> list[str]:
        if not path_exists(self.spark, folder):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [os.path.join(folder, s.getPath().getName()) for s in fs.listStatus(path)]


def create_store(spark: SparkSession, root: str, tables: StudyTables,
                 note: str = "initial", parts: int = 16) -> SnapshotStore:
    """Publish ``tables`` as version 1 of a new store at ``root``.

    ``parts`` is the number of folders of a table: what one participant's erasure rewrites is
    about one of ``parts`` of it. A few hundred suit a large study.
    """
    store = SnapshotStore(spark, root, parts)
    if store.latest_version() is not None:
        raise StudyError(f"a store already exists at {root!r}")
    tables.validated(check_keys=True)
    store.publish(dict(tables.items()), note)
    return store
