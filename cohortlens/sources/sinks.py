"""CSV export of study tables, with a manifest.

Each table becomes a directory of CSV part files written in parallel by the
executors (one header per part). Values are written the way the source
system's export writes them: NULL as an empty field, quotes doubled,
timestamps in ISO form (``T`` separator, fraction only when non-zero,
``+00:00`` offset in the UTC session), booleans as ``True``/``False``.
The row count of each export is observed inside the write job itself.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.schema import STUDY_TABLES, check_table_name
from cohortlens.session import work_dir
from cohortlens.sources.tables import StudyTables

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "nullValue": "",
               "emptyValue": "", "quoteAll": "false",
               # Spark's writer would otherwise cut blanks at the ends of values
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

MANIFEST_SCHEMA = "table_name string, status string, n_rows bigint, path string"


def _iso(c: Column, with_offset: bool) -> Column:
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    instant = c if with_offset else c.cast("timestamp")
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))) \
        .otherwise(F.lit(""))
    parts = [base, frac] + ([F.date_format(c, "xxx")] if with_offset else [])
    return F.concat(*parts)


def csv_text(df: DataFrame) -> DataFrame:
    """Every column as the text the export writes (NULL stays NULL)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.TimestampType):
            c = _iso(c, with_offset=True)
        elif isinstance(t, T.TimestampNTZType):
            c = _iso(c, with_offset=False)
        elif isinstance(t, T.BooleanType):
            c = F.initcap(c.cast("string"))
        elif not isinstance(t, T.StringType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_table_csv(df: DataFrame, table_name: str,
                     output_dir: str | None = None) -> tuple[str, int, str]:
    """Write one table to ``output_dir/<table>.csv/``.

    ``output_dir`` defaults to the shared scratch folder (never a local
    directory on a cluster). An earlier export of the table there is replaced.
    Returns ``(status, n_rows, path)``; an empty table writes nothing and has
    status ``empty`` (still a success, as in the source system).
    """
    check_table_name(table_name)
    if output_dir is None:
        output_dir = work_dir(df.sparkSession)
    path = os.path.join(output_dir, f"{table_name}.csv")
    if df.isEmpty():
        return "empty", 0, path
    obs = Observation(f"export_{table_name}")
    (csv_text(df).observe(obs, F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").options(**CSV_OPTIONS).csv(path))
    return "exported", obs.get["n"], path


def default_export_dir(base: str) -> str:
    return os.path.join(base, datetime.now().strftime("db_export_%Y%m%d_%H%M%S"))


def export_all_csv(spark: SparkSession, tables: StudyTables,
                   output_dir: str | None = None) -> DataFrame:
    """Export the four tables; return the manifest ``(table_name, status,
    n_rows, path)``. A failing table is recorded as ``failed`` and the others
    still run. ``output_dir`` defaults to a timestamped ``db_export_...``
    folder under the shared scratch folder."""
    if output_dir is None:
        output_dir = default_export_dir(work_dir(spark))
    def one(name: str) -> tuple[str, str, int, str]:
        try:
            status, n, path = export_table_csv(tables.get(name), name, output_dir)
        except Exception as exc:  # noqa: BLE001 - recorded in the manifest
            cause = str(exc).strip().splitlines() or [""]
            status, n, path = f"failed: {type(exc).__name__}: {cause[0]}", 0, os.path.join(
                output_dir, f"{name}.csv")
        return name, status, n, path

    # four independent write jobs, submitted together
    with ThreadPoolExecutor(max_workers=len(STUDY_TABLES)) as pool:
        rows = list(pool.map(one, STUDY_TABLES))
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


def export_summary(manifest: DataFrame) -> DataFrame:
    """Tables exported of all, total rows and the directory (one row)."""
    ok = F.col("status").isin("exported", "empty")
    return manifest.agg(
        F.count_if(ok).alias("tables_succeeded"),
        F.count(F.lit(1)).alias("tables_total"),
        F.coalesce(F.sum(F.when(ok, F.col("n_rows"))), F.lit(0)).cast("bigint").alias("total_rows"),
        F.min(F.regexp_replace("path", r"/[^/]+\.csv$", "")).alias("output_dir"))


def read_back_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read an export as text columns (empty field -> NULL).

    With ``columns`` the schema is given (every column text, as exported), so
    no job is spent reading the header to infer it.
    """
    # a quoted value may hold line ends and blanks
    reader = spark.read.options(header="true", escape='"', quote='"', multiLine="true",
                                ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)
