"""Session defaults and the shared scratch folder.

The study operators need three settings to give the reference's answers:
UTC session time (text timestamps without an offset), ANSI mode (errors
instead of silent overflow) and AQE (runtime choice of broadcast versus
sort-merge join, partition coalescing and skew splitting).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # coalesce shuffle partitions to the advisory size rather than keeping one
    # per core: fewer, fuller tasks (Spark's advice for busy clusters)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "cohortlens",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the study defaults.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to
    about input bytes / 128 MB; AQE coalesces the small ones away.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime study defaults on an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)


def work_dir(spark: SparkSession) -> str:
    """Shared scratch folder: the cluster's checkpoint directory.

    Read from the session (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``). Only when neither is set and Spark runs in local
    mode, as in tests, a fresh temporary folder is made and registered as
    the checkpoint dir; on a cluster a machine-local folder would be invisible
    to the executors, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                           "(HDFS, S3, ...); cohortlens writes intermediates there")
    local = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def new_work_path(spark: SparkSession, prefix: str) -> str:
    """A fresh, never reused path under the shared scratch folder."""
    return os.path.join(work_dir(spark), f"{prefix}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path and all below it (no error if it is gone)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
