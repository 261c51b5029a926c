import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cohortlens.session import apply_defaults

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests have no cluster checkpoint folder: set one, as the library would
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-test-ckpt-"))
    apply_defaults(s)
    yield s


@pytest.fixture(scope="session")
def tables001(spark):
    from cohortlens.sources.fixtures import fixture_tables
    return fixture_tables(spark, SF001)


@pytest.fixture()
def scratch(spark):
    from cohortlens.session import new_work_path
    path = new_work_path(spark, "test")
    # local runs: a plain path, so that tests can also look at the files
    return path[len("file:"):] if path.startswith("file:") else path
