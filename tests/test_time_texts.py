"""Time texts read alike by the library and by the oracle, which states the forms apart from it."""

import itertools

import duckdb
from pyspark.sql import functions as F

from cohortlens.functions.exprs import parse_ts
from cohortlens.plans.oracle import _stamp

DATES = ("2024-01-03", "2024-1-3", "2024-02-30", "2024-13-01", "20240103", "2024-02-29", "2024-01", "x", "",
         " 2024-01-03 ", "\t2024-01-03\n")
TIMES = ("", "T10:10", "T10:10:10", " 10:10:10.5", "T1:2:3", "T24:00:00", "T10:60:00", "T10:10:60",
         "T10:10:59.999999", "T10:10:10.1234567", "T101010", "T101010.25", "T10", "T23:59")
ZONES = ("", "Z", "UTC", " UTC", "+02", "+02:00", "+0230", " -05:30", "-0530", "+2", "z", "+14:00", "-00:01")


def test_time_texts_read_alike(spark):
    texts = ["".join(parts) for parts in itertools.product(DATES, TIMES, ZONES)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    got = dict(df.select("i", F.unix_micros(parse_ts("a"))).collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("CREATE TABLE t (i INT, a VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)])
    want = dict(con.execute(f"SELECT i, epoch_us({_stamp('a')}) FROM t").fetchall())
    unlike = [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not unlike, unlike
    assert sum(v is not None for v in got.values()) > 200
