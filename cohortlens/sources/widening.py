"""Parquet tables written by several writers, read under one schema.

Files of one table may differ in how wide their columns are (a later writer stores ids as long, dates as
timestamps), in column order and in which columns they have. Spark merges footers that only
differ in columns; where types differ the footers are read once each, files of one schema form a group, and the groups
are read under the narrowest types that hold all of them. A pair of types without a common wider one is an error that
names the column, both types and a file of each.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.schema import StudyError

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrowest type that holds every value of both without loss, or None."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        if not isinstance(a, T.DateType) and not isinstance(b, T.DateType):
            return None  # with and without a zone
        return b if isinstance(a, T.DateType) else a
    if isinstance(a, (T.FloatType, T.DoubleType)) and isinstance(b, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.DoubleType) and isinstance(y, _WHOLE[:3]):
            return x
        if isinstance(x, T.FloatType) and isinstance(y, _WHOLE[:3]):
            return x if isinstance(y, _WHOLE[:2]) else T.DoubleType()
        if isinstance(x, T.DecimalType) and isinstance(y, (*_WHOLE, T.DecimalType)):
            scale = max(x.scale, getattr(y, "scale", 0))
            before = max(x.precision - x.scale, _DIGITS[type(y)] if isinstance(y, _WHOLE) else y.precision - y.scale)
            return T.DecimalType(before + scale, scale) if before + scale <= 38 else None
    return None


def resolve(schemas: list[tuple[str, T.StructType]]) -> T.StructType:
    """One schema for files ``(name, schema)``: columns in order of appearance, all nullable."""
    kinds: dict[str, tuple[T.DataType, str]] = {}
    for name, schema in schemas:
        for f in schema.fields:
            known = kinds.get(f.name)
            if known is None:
                kinds[f.name] = f.dataType, name
                continue
            wide = wider(known[0], f.dataType)
            if wide is None:
                raise StudyError(f"column {f.name!r} is {known[0].simpleString()} in {known[1]} and "
                                 f"{f.dataType.simpleString()} in {name}: no type holds both")
            kinds[f.name] = wide, known[1] if wide == known[0] else name
    return T.StructType([T.StructField(c, t) for c, (t, _) in kinds.items()])


def data_files(spark: SparkSession, root: str) -> list[str]:
    """The data files below a table's folder (names with ``_`` or ``.`` in front are none)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, todo = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    base = len(path.toUri().getPath().rstrip("/"))
    while todo.hasNext():
        file = todo.next().getPath()
        parts = file.toUri().getPath()[base:].strip("/").split("/")
        if not any(p.startswith(("_", ".")) for p in parts):
            found.append(file.toString())
    return sorted(found)


def read_table(spark: SparkSession, root: str, options: dict[str, str] | None = None) -> DataFrame:
    """The Parquet table at ``root`` under one schema."""
    reader = lambda: spark.read.options(**(options or {}))
    try:
        return reader().option("mergeSchema", "true").parquet(root)
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
    files = data_files(spark, root)
    with ThreadPoolExecutor(max_workers=16) as pool:  # a footer each
        schemas = list(zip(files, pool.map(lambda f: spark.read.parquet(f).schema, files), strict=True))
    schema = resolve(schemas)
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for file, own in schemas:
        groups.setdefault(own.json(), (own, []))[1].append(file)
    out = None
    for own, names in groups.values():
        part = reader().schema(own).parquet(*names)
        part = part.select(*[(F.col(f"`{f.name}`") if f.name in own.names else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in schema.fields])
        out = part if out is None else out.union(part)
    return out
