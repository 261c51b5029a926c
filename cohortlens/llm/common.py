"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import new_work_path

#: a word: a run of anything but the six ASCII blanks (bytes.split() cuts at the same six)
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts may be long: few rows to an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` under the shared scratch folder and read it back (cuts the lineage)."""
    path = path or new_work_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each holds about ``max_bytes`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        total = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * max_bytes / max(total, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        batch = None
        give_back()
    give_back()


def give_back() -> None:
    """Hand memory that this worker no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a glibc system
        pass


def share_below(sample: int, n: int) -> int:
    """The bound below which about ``sample`` of ``n`` 62-bit hashes lie (all of them if there are no more)."""
    return min(1 << 62, (sample << 62) // max(n, 1))


def hash62(*cols: str) -> Column:
    """A hash from 0 to 2^62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data``, a list for each stretch of about ``size`` bytes, no word cut."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            # move on to the next blank, so that no word is cut
            nearest = [p for p in (data.find(c, end, end + size) for c in b" \t\n\r\x0b\x0c")
                       if p >= 0]
            while not nearest and end + size < len(data):
                end += size
                nearest = [p for p in (data.find(c, end, end + size) for c in b" \t\n\r\x0b\x0c")
                           if p >= 0]
            end = min(nearest) if nearest else len(data)
        yield data[at:end].split()
        at = end


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed c0, c1, ... (so that none clashes), and the names' map."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def share(spark: SparkSession, model: object):
    """Broadcast the state of ``model`` (plain arrays, lists and names)."""
    return spark.sparkContext.broadcast(vars(model))


def shared(kind: type, broadcast) -> object:
    """The model of class ``kind`` whose state was broadcast."""
    model = kind.__new__(kind)
    vars(model).update(broadcast.value)
    return model


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, root)`` of all the edges ``(u, v)`` in one task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())],
                                     names=["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = 1 << 18) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` of longs as ``(node, root)``, root the smallest node.

    Up to ``few`` edges, counted, are settled in one task. More of them alternate the large-star and the small-star step until the edge set is a set of
    stars. Each round is two aggregates and a join, written to the shared folder; only a
    count and a checksum come to the driver. Nodes without an edge to another node are absent.
    """
    def checked(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"),
                    F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
        return row["n"], row["x"], row["s"]

    current = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), "edges")
    seen = checked(current)
    for _ in range(max_rounds):
        if seen[0] <= few:
            return current.coalesce(1).mapInArrow(_settled, "node bigint, root bigint")
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        current = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = checked(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
