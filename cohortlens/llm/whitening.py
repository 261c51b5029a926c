"""Embedding whitening with Spark MLlib's BlockMatrix.

Entries become whole numbers (``floor(scale * c)``). The fit list holds each distinct whole vector
once; its centred rows are indexed into a distributed ``BlockMatrix``, whose transpose times
itself is the scatter matrix. Only that matrix (dimension x dimension) comes to the driver,
where ``numpy.linalg.eigh`` gives the components; a product of the centred blocks with the whitening matrix
projects the rows. All rows are read: nothing is sampled.

The scatter product cuts the rows' dimension into ``splits`` parts (a parameter of the JVM's
``BlockMatrix.multiply``), so that no task gets all rows: one part holds about ``part_rows``.
Copies of a vector are one row of the fit list; they meet again in a join whose fit side has one
row for each vector, which adaptive execution splits.

Defined cases: a vector that is null, empty or holds a null or non-finite entry takes no part, nor
does one whose length differs from the commonest one (of equally common ones, the longest);
entries beyond a long saturate; a component whose eigenvalue is zero but for rounding can't be
whitened and gives no rows (all components, if there is one distinct vector only); a deviation
beyond a long is null; repeated rows each give their rows; a null id stays null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 4096
PART_ROWS = 1 << 16

OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
       "identity_error double")


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the vectors that take part: every entry a long."""
    c = F.col(vec_col)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(c.isNotNull() & (F.size(c) > 0) & finite).select(
        F.col(id_col).alias("vec_id"),
        F.transform(c, lambda v: F.floor(v.cast("double") * float(scale)).cast("bigint")).alias("x"))
    return kept


def _commonest_length(rows: DataFrame) -> int | None:
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return best["d"] if best else None


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` staged with an ``index`` from 0 without gaps (one small row per partition is added up)."""
    placed = stage(rows.select("*", F.monotonically_increasing_id().alias("at")), name)
    part, offset = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).orderBy("part").collect()
    starts, total = [], 0
    for s in sizes:
        starts.append((s["part"], total))
        total += s["rows"]
    first = rows.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    return (placed.withColumn("part", part).join(F.broadcast(first), "part")
            .select((F.col("start") + offset).alias("index"), *rows.columns))


def block_matrix(rows: DataFrame, values: Column, n: int, d: int, block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """The rows ``(index, values)`` as a distributed matrix of ``n`` x ``d``."""
    made = rows.select("index", array_to_vector(values).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(made, "vector"), n, d)
    return matrix.toBlockMatrix(block_rows, d)


def gram(a: BlockMatrix, b: BlockMatrix, splits: int) -> np.ndarray:
    """``a`` transposed times ``b``, a small matrix, the shared dimension cut into ``splits`` parts."""
    t = a.transpose()
    product = t._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, t.rowsPerBlock, b.colsPerBlock).toLocalMatrix().toArray()


def local_block(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix as a BlockMatrix of one block."""
    block = DenseMatrix(*matrix.shape, matrix.ravel(order="F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), *matrix.shape)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """``(index, values)`` of a distributed matrix."""
    java = matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    made = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", java), "vector")
    return made.select("index", vector_to_array("vector").alias("values"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
           components: int = COMPONENTS, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows ``OUT`` for every vector that takes part and its first ``components`` components.

    ``deviation`` is the sum of ``(n * x - S)^2`` over the dimensions (S: the fit list's sums), ``whitened`` the
    projection of ``x - S / n`` over the root of the eigenvalue, ``explained`` the eigenvalue's share of the
    trace, ``identity_error`` the largest entry of the whitened fit list's covariance minus the identity.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], OUT)
    rows = stage(whole_vectors(vectors, id_col, vec_col, scale), "whole-vectors")
    d = _commonest_length(rows)
    if d is None:
        return nothing
    rows = rows.where(F.size("x") == d)
    fit = stage(indexed(rows.select("x").distinct(), "distinct-vectors"), "fit-list")
    big = "decimal(38,0)"
    sums = (fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim")
            .agg(F.sum(F.col("v").cast(big)).alias("s"), F.count("*").alias("n")).orderBy("dim").collect())
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]

    mean = F.array(*[F.lit(v / n) for v in s])
    centred = block_matrix(fit, F.zip_with("x", mean, lambda x, m: x.cast("double") - m), n, d, block_rows)
    blocks = math.ceil(n / block_rows)
    splits = max(1, min(blocks, math.ceil(n / part_rows)))
    cov = gram(centred, centred, splits) / n
    values, basis = np.linalg.eigh((cov + cov.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]
    trace = float(np.trace(cov))
    kept = [i for i in range(min(components, d)) if values[i] > max(trace, 0.0) * d * np.finfo(float).eps]
    if not kept:
        return nothing
    whitener = basis[:, kept] / np.sqrt(values[kept])

    projected = centred.multiply(local_block(spark, whitener))
    error = float(np.abs(gram(projected, projected, splits) / n - np.eye(len(kept))).max())
    # exact: with n and S known, a row's deviation is whole-number arithmetic
    total = F.array(*[F.lit(str(v)).cast(big) for v in s])
    deviation = F.aggregate(
        F.zip_with("x", total, lambda x, t: (F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast(big) - t),
        F.lit(0).cast(big), lambda acc, v: F.try_add(acc, F.try_multiply(v.cast(big), v.cast(big)).cast(big)).cast(big))
    figures = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col("values")[at].alias("whitened"),
                                 F.lit(float(values[i]) / trace).alias("explained"))
                        for at, i in enumerate(kept)])
    done = stage(fit.join(rows_of(projected), "index")
                 .select("x", deviation.try_cast("bigint").alias("deviation"), figures.alias("figures")), "whitened")
    return (rows.join(done, "x").select("vec_id", "deviation", F.explode("figures").alias("f"))
            .select("vec_id", "f.component", F.lit(n).cast("bigint").alias("n"), "deviation", "f.whitened",
                    "f.explained", F.lit(error).alias("identity_error")))
