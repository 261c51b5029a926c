"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised with its own codebook (k-means on a
bounded sample). A vector's cell is the pair of its centroids. A query walks the centroid
pairs by growing sum of the two distances, kept in a heap, until the cells it has met hold
enough vectors; the entries of those cells are reranked by the exact cosine of the
original vectors in double precision. Enough is a share of all vectors, set so that ``TRIALS``
queries of the sample would find ``recall`` of their true neighbours in the sample: small for
vectors that cluster, near a half for vectors without structure.

Every valid vector is indexed; a row given again (same id, same vector) counts once, whatever its number of
copies. Cells over ``chunk`` entries are cut into chunks, the queries of a crowded cell into
groups, and each chunk meets each group in a task of bounded size, which returns the ``k`` best ids of the
chunk for each query. Chunks and groups are dealt by id and vector, so that the vectors of one id
spread. The codebooks (``2 * centroids`` half
vectors) and the numbers of entries and ids in each cell (``centroids`` squared) are broadcast; all are
bounded by parameters.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those whose length isn't the most frequent one (ties: the longer). Ties in score go to the
smaller id. A row's own id is never its neighbour; an id with several vectors is as near as its nearest
one, both as a query (one answer for all its vectors) and as a neighbour. Fewer than ``k`` candidates are all
returned. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import new_work_path, remove_path

from .common import hash62, share_below, stage

CENTROIDS = 16
SAMPLE = 16_384
RECALL = 0.96
TRIALS = 256
CHUNK = 4096
GROUP = 1024


def valid(v: Column) -> Column:
    """A vector that takes part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, good) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().astype(np.float64).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 11) -> np.ndarray:
    """Lloyd's k-means on a bounded sample, from distinct rows spread by k-means++ draws."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        centres.append(x[min(int(np.searchsorted(np.cumsum(near), rng.random() * near.sum())), len(x) - 1)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = _distances(x, c).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if np.allclose(new, c):
            break
        c = new
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None], 0)


def walk(d1: np.ndarray, d2: np.ndarray, entries: np.ndarray, wanted: int, heads: np.ndarray, ids: int) -> list[int]:
    """Cells by growing ``d1[i] + d2[j]`` until they hold ``wanted`` entries and the ``heads`` of ``ids`` ids (each
    id is counted in one of its cells); empty cells are passed over."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out, met, known = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0, 0
    while heap and (met < wanted or known < ids):
        _, a, b = heapq.heappop(heap)
        cell = int(o1[a]) * len(d2) + int(o2[b])
        if entries[cell]:
            out.append(cell)
            met += int(entries[cell])
            known += int(heads[cell])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(d1) and y < len(d2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))
    return out


def share_needed(unit: np.ndarray, ids: np.ndarray, half: int, c1: np.ndarray, c2: np.ndarray, k: int,
                 recall: float) -> float:
    """The share of the entries that a walk has to meet for ``recall`` of the sample's true neighbours."""
    d1, d2 = _distances(unit[:, :half], c1), _distances(unit[:, half:], c2)
    cell = d1.argmin(axis=1) * len(c2) + d2.argmin(axis=1)
    entries, needed = np.bincount(cell, minlength=len(c1) * len(c2)), []
    for i in range(0, len(unit), max(1, len(unit) // TRIALS)):
        score = unit @ unit[i]
        near = np.argsort(-score, kind="stable")
        near = near[ids[near] != ids[i]]
        near = near[np.sort(np.unique(ids[near], return_index=True)[1])[:k]]  # the nearest vector of each id
        order = np.argsort((d1[i][:, None] + d2[i][None]).ravel(), kind="stable")
        met = np.empty(len(order))
        met[order] = np.cumsum(entries[order])
        needed += (met[cell[near]] / len(unit)).tolist()
    return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def _rerank(k: int):
    def run(entries: pa.Table, probes: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not entries.num_rows or not probes.num_rows:
            return schema.empty_table()
        order = np.argsort(entries.column("vec_id").to_numpy(), kind="stable")
        ids = entries.column("vec_id").to_numpy()[order]
        each = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # where the vectors of an id begin
        ids = ids[each]
        v, q = _matrix(entries.column("v"))[order], _matrix(probes.column("v"))
        qid = probes.column("query_id").to_numpy()
        # einsum sums each pair in one and the same order, so that equal vectors score alike anywhere
        length = np.sqrt(np.einsum("ij,ij->i", v, v))
        found = []
        for i in range(len(qid)):
            score = np.einsum("ij,j->i", v, q[i]) / (length * np.sqrt(np.einsum("j,j->", q[i], q[i])))
            score = np.maximum.reduceat(score, each)
            score[ids == qid[i]] = -np.inf
            if len(ids) > k:  # everything as good as the k-th best, then the smallest ids
                least = np.partition(score, len(score) - k)[len(score) - k]
                near = np.flatnonzero(score >= least)
            else:
                near = np.arange(len(ids))
            near = near[np.lexsort((ids[near], -score[near]))][:k]
            found += [(qid[i], ids[j], score[j]) for j in near if score[j] > -np.inf]
        return pa.table([pa.array([f[c] for f in found], t.type) for c, t in enumerate(schema)], schema=schema)
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, centroids: int = CENTROIDS, sample: int = SAMPLE,
           recall: float = RECALL, chunk: int = CHUNK, group: int = GROUP,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row with ``is_query``."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("asks"))
            .where(F.col("vec_id").isNotNull() & valid(F.col("v"))))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if top is None:
        return spark.createDataFrame([], empty)
    distinct_path = new_work_path(spark, "llm-vectors")
    rows = stage(rows.where(F.size("v") == top["d"]).groupBy("vec_id", "v").agg(F.max("asks").alias("asks")),
                 "vectors", distinct_path)
    n = rows.count()
    part = hash62("vec_id", "v") < share_below(sample, n)
    drawn = rows.where(part).select("vec_id", "v").toArrow()  # about ``sample`` rows
    if not drawn.num_rows:
        drawn = rows.select("vec_id", "v").limit(sample).toArrow()
    unit, half = _unit(_matrix(drawn.column("v"))), (top["d"] + 1) // 2
    c1, c2 = kmeans(unit[:, :half], centroids), kmeans(unit[:, half:], centroids) if top["d"] > 1 else np.zeros((1, 0))
    known = drawn.column("vec_id").to_numpy()
    wanted = int(np.ceil(share_needed(unit, known, half, c1, c2, k, recall) * n)) + k + 1
    books = spark.sparkContext.broadcast((c1, c2, half))

    def assign(batches):
        a, b, cut = books.value
        for x in batches:
            if x.num_rows:
                u = _unit(_matrix(x.column("v")))
                cell = _distances(u[:, :cut], a).argmin(axis=1) * len(b) + _distances(u[:, cut:], b).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(cell.astype(np.int32))],
                                                 names=["vec_id", "v", "asks", "cell"])

    kind = rows.schema["v"].dataType.simpleString()
    index = stage(rows.mapInArrow(assign, f"vec_id bigint, v {kind}, asks boolean, cell int"), "multi-index")
    remove_path(spark, distinct_path)  # the index holds the same rows

    def by_cell(part: DataFrame) -> np.ndarray:
        out = np.zeros(len(c1) * len(c2), dtype=np.int64)
        for r in part.groupBy("cell").agg(F.count("*").alias("n")).collect():
            out[r["cell"]] = r["n"]
        return out

    heads = index.groupBy("vec_id").agg(F.min("cell").alias("cell"))  # an id may have vectors in many cells
    counts = spark.sparkContext.broadcast((by_cell(index), by_cell(heads)))

    def probe(batches):
        a, b, cut = books.value
        for x in batches:
            if not x.num_rows:
                continue
            u = _unit(_matrix(x.column("v")))
            entries, ids = counts.value
            cells = [walk(p, q, entries, wanted, ids, k + 1)
                     for p, q in zip(_distances(u[:, :cut], a), _distances(u[:, cut:], b), strict=True)]
            at = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays(
                [x.column("vec_id").take(pa.array(at)), x.column("v").take(pa.array(at)),
                 pa.array([c for cs in cells for c in cs], pa.int32())], names=["query_id", "v", "cell"])

    queries = index.where("asks").select("vec_id", "v")
    probes = stage(queries.mapInArrow(probe, f"query_id bigint, v {kind}, cell int"), "probes")
    chunks = index.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    groups = probes.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    cut = stage(chunks.join(groups, "cell"), "cells")  # one row for each cell
    deal = lambda c, n: F.pmod(F.xxhash64(c, "v"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(cut, "cell").select("cell", deal("vec_id", "chunks").alias("chunk"),
                                          spread("groups").alias("group"), "vec_id", "v")
    right = probes.join(cut, "cell").select("cell", spread("chunks").alias("chunk"),
                                            deal("query_id", "groups").alias("group"), "query_id", "v")
    task = ["cell", "chunk", "group"]
    best = (left.groupBy(*task).cogroup(right.groupBy(*task))
            .applyInArrow(_rerank(k), "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
