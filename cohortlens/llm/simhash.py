"""SimHash near-dedup with BK-trees.

A fingerprint has bit i set when over half of the text's shingle hashes (XXH64, seed 42)
have it set. Two fingerprints link when they differ in at most ``radius`` bits; the
classes are the connected components of the links.

Links are found in BK-trees (children keyed by the integer Hamming distance to their
parent; a search follows only the edges within the radius). The distinct fingerprints
are cut into shards such that two within the radius always meet: with ``radius + 2``
blocks of bits, two blocks at least agree, so every fingerprint joins one shard for
each pair of blocks. A shard over ``shard_size`` members is dealt to a triangle of cells,
each with a bounded tree that the members of one other cell search. The trees travel
to the tasks by key, not by a driver broadcast: that would gather the fingerprints of all
documents on the driver and search every tree with every fingerprint.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a text
with fewer words than a shingle is one shingle; repeated rows keep one output row each;
a null ``doc_id`` takes part but never names a class unless the class has no other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, stage, text_slices, word_blocks

SEED = 42


def shingle_hashes(text: str | None, words: int) -> Iterator[list[int]]:
    """XXH64 of the lower-cased (A-Z) word shingles, a bounded list at a time."""
    carry: list[bytes] = []
    emitted = False
    for block in word_blocks((text or "").encode().lower()):
        carry += block
        if len(carry) >= words:
            emitted = True
            yield [xxhash.xxh64_intdigest(b" ".join(s), SEED)
                   for s in zip(*(carry[i:] for i in range(words)), strict=False)]
            carry = carry[len(carry) - words + 1:]
    if carry and not emitted:
        yield [xxhash.xxh64_intdigest(b" ".join(carry), SEED)]


def simhash_batch(texts: list[str | None], words: int, flush: int = 1 << 16) -> np.ndarray:
    """Fingerprints of ``texts`` as uint64."""
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[int] = []
    owner: list[int] = []
    starts: list[int] = []

    def tally() -> None:
        if held:
            h = np.array(held, dtype=np.uint64).astype(">u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(ones, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            held.clear(), owner.clear(), starts.clear()

    for row, text in enumerate(texts):
        for hashes in shingle_hashes(text, words):
            owner.append(row)
            starts.append(len(held))
            held.extend(hashes)
            total[row] += len(hashes)
            if len(held) >= flush:
                tally()
    tally()
    return np.packbits(ones * 2 > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with the text column replaced by its fingerprint ``fp``, a signed long."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for b in text_slices(batches, text_col):
            fp = simhash_batch(b.column(text_col).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(fp.view(np.int64))],
                                             names=[*rest, "fp"])

    return docs.mapInArrow(run, schema)


class BKTree:
    """Integers under Hamming distance; each child hangs on the edge of its distance."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.nodes.append(value)
        self.edges.append({})
        if len(self.nodes) == 1:
            return
        at = 0
        while True:
            d = (self.nodes[at] ^ value).bit_count()
            child = self.edges[at].get(d)
            if child is None:
                self.edges[at][d] = len(self.nodes) - 1
                return
            at = child

    def search(self, value: int, radius: int) -> list[int]:
        """Indices of the nodes within ``radius`` of ``value``."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            at = todo.pop()
            d = (self.nodes[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.edges[at]
            for e in range(max(d - radius, 0), d + radius + 1):
                if e in edges:
                    todo.append(edges[e])
        return found


class _Cell:
    """One cell's tree; its links are kept as a forest over the tree's nodes."""

    def __init__(self, radius: int) -> None:
        self.radius, self.tree, self.up = radius, BKTree(), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, found: list[int]) -> None:
        for i in found[1:]:
            self.up[self.root(i)] = self.root(found[0])

    def member(self, value: int) -> None:
        found = self.tree.search(value, self.radius)
        self.tree.add(value)
        self.up.append(len(self.up))
        self.join([len(self.up) - 1, *found])

    def query(self, value: int) -> int | None:
        found = self.tree.search(value, self.radius)
        self.join(found)
        return self.tree.nodes[found[0]] if found else None

    def links(self) -> list[tuple[int, int]]:
        nodes = self.tree.nodes
        return [(nodes[i], nodes[r]) for i in range(len(nodes)) if (r := self.root(i)) != i]


def _search_cells(radius: int):
    mask = (1 << 64) - 1

    def run(batches):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        at, cell, out = None, None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("combo", "key", "i", "j", "role", "fp")]
            for combo, key, i, j, role, fp in zip(*cols, strict=True):
                if (combo, key, i, j) != at:
                    if cell:
                        out += cell.links()
                    at, cell = (combo, key, i, j), _Cell(radius)
                if role == 0:
                    if i == j:
                        cell.member(fp & mask)
                    else:  # links inside the tree's own cell are found in cell (i, i)
                        cell.tree.add(fp & mask)
                        cell.up.append(len(cell.up))
                elif (m := cell.query(fp & mask)) is not None:
                    out.append((fp & mask, m))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([signed(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        if cell and (out := cell.links()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([signed(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 2, shard_size: int = 1024) -> DataFrame:
    """Links ``(a, b)`` that join the same classes as all pairs of ``distinct(fp)`` within ``radius``."""
    blocks = radius + 2
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in pair)
             for pair in combinations(range(blocks), 2)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("combo", "key"))
    crowds = (keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
              .select("combo", "key", F.ceil(F.col("n") / shard_size).cast("int").alias("cells")))
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    dealt = (keyed.join(crowds, ["combo", "key"])
             .select("combo", "key", "fp", own.alias("own"),
                     F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
             .select("combo", "key", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("role"), "fp"))
    cells = ["combo", "key", "i", "j"]
    return (dealt.repartition(*cells).sortWithinPartitions(*cells, "role", "fp")
            .mapInArrow(_search_cells(radius), "a bigint, b bigint"))


def _classes(prints: DataFrame, radius: int, shard_size: int) -> DataFrame:
    """``(fp, root, component_id)`` of every distinct fingerprint of ``prints(doc_id, fp)``."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp"), radius, shard_size))
    rooted = (distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first_doc", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, shard_size: int = 1024,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest doc_id of the class (itself for a class of one).
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stage(fingerprints(ids, words), "simhash")
    return (prints.join(_classes(prints, radius, shard_size), "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2, shard_size: int = 1024) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id (nulls last), then the smallest row hash."""
    row = F.xxhash64(*docs.columns).alias("row")
    prints = stage(fingerprints(docs.select("doc_id", row, "text"), words), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "row")
    keep = (prints.join(_classes(prints, radius, shard_size), "fp")
            .groupBy("root").agg(F.min(first).alias("first"))
            .select("first.unnumbered", F.coalesce("first.doc_id", F.lit(0)).alias("did"), "first.row"))
    key = ["unnumbered", "did", "row"]
    d = docs.select(F.struct("*").alias("doc"), F.col("doc_id").isNull().alias("unnumbered"),
                    F.coalesce("doc_id", F.lit(0)).alias("did"), row)
    found = d.join(keep, key)
    # wholly repeated rows all meet the keeper's key: one of them stays (the join's own partitions)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("did"))
    return found.withColumn("nth", nth).where("nth = 1").select("doc.*")
