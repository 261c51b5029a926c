"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds its distinct shingles (64-bit hashes). Two sets link when
``100 * intersection >= percent * union``; classes are the connected components of the links.

1. *Sets.* Documents with equal sets are one class of copies from here on.
2. *Shared shingles.* A set that links shares ``percent`` of its shingles, so few of them are in no other set. First the
   smallest hashes of each set, a fixed share of them, meet by shingle: sets with more lone ones than a
   link allows are done. All shingles of the others meet, and of those in two sets or more a set must have enough.
3. *Groups.* Of its shingles, rarest first, a set's first ``n - ceil(percent * n / 100) + 1`` can't all be
   missing from a set that it links with. Sets that share one of these get into one group (components).
4. *R-tree join.* In a cell of a group shingles are hashed into ``GROUPS`` groups, and each set is the point
   of its group counts. The points are packed into an R-tree whose nodes keep the largest counts and the range of
   sizes. A search follows the nodes whose summed coordinate minima allow a link. Surviving pairs are
   verified on the sets; pairs in one class already need no check.

A group over the bounds of a cell is dealt to several: each cell joins itself, one leader of each cell's largest
class joins the other leaders, and then only the sets outside the group's largest class are
searched against the whole group. A large group of near copies so costs little more than its
cells, and no link between two classes is lost. Cells are bounded in rows and shingles.

Defined cases: a text without words, or null, has an empty set, which links with nothing, not even
another; a text of fewer words than a shingle is one shingle; repeated rows each give a row; a null
doc_id takes part, but names a class only if it has no other; an empty table gives an empty
result; other columns are not read. Equal 64-bit hashes count as equal (shingles, and sets of shingles).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, share, shared, stage, text_slices, word_blocks

WORDS = 5
PERCENT = 80
GROUPS = 64
FANOUT = 16
CELL_ROWS = 1024
CELL_SHINGLES = 1 << 21
FIRST_SHARE = 0.3  # of a set's shingles that meet first,
FIRST_MORE = 2  # and so many more
MOST_COUNTED = 1 << 16  # shingles in more sets are equally frequent
MOST_BITS = 1 << 27

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the lower-cased (A-Z) word shingles, uint64."""
    parts, carry, many = [], np.zeros(0, dtype=_U), 0
    factors = _mix(np.arange(1, words + 1, dtype=_U)) | _U(1)
    for block in word_blocks((text or "").encode().lower()):
        fresh = np.fromiter(map(xxhash.xxh64_intdigest, block), dtype=_U, count=len(block))
        many += len(fresh)
        w = np.concatenate([carry, fresh])
        if len(w) >= words:
            h = np.zeros(len(w) - words + 1, dtype=_U)
            for j in range(words):
                h += w[j:len(w) - words + 1 + j] * factors[j]
            parts.append(np.unique(_mix(h)))
            w = w[len(w) - words + 1:]
        carry = w
    if 0 < many < words:  # the whole sequence, apart from longer ones by its length
        parts.append(_mix(np.array([(carry * factors[:many]).sum() + _U(many)], dtype=_U)))
    if not parts:
        return carry[:0]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def set_number(shingles: np.ndarray) -> int:
    """A number for a set, equal for equal sets (signed 64 bits)."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def least_overlap(n, percent: int):
    """The least intersection that a set of ``n`` shingles needs for a link."""
    return -(-n * percent // 100)


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, cls, n)`` of ``docs(doc_id, text)``: the number of the set (null if empty) and its size."""
    schema = docs.select("doc_id", F.lit(None).cast("bigint").alias("cls"), F.lit(None).cast("bigint").alias("n")).schema

    def run(batches):
        for b in text_slices(batches, "text"):
            found = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([set_number(s) if len(s) else None for s in found], pa.int64()),
                 pa.array([len(s) for s in found], pa.int64())], names=["doc_id", "cls", "n"])

    return docs.mapInArrow(run, schema)


def first_size(n: np.ndarray) -> np.ndarray:
    """How many of a set's shingles meet first: enough that the lone ones among them can rule it out."""
    return np.minimum(n, np.ceil(n * FIRST_SHARE).astype(np.int64) + FIRST_MORE)


class Members:
    """A Bloom filter of set numbers, packed bits (at most ``MOST_BITS``, whatever their count)."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(cls: np.ndarray, size: int) -> list[np.ndarray]:
        h = _mix(cls.view(_U))
        return [((h >> _U(i)) % _U(size)).astype(np.int64) for i in (0, 21, 42)]

    def __contains__(self, cls: int) -> bool:
        at = np.concatenate(self.places(np.array([cls], dtype=np.int64), 8 * len(self.bits)))
        return bool((self.bits[at >> 3] >> (at & 7) & 1).all())


def members(cls: DataFrame, n: int) -> Members:
    """The filter of the ``n`` numbers in ``cls(cls)``, its bits set in the tasks and put together by place."""
    size = 1 << min(max(16 * n, 1 << 10).bit_length(), MOST_BITS.bit_length() - 1)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = np.unique(np.concatenate(Members.places(x, size)))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(_U(1), (at & 63).astype(_U)), first) if len(at) else at.view(_U)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = (cls.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return Members(out.view(np.uint8))


def shingle_rows(docs: DataFrame, words: int, only: Members | None = None) -> DataFrame:
    """``(shingle, cls, n)``: the first shingles of every set, or all shingles of the sets in ``only``."""
    model = None if only is None else share(docs.sparkSession, only)

    def run(batches):
        keep = None if model is None else shared(Members, model)
        for b in text_slices(batches, "text"):
            known: dict[int, np.ndarray] = {}  # copies in a slice count once
            for t in b.column("text").to_pylist():
                s = shingle_set(t, words)
                if len(s):
                    cls = set_number(s)
                    if keep is None:
                        known[cls] = s
                    elif cls not in known and cls in keep:
                        known[cls] = s
            if not known:
                continue
            n = np.array([len(s) for s in known.values()], dtype=np.int64)
            sent = first_size(n) if keep is None else n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([s[:k] for s, k in zip(known.values(), sent, strict=True)]).view(np.int64)),
                 pa.array(np.repeat(np.array(list(known), dtype=np.int64), sent)),
                 pa.array(np.repeat(n, sent).astype(np.int32))], names=["shingle", "cls", "n"])

    return docs.select("text").mapInArrow(run, "shingle bigint, cls bigint, n int")


def _sorted_rows(batches):
    """Sorted rows (shingle, cls, n) without repeats, in pieces that end with a shingle's last row or hold
    ``MOST_COUNTED`` rows of one shingle: (shingle, cls, n, whether the last shingle goes on)."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    last = None  # the last row handed out, if its shingle may go on
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
        new = np.ones(len(cols[0]), dtype=bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        if last is not None and len(new):
            new[0] = (cols[0][0], cols[1][0]) != last
        cols = [c[new] for c in cols]
        if not len(cols[0]):
            held = cols
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        going = False
        if len(cols[0]) - cut > MOST_COUNTED:
            cut, going = len(cols[0]), True
        if cut:
            yield (*(c[:cut] for c in cols), going)
            last = (cols[0][cut - 1], cols[1][cut - 1]) if going else None
        held = [c[cut:] for c in cols]
    if len(held[0]):
        yield (*held, False)


def _common(batches, every: bool):
    """Rows of shingles in two sets or more, with the number of sets (up to ``MOST_COUNTED``)."""
    open_ = None  # a frequent shingle that went on
    for shingle, cls, n, going in _sorted_rows(batches):
        heads = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        df = np.diff(np.append(heads, len(shingle)))
        if open_ is not None and shingle[0] == open_:
            df[0] = MOST_COUNTED
        open_ = shingle[-1] if going else None
        df = np.repeat(np.minimum(df, MOST_COUNTED), np.diff(np.append(heads, len(shingle))))
        kept = df > 1
        if kept.any():
            cols = [pa.array(cls[kept])]
            if every:
                cols += [pa.array(df[kept].astype(np.int32)), pa.array(shingle[kept]), pa.array(n[kept])]
            yield pa.RecordBatch.from_arrays(cols, names=["cls", "df", "shingle", "n"][:len(cols)])


def _gather(percent: int):
    """Sets (rows sorted by set, rarest shingle first) that may link: their shared shingles, and the rarest
    ones, one of which a partner must have."""
    def run(batches):
        held = None
        for b in _with_end(batches):
            cols = None if b is None else [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = held if cols is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            cut = len(cols[0]) if b is None else int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[cut:] for c in cols]
            cls, _, shingles, n = (c[:cut] for c in cols)
            if not cut:
                continue
            heads = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
            many = np.diff(np.append(heads, cut))
            spare = many - least_overlap(n[heads].astype(np.int64), percent)
            rows = [(int(cls[h]), int(n[h]), shingles[h:h + m], int(s)) for h, m, s in
                    zip(heads, many, spare, strict=True) if s >= 0]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([len(r[2]) for r in rows], pa.int64()),
                     pa.array([np.sort(r[2].view(_U)).tobytes() for r in rows], pa.binary()),
                     pa.array([r[2][:r[3] + 1] for r in rows], pa.list_(pa.int64()))],
                    names=["cls", "n", "shared", "shingles", "keys"])
    return run


def _with_end(batches):
    yield from batches
    yield None


class CountTree:
    """Packed R-tree over count vectors; the entries of a node lie together."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        self.percent = percent
        self.order = self._pack(np.column_stack([counts, sizes]))
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FANOUT:
            hi, least, most = self.levels[-1]
            at = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(hi, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    @staticmethod
    def _pack(points: np.ndarray) -> np.ndarray:
        """Halve along the widest coordinate until a node's worth is left."""
        out, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= FANOUT:
                out.append(rows)
                continue
            part = points[rows]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = max(FANOUT, len(rows) // 2 // FANOUT * FANOUT)  # nodes are full but for the last
            rows = rows[np.argsort(part[:, axis], kind="stable")]
            todo += [rows[half:], rows[:half]]
        return np.concatenate(out)

    def search(self, counts: np.ndarray, size: int) -> np.ndarray:
        """The entries that the summed minima allow to link with a point."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, least, most = self.levels[depth]
            bound = np.minimum(hi[nodes], counts).sum(axis=1)
            may = ((100 + self.percent) * bound >= self.percent * (size + least[nodes])) \
                & (100 * most[nodes] >= self.percent * size)
            nodes = nodes[may]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        return self.order[nodes]


class Cell:
    """Members of a cell: class numbers, sizes, shingles and the classes known so far."""

    def __init__(self, rows: list[tuple], percent: int) -> None:
        self.percent = percent
        self.cls = [r[0] for r in rows]
        self.n = np.array([r[1] for r in rows], dtype=np.int64)
        self.shingles = [np.frombuffer(r[2], _U) for r in rows]
        _, self.label = np.unique(np.array([r[3] for r in rows], dtype=np.int64), return_inverse=True)
        self.counts = np.array([np.bincount((s % _U(GROUPS)).astype(np.int64), minlength=GROUPS) for s in self.shingles],
                               dtype=np.int32)
        self.links: list[tuple[int, int]] = []

    def verify(self, i: int, j: int) -> None:
        """Link two members of different classes if their sets allow it."""
        a, b = self.shingles[i], self.shingles[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        if 100 * both >= self.percent * (int(self.n[i]) + int(self.n[j]) - both):
            self.links.append((self.cls[i], self.cls[j]))
            self.label[self.label == self.label[j]] = self.label[i]

    def join(self, tree_rows: list[int], probes: list[int]) -> list[tuple[int, int]]:
        """Verified links between probes and tree members that aren't in one class yet; they join the same classes as all."""
        members = np.array(tree_rows)
        tree = CountTree(self.counts[members], self.n[members], self.percent)
        near = members[tree.order]
        for i, j in zip(near, near[1:], strict=False):  # neighbours in the packing are often near copies
            if self.label[i] != self.label[j]:
                self.verify(i, j)
        for i in probes:
            if (self.label[members] == self.label[i]).all():
                continue
            for j in members[tree.search(self.counts[i], int(self.n[i]))]:
                if self.label[i] != self.label[j]:
                    self.verify(i, j)
        return self.links


def _join_cells(percent: int):
    """Links in cells: rows sorted by cell; role 0 is in the tree, role 1 only searches it (without any, the tree's own do)."""
    def run(batches):
        at, held = None, []

        def done():
            cell = Cell([r[1:] for r in held], percent)
            tree = [k for k, r in enumerate(held) if r[0] == 0]
            found = cell.join(tree, [k for k, r in enumerate(held) if r[0] == 1] or tree) if tree else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("root", "i", "j", "role", "cls", "n", "shingles", "comp")]
            for root, i, j, *row in zip(*cols, strict=True):
                if (root, i, j) != at:
                    if len(held) > 1:
                        yield done()
                    at, held = (root, i, j), []
                held.append(row)
        if len(held) > 1:
            yield done()
    return run


def cell_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links ``(a, b)`` in the cells of ``rows(root, i, j, role, cls, n, shingles, comp)``."""
    keys = ["root", "i", "j"]
    return (rows.select(*keys, "role", "cls", "n", "shingles", "comp").repartition(*keys)
            .sortWithinPartitions(*keys, "role", "cls").mapInArrow(_join_cells(percent), "a bigint, b bigint"))


def possible(docs: DataFrame, ids: DataFrame, words: int, percent: int) -> Members | None:
    """The sets of ``ids(cls, n)`` that their first shingles don't rule out; None if there are none."""
    rows = shingle_rows(docs, words)
    alive = (rows.repartition("shingle").sortWithinPartitions("shingle", "cls")
             .mapInArrow(lambda batches: _common(batches, False), "cls bigint")
             .groupBy("cls").agg(F.count("*").alias("alive")))
    sizes = ids.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"))
    first = F.least("n", F.ceil(F.col("n") * FIRST_SHARE) + FIRST_MORE)
    need = F.ceil(F.col("n") * percent / 100)
    left = stage(alive.join(sizes, "cls").where(first - F.col("alive") <= F.col("n") - need).select("cls"), "possible")
    n = left.count()
    return members(left, n) if n else None


def shared_sets(docs: DataFrame, only: Members, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(cls, n, shared, shingles, keys)`` of the sets of ``docs(text)`` in ``only`` that may link with another."""
    rows = shingle_rows(docs, words, only)
    common = (rows.repartition("shingle").sortWithinPartitions("shingle", "cls")
              .mapInArrow(lambda batches: _common(batches, True), "cls bigint, df int, shingle bigint, n int"))
    return (common.repartition("cls").sortWithinPartitions("cls", "df", "shingle")
            .mapInArrow(_gather(percent), "cls bigint, n bigint, shared bigint, shingles binary, keys array<bigint>"))


def links(docs: DataFrame, ids: DataFrame, words: int = WORDS, percent: int = PERCENT, cell_rows: int = CELL_ROWS,
          cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Links ``(a, b)`` of set numbers that join the same classes as all links of ``docs(text)``; ``ids``: ``sets(docs)``."""
    only = possible(docs, ids, words, percent)
    if only is None:
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    found = stage(shared_sets(docs, only, words, percent), "shared-sets")
    keyed = found.select("cls", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    groups = connected_components(keyed.join(low.select("key", "low"), "key").where("cls <> low")
                                  .select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct())
    sized = found.drop("keys").join(groups.withColumnRenamed("node", "cls"), "cls")
    sizes = sized.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / cell_rows), F.ceil(F.sum("shared") / cell_shingles)).cast("int").alias("cells"))
    own = F.pmod(F.xxhash64("cls"), F.col("cells")).cast("int")
    dealt = stage(sized.join(sizes, "root").withColumn("i", own), "groups")
    first = stage(cell_links(dealt.select("root", "i", F.lit(0).alias("j"), F.lit(0).alias("role"), "cls", "n", "shingles",
                                          F.col("cls").alias("comp")), percent), "cell-links")
    large = dealt.where("cells > 1")
    if large.isEmpty():
        return first

    def classed(known: DataFrame) -> DataFrame:
        comps = connected_components(known).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
        return large.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def largest(rows: DataFrame, *keys: str) -> DataFrame:
        sized = rows.groupBy(*keys, "comp").agg(F.count("*").alias("members"))
        return sized.groupBy(*keys).agg(F.max_by("comp", F.struct("members", "comp")).alias("comp"))

    now = classed(first)
    heads = largest(now, "root", "i").select("root", F.col("comp").alias("cls"))
    leaders = now.join(heads, ["root", "cls"])
    second = stage(first.union(cell_links(leaders.select(
        "root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role"), "cls", "n", "shingles", "comp"),
        percent)), "leader-links")
    now = stage(classed(second), "classed")
    main = largest(now, "root").withColumnRenamed("comp", "main")
    rest = now.join(main, "root").where("comp <> main").drop("main")
    if rest.isEmpty():
        return second
    shares = rest.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / cell_rows), F.ceil(F.sum("shared") / cell_shingles)).cast("int").alias("shares"))
    body = ["cls", "n", "shingles", "comp"]
    trees = now.join(shares, "root").select(
        "root", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("i"), F.col("i").alias("j"),
        F.lit(0).alias("role"), *body)
    probes = rest.join(shares, "root").select(
        "root", F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("j"), F.lit(1).alias("role"), *body)
    return second.union(stage(cell_links(trees.unionByName(probes), percent), "rest-links"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cell_rows: int = CELL_ROWS,
                    cell_shingles: int = CELL_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; ``component_id`` is the smallest doc_id of its class."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = stage(sets(docs, words), "sets")
    parts = connected_components(links(docs, ids, words, percent, cell_rows, cell_shingles))
    first = ids.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_doc"))
    rooted = (first.join(parts.withColumnRenamed("node", "cls"), "cls", "left")
              .select("cls", "first_doc", F.coalesce("root", "cls").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = rooted.join(named, "root").select("cls", "component_id")
    return (ids.join(classes, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
