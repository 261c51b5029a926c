"""Whitening, conversation repair and the n-gram Jaccard join against plain versions; their edge cases."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import jaccard, repair, whitening
from cohortlens.llm import queries as q
from cohortlens.llm.common import read_table
from tests.conftest import SF001, SF0001
from tests.llm import brute

VECTORS = "vec_id bigint, embedding array<float>, label int"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def rows_of(sf, table, cols):
    return duckdb.sql(f"SELECT {cols} FROM '{sf}/{table}.parquet'").fetchall()


# --- whitening ---------------------------------------------------------------

def same_whitening(got, want, tol=1e-9):
    sign = {}
    assert Counter((r.vec_id, r.component) for r in got) == Counter(want.keys())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, deviation, value, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained)
        sign.setdefault(r.component, math.copysign(1, r.whitened * value))
        assert r.whitened == pytest.approx(sign[r.component] * value, abs=tol)


def test_whitening_query(spark):
    got = q.op11_embedding_whitening(spark, SF001).collect()
    same_whitening(got, brute.whitened(rows_of(SF001, "embeddings", "vec_id, embedding")))


def test_whitening_edges(spark):
    """Copies fit once; null, empty, non-finite and odd-length vectors take no part; small blocks and parts agree."""
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=3) * (3, 2, 1)], 1) for i in range(40)]
    copies = [(100 + i, good[0][1], 1) for i in range(30)]
    bad = [(200, None, 1), (201, [], 1), (202, [1.0, None, 2.0], 1), (203, [1.0, math.nan, 2.0], 1),
           (204, [1.0, math.inf, 0.0], 1), (205, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + copies + bad, VECTORS).withColumn("x", F.lit(1)).withColumn("n", F.lit("?"))
    want = brute.whitened([(i, [float(np.float32(c)) for c in v]) for i, v, _ in good + copies], k=3)
    same_whitening(whitening.whiten(df.repartition(3)).collect(), want)
    same_whitening(whitening.whiten(df.repartition(3), block_rows=4, part_rows=8).collect(), want)
    repeated = whitening.whiten(df.union(df)).collect()
    assert len(repeated) == 2 * len(want) and {r.n for r in repeated} == {40}
    assert whitening.whiten(df.where("vec_id >= 100")).collect() == []  # one distinct vector: nothing varies
    assert whitening.whiten(df.limit(0)).collect() == []
    flat = whitening.whiten(df.select("vec_id", F.transform("embedding", lambda c: c).alias("embedding"))
                            .where("vec_id < 40").withColumn("embedding", F.array(F.col("embedding")[0], F.lit(1.0))))
    assert {r.component for r in flat.collect()} == {1}  # a dimension without variance can't be whitened


def test_whitening_huge_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert got and all(r.n == 3 for r in got) and {r.deviation for r in got if r.vec_id == 1} == {None}


# --- conversation repair ------------------------------------------------------

def same_repair(df, rows, change, shift):
    got = {r[0]: tuple(r)[1:] for r in repair.repair_all(df, change, shift).collect()}
    groups = defaultdict(list, {c: [] for c in {r[0] for r in rows}})
    after = brute.damaged(rows) if change is repair.damage else \
        [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for c, *row in after:
        groups[c].append(tuple(row))
    assert got == {c: brute.repaired(v) for c, v in groups.items()}


def test_repair_query(spark):
    rows = rows_of(SF001, "conversations", "conv_id, turn, role, text")
    same_repair(read_table(spark, SF001, "conversations"), rows, repair.damage, repair.SHIFT)
    got = q.op12_conversation_repair(spark, SF001)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.count() == len({r[0] for r in rows})


@pytest.mark.parametrize("shift", [0, 2, 12])
def test_repair_edges(spark, shift):
    """Nulls, ties, repeats, odd roles, clashing columns; blocks of 1, 4 and 4,096 rows give the same."""
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 5, 5, 5]), rng.choice([None, *range(12)]),
             rng.choice([None, "", "user", "assistant", "system", "tool", "u", "User"]),
             rng.choice([None, "", " ", "a.", "b", "c!\n", "d ", "e. ", "ok? "])) for _ in range(500)]
    df = spark.createDataFrame(rows, TURNS).withColumn("n", F.lit("x")).withColumn("seq", F.lit(1)).repartition(3)
    same_repair(df, rows, repair.plain, shift)
    same_repair(df, rows, repair.damage, shift)


def test_repair_long_conversation(spark):
    """A conversation over many blocks; one row repeated often; an empty table; a turn range beyond a long."""
    rng = random.Random(2)
    rows = [(1, i // 2, rng.choice(["user", "user", "assistant", "system"]), f"{i}{rng.choice(['', '.', '.'])}")
            for i in range(2500)] + [(2, 0, "user", "same.")] * 300
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    same_repair(df, rows, repair.plain, 5)
    assert repair.repair_all(df.limit(0)).collect() == []
    wide = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], TURNS)
    assert [r.gaps for r in repair.repair_all(wide).collect()] == [(1 << 63) - 1]


def test_repair_walk_keeps_few_vectors():
    """The backward vectors kept are those of every sqrt(n)-th row; the walk is the plain programme's."""
    rng = random.Random(5)
    codes = [4 * rng.randrange(4) + rng.choice([0, 0, 3]) for _ in range(400)]
    steps = repair.Steps()
    edits = "".join(e for e, _ in repair.walk(codes, 0, list(repair.FINAL), steps))
    texts = [(i, "sua-"[c >> 2] + "x", f"{i}" + ("" if c & 3 else ".")) for i, c in enumerate(codes)]
    audit = brute.repaired(texts)[6]
    assert audit.startswith(edits) and set(audit[len(edits):]) <= {"I"}


# --- n-gram Jaccard join -------------------------------------------------------

def found(df, **how):
    return Counter(tuple(r) for r in jaccard.near_duplicates(df, **how).collect())


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_jaccard_query(spark, sf):
    want = brute.jaccard_classes(rows_of(sf, "documents", "doc_id, text"))
    got = q.op13_ngram_jaccard_join(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.fixture(scope="module")
def family():
    """Groups of near copies on both sides of the threshold, short texts, copies and blanks."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 6, 40, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(400):
        b = list(rng.choice(base[:4] if i % 3 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(words).upper()
        rows.append((i, rng.choice([" ", "\n"]).join(b) if i % 40 else rng.choice([None, "", " "])))
    return rows


@pytest.mark.parametrize("how", [{}, {"cell_rows": 20}, {"cell_rows": 7, "cell_shingles": 500}])
def test_jaccard_cells(spark, family, how):
    """Groups in one cell and in many give the links of the plain version."""
    df = spark.createDataFrame(family, "doc_id bigint, text string").withColumn("cls", F.lit("x")).repartition(4)
    assert found(df, **how) == brute.jaccard_classes(family)


def test_jaccard_frequent_shingles_are_counted_in_pieces():
    """Rows of a shingle that goes on over batches and beyond the count: repeats dropped, none lost."""
    import pyarrow as pa
    old, jaccard.MOST_COUNTED = jaccard.MOST_COUNTED, 5
    try:
        rng = random.Random(2)
        rows = sorted([(s, c, 9) for s, k in ((1, 1), (2, 2), (3, 40), (4, 5), (5, 6), (6, 1), (7, 23)) for c in range(k)
                       for _ in range(rng.choice([1, 1, 3]))])
        for size in (1, 3, 7, 500):
            batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at:at + size]], t) for i, t in
                                                   enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["shingle", "cls", "n"])
                       for at in range(0, len(rows), size)]
            got = [tuple(r.values()) for b in jaccard._common(iter(batches), True) for r in b.to_pylist()]
            want = Counter((c, s) for s, c, _ in set(rows) if s not in (1, 6))
            assert Counter((c, s) for c, _, s, _ in got) == want
            assert {s: max(d for _, d, t, _ in got if t == s) for s in (2, 3, 4, 5, 7)} == {2: 2, 3: 5, 4: 5, 5: 5, 7: 5}
    finally:
        jaccard.MOST_COUNTED = old


def test_jaccard_edges(spark):
    """Null ids, repeated rows, the threshold itself, long texts, an empty table."""
    rng = random.Random(7)
    nine = [f"a{i}" for i in range(13)]  # 9 shingles; one word more on one side: 9 of 10
    edge = [f"b{i}" for i in range(12)]  # 8 shingles; two words more: 8 of 10, which links; three more: 8 of 11, which doesn't
    long = [rng.choice(nine + edge) + str(rng.randrange(999)) for _ in range(60_000)]
    changed = list(long)
    changed[30_000] = "else"
    rows = [(1, " ".join(nine)), (2, " ".join([*nine, "x"])), (3, " ".join(edge)), (4, " ".join([*edge, "x", "y"])),
            (5, " ".join([*edge, "p", "q", "r"])), (6, " ".join(long)), (7, " ".join(changed)), (9, "One two"), (8, "one TWO"),
            (8, "one TWO"), (10, "one"), (11, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == brute.jaccard_classes(rows)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == {
        1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 11}
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (None, "q"), (None, None)],
                                  "doc_id bigint, text string")
    assert found(nulls) == Counter({(None, 2, 5): 2, (5, 2, 5): 1, (None, 1, None): 1, (None, 0, None): 1})
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_jaccard_shingles_far_between():
    """Blocks of a long text give the shingles that cross them; the R-tree drops no pair that links."""
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in range(400_000))
    assert len(jaccard.shingle_set(text)) == 399_996
    counts = rng.integers(0, 9, size=(300, jaccard.GROUPS)).astype(np.int32)
    counts[150:] = counts[:150]
    counts[150:, :3] += 1
    sizes = counts.sum(axis=1)
    tree = jaccard.CountTree(counts, sizes, 80)
    for i in range(300):
        may = {j for j in range(300) if 180 * int(np.minimum(counts[i], counts[j]).sum()) >= 80 * int(sizes[i] + sizes[j])}
        hit = set(tree.search(counts[i], int(sizes[i])).tolist())
        assert may <= hit and i in hit


def test_components_in_one_task_and_in_rounds(spark):
    from cohortlens.llm.common import connected_components
    rng = random.Random(9)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = [sorted(map(tuple, connected_components(df, few=n).collect())) for n in (0, 1 << 18)]
    assert got[0] == got[1] and {r for n, r in got[0] if n >= 1000} == {1000}
    assert connected_components(df.limit(0)).collect() == []
