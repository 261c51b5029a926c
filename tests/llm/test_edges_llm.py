"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import time
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import ann, bpe, common, html_text, langid, licenses, mixing, simhash, sketch, substr, toxicity
from cohortlens.llm.queries import VOCABULARY
from tests.llm import brute

rng = random.Random(4)
VOCAB = [f"w{i}" for i in range(400)] + ["été", "日本", "a"]
TEXT = [" ".join(rng.choice(VOCAB) for _ in range(n)) for n in (80, 120, 60, 300)]
LONG = " ".join(rng.choice(VOCAB) for _ in range(30_000)) + " " + "x" * 5000
NEAR = TEXT[3].replace(TEXT[3].split()[150], "changed", 1)

#: (doc_id, text, lang, source, toxic note in a clashing column)
ROWS = [(0, TEXT[0], "en", "a"), (1, TEXT[0], "en", "b"), (2, None, None, None), (3, "", "de", "a"),
        (4, " \t\n ", "de", "a"), (5, "One", "en", "b"), (6, "one", "en", "b"), (7, TEXT[1] + " " + TEXT[2], "en", "a"),
        (8, TEXT[2] + " " + TEXT[1], "en", "c"), (9, LONG, "en", "a"), (9, LONG, "en", "a"), (None, TEXT[3], "en", "c"),
        (11, NEAR, "fr", None), (12, TEXT[3], "fr", None), (13, "same " * 90, "fr", "c"),
        (14, "Ünïcode\x85 blank　kept too", "fr", "d"), (15, "...", None, "d")]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows as above, with columns that clash with what the operators add."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    extra = {c: F.lit("x") for c in ("n_words", "kept_text", "ids", "decoded", "score", "predicted", "lang_pred", "row",
                                     "chunk", "fp", "size", "word", "th", "numbered")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars bigint")


def test_simhash(docs, empty):
    got = defaultdict(list)
    for r in simhash.near_duplicates(docs).collect():
        got[r.doc_id].append((r.fingerprint, r.component_id))
    prints = [brute.simhash(t) for _, t, *_ in ROWS]
    roots = brute.classes(prints)
    names = {}
    for (i, *_), root in zip(ROWS, roots, strict=True):
        if i is not None:
            names[root] = min(names.get(root, i), i)
    want = defaultdict(list)
    for (i, *_), p, root in zip(ROWS, prints, roots, strict=True):
        want[i].append((f"{p:016x}", names.get(root)))
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(names.values()))
    assert simhash.one_of_each(empty).count() == 0


def test_simhash_links_in_crowded_shards(spark):
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 400:
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    from cohortlens.llm.common import connected_components
    parts = {r.node: r.root for r in connected_components(simhash.links(df, 2, shard_size=16)).collect()}
    by_root, by_brute = defaultdict(set), defaultdict(set)
    for p, s, root in zip(prints, signed, brute.classes(prints), strict=True):
        by_root[parts.get(s, s)].add(p)
        by_brute[root].add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_brute.values()))


def test_substring(docs, empty):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substr.remove_repeats(docs).collect())
    want = Counter()
    for (i, t, *_), (n, gone, kept) in zip(ROWS, brute.without_repeats([t for _, t, *_ in ROWS]), strict=True):
        want[i, n, gone, None if t is None else kept] += 1
    assert got == want
    small = substr.remove_repeats(docs, window=5, k=2, chunk_bytes=500)  # many chunks, short windows
    got = Counter((r.doc_id, r.n_removed) for r in small.collect())
    assert got == Counter((i, gone) for (i, *_), (_, gone, _) in
                          zip(ROWS, brute.without_repeats([t for _, t, *_ in ROWS], 5), strict=True))
    assert substr.remove_repeats(empty).count() == 0


def test_substring_random(spark):
    """A tiny vocabulary: windows recur everywhere, in unlike surroundings, and overlap themselves."""
    r = random.Random(8)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(["a"] * n) for n in (6, 7, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for window, k in ((7, 3), (12, 4)):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text)
               for x in substr.remove_repeats(df, window=window, k=k, chunk_bytes=700).collect()}
        assert [got[i] for i in range(len(texts))] == brute.without_repeats(texts, window)


def test_substring_spreads_repeated_rows(spark, monkeypatch):
    """Wholly repeated rows, and copies without an id, don't meet in one task."""
    cover = substr._cover

    def watched(window, k, names):
        inner = cover(window, k, names)

        def run(texts, info):
            if texts.num_rows > 60:
                raise ValueError(f"{texts.num_rows} rows in a chunk")
            return inner(texts, info)
        return run

    monkeypatch.setattr(substr, "_cover", watched)
    for one in ((1, TEXT[0]), (None, TEXT[0])):
        rows = [one] * 300 + [(i, TEXT[1] + f" {i}") for i in range(2, 4)] + [(5, TEXT[2])]
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        got = Counter((x.doc_id, x.n_words, x.n_removed, x.kept_text)
                      for x in substr.remove_repeats(df, chunk_bytes=20 * len(TEXT[0])).collect())
        assert got == Counter((i, *x) for (i, _), x in zip(rows, brute.without_repeats([t for _, t in rows]), strict=True))


def test_mixing(docs, empty):
    rows = mixing.mix_sizes(docs).collect()
    sizes = Counter({s: 0 for *_, s in ROWS})
    for _, t, _, s in ROWS:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len(brute.words(t))) for i, t, *_ in ROWS)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    names = {i: s for i, _, _, s in ROWS}
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[names[r.doc_id]]) and r.source_size == sizes[names[r.doc_id]]
        taken[names[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1.5 * mixing.BLOCK
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sizes(docs).collect()))
    texts = mixing.mix_texts(docs)
    assert texts.columns == docs.columns
    told = Counter()
    for r in texts.collect():
        assert r.n_chars == len(r.text)
        told[r.doc_id] += len(brute.words(r.text))
    summed = Counter()
    for r in rows:
        summed[r.doc_id] += r.taken
    assert +told == +summed
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix_texts(empty).count() == 0


def test_mix_in_drawn_order(docs, empty):
    """The blocks by shard and slot are the mix that the sizes tell of."""
    rows = mixing.mix_slots(docs, block=16, shard=100).collect()
    by_slot, by_doc, sources, shards = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for r in rows:
        shards[r.shard].add(r.slot)
        by_slot[r.shard, r.slot] += r.words
        by_doc[r.doc_id] += r.words
        sources[r.shard, r.slot].add((r.source, r.block))
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and len(shards) > 10
    assert all(len(x) == 1 for x in sources.values())
    assert {s for n in range(3) for s in [next(iter(sources[n, 0]))[0]]} <= {"a", "b", "c", "d", None}
    assert max(by_slot.values()) <= 16
    taken = Counter()
    for r in mixing.mix_sizes(docs, block=16, shard=100).collect():
        taken[r.doc_id] += r.taken
    assert +by_doc == +taken
    assert mixing.mix_slots(empty).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1023):
        df = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n), F.lit(3)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_shard_draws_keep_the_targets(spark):
    """Counts by shard and source sum up to each source's units, and vary as a multinomial does."""
    sizes = spark.createDataFrame([("a", 640_000, 1), ("b", 160_000, 2), (None, 64_000, 1)],
                                  "source string, size bigint, copies bigint")
    plan = mixing._plan(mixing.source_targets(sizes), 64)
    units = {r.sid: r.units for r in plan.collect()}
    drawn = mixing.shard_counts(plan, shard=100).collect()
    by_shard, by_source, of_first = Counter(), Counter(), []
    for r in drawn:
        by_shard[r.shard] += r.slots
        by_source[r.sid] += r.slots
        of_first += [r.slots] * (r.sid == 0)
    assert dict(by_source) == units
    mean = units[0] / len(by_shard)
    spread = sum((x - mean) ** 2 for x in of_first) / len(of_first)
    assert len(by_shard) == -(-sum(units.values()) // 100) and 0.5 * mean < spread < 2 * mean
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mixing.shard_counts(plan, shard=100).collect()))


def test_the_draw_decides_what_is_taken(docs):
    """Changing one shard's counts changes what the query's path takes, by the words of the slots changed."""
    sizes = mixing._sizes(docs.select("doc_id", "source", "text"))
    plain = mixing.sizes_taken(sizes, 16, 100)
    fewer = mixing.sizes_taken(sizes, 16, 100, lambda counts: counts.where("shard <> 3"))
    gone = mixing._drawn(sizes, 16, 100)[2].where("shard = 3").agg(F.sum("slots")).first()[0]
    a, b = (df.agg(F.sum("taken")).first()[0] for df in (plain, fewer))
    assert gone > 50 and 15 * gone < a - b <= 16 * gone


def test_mixing_spreads_repeated_rows(spark):
    """300 rows alike in every column: each a document of its own, in several buckets, and mixed like any other."""
    rows = [(7, TEXT[0], "en", "a", 5)] * 300 + [(100 + i, TEXT[1] + f" {i}", "en", "b", 5) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_chars bigint").repartition(4)
    old = mixing.BUCKET
    mixing.BUCKET = 64
    try:
        got = mixing.mix_sizes(df).collect()
        sizes = mixing._sizes(df)
        placed = mixing.pack(sizes, mixing.source_targets(sizes)).select("row", "dup", "start").distinct().collect()
        told = Counter()
        for r in mixing.mix_texts(df).collect():
            told[r.doc_id] += len(brute.words(r.text))
    finally:
        mixing.BUCKET = old
    assert Counter(r.doc_id for r in got)[7] == 300 and all(r.taken <= 3 * r["size"] for r in got)
    hot = Counter(r.row for r in placed).most_common(1)[0][0]
    copies = sorted((r.start, r.dup) for r in placed if r.row == hot)
    assert len(placed) == 340 and len({s for s, _ in copies}) == 300
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    assert +told == +taken
    mixed = [d for _, d in copies]
    assert mixed != sorted(mixed)  # copies lie in buckets by number, not in one run


def test_neighbours(spark):
    r = random.Random(2)
    vectors = [[r.gauss(0, 1) for _ in range(8)] for _ in range(200)]
    vectors[10] = vectors[20] = vectors[30] = vectors[0]  # ties
    vectors[40], vectors[41], vectors[42], vectors[43], vectors[44] = None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4
    vectors[45] = [float("inf")] + [1.0] * 7
    vectors[46] = [1.0] * 5  # another length
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(0, vectors[0], "x"), (None, vectors[1], "x")]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField(
        "embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])).repartition(3)
    exact = [(i, v) for i, v in ((x.vec_id, x.embedding) for x in df.orderBy("vec_id").collect())
             if i is not None and i != 46]
    exact = list({i: (i, v) for i, v in exact}.values())
    got = defaultdict(list)
    for x in ann.search(df, F.col("vec_id") % 20 == 0, k=5, centroids=4, chunk=16, group=2).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    ids, vs = [i for i, _ in exact], [v for _, v in exact]
    found = total = 0
    for q in range(0, 200, 20):
        want = brute.nearest(ids, vs, ids.index(q))
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        found, total = found + len({m[1] for m in mine} & set(want)), total + len(want)
    assert found >= 0.9 * total
    assert [m[1] for m in sorted(got[0])][:3] == [10, 20, 30]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    two = df.where("vec_id in (1, 2)").dropDuplicates(["vec_id"])
    assert sorted((x.query_id, x.vec_id) for x in ann.search(two, F.lit(True)).collect()) == [(1, 2), (2, 1)]


def test_neighbours_of_repeated_ids(spark):
    """Rows given again change nothing; an id with many vectors takes one place, with its best score."""
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    found = lambda rows: sorted(map(tuple, ann.search(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3),
        F.col("vec_id") % 20 == 0, k=5, centroids=3, chunk=32, group=4).collect()))
    once = found(rows)
    assert len(once) == 6 * 5
    assert found(rows * 6) == once
    assert found(rows + [rows[20]] * 150 + [rows[7]] * 150) == once
    many = [(7, [x + r.gauss(0, 0.01) for x in rows[20][1]]) for _ in range(90)]  # all near query 20
    many += [(40, [r.gauss(0, 1) for _ in range(8)]) for _ in range(40)]  # a query of many vectors
    got = defaultdict(dict)
    for q, rank, i, score in found(rows + many):
        got[q][rank] = (i, score)
    import numpy as np
    unit = lambda q: np.array([np.array(v) / np.linalg.norm(v) for i, v in rows + many if i == q])
    for q in range(0, 120, 20):
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and len({i for i, _ in got[q].values()}) == 5
        for i, score in got[q].values():
            assert i != q and score <= (unit(q) @ unit(i).T).max() + 1e-12
    best = (unit(20) @ unit(7).T).max()
    assert got[20][1] == (7, pytest.approx(best, abs=1e-12))


def test_html():
    assert html_text.extract_text(None) is None and html_text.extract_text("") == ""
    assert html_text.extract_text("plain & text") == "plain & text"
    cases = {
        "<p>a<p>b": "a\n\nb", "a<br>b": "a\nb", "<div>x</div><div>y</div>": "x\ny",
        "<ul><li>a<li>b<ol start=3><li>c</ol></ul>": "- a\n- b\n  3. c",
        "<table><tr><th>Name<th>N<tr><td>long<td>22</table>": "Name | N\nlong | 22",
        "<table><tr><td rowspan=2>q<td>r<tr><td>s</table>": "q | r\n  | s",
        "<style>p{}</style><script>'</p>'</script><p hidden>no<p style='display: none'>no</p>yes": "yes",
        "<pre>\n a\n  b</pre>": " a\n  b", "&lt;b&gt; &amp;amp; &eacute;": "<b> &amp; é",
        "<b>bold <i>both</b> rest": "bold both rest", "<!-- <p>no --><p>yes": "yes", "a < b and <3": "a < b and <3",
        "<select><option>one<option>two</select>": "one\ntwo", "<details><summary>s</summary>hid</details>": "s",
        "<p>日本<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>": "日本\n\n日本 | x\nabcd | y", "</p>x</div>y": "xy",
        "<p title='a>b'>t": "t", "<textarea><b>raw</textarea>": "<b>raw", "<svg><text>no</text></svg>ok": "ok",
    }
    assert {k: html_text.extract_text(k) for k in cases} == cases
    deep = "<div>" * 5000 + "<ul><li>" * 3000 + "bottom"
    assert "bottom" in html_text.extract_text(deep)
    many = "<p>word</p>" * 20_000
    assert html_text.extract_text(many).count("word") == 20_000


def test_html_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "x"), (None, "", "x"), (1, "<p>a", "x")],
                               "page_id bigint, html string, text string")
    assert Counter((r.page_id, r.text) for r in html_text.extract(df).collect()) == Counter(
        [(1, None), (1, "a"), (None, ""), (1, "a")])
    assert html_text.extract(df.limit(0)).count() == 0


def test_sketches(docs, empty):
    rows = sketch.fingerprint_edits(docs).collect()
    assert len(rows) == len(ROWS)
    order = sorted({(i, t or "") for i, t, *_ in ROWS}, key=lambda x: (x[0] is not None, x[0] or 0))
    after = {x: order[(n + 1) % len(order)] for n, x in enumerate(order)}
    want = Counter()
    for i, t, *_ in ROWS:
        t = t or ""
        k = len(t) // 4
        want[i, len(t), t[:len(t) - k] + after[i, t][1][:k]] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_text) for r in rows) == want
    assert sketch.fingerprint_edits(empty).count() == 0


def test_sketch_likeness(spark):
    a = " ".join(rng.choice(VOCAB) for _ in range(6000))
    b = " ".join(a.split()[:4000])  # inside a
    pairs = [(a, a), (a, b), (b, a), ("", ""), ("", a), (None, ""), ("x y", "x y"), ("x y", "y x"), (TEXT[0], TEXT[1])]
    df = spark.createDataFrame(pairs, "x string, y string").withColumns(
        {"p": sketch.sketch(F.col("x")), "q": sketch.sketch(F.col("y"))})
    got = df.select(sketch.likeness(F.col("p"), F.col("q")), sketch.containment(F.col("p"), F.col("q")),
                    sketch.fingerprint(F.col("p")) == sketch.fingerprint(F.col("q")),
                    sketch.likeness(sketch.merge(F.col("p"), F.col("q")), F.col("p")), F.size("p")).collect()
    for (x, y), (like, inside, same, _, size) in zip(pairs, got, strict=True):
        s, t = brute.shingles(x), brute.shingles(y)
        assert like == pytest.approx(brute.jaccard(s, t), abs=0.08)
        assert inside == pytest.approx(len(s & t) / len(s) if s else float(s == t), abs=0.08)
        assert same == ((x or "") == (y or ""))
        assert (size > 0) == bool(s)
    assert got[1][3] == 1.0  # b's sketch adds nothing to a's


@pytest.mark.parametrize("n", [100, 256, 257, 2000])
def test_sketch_keeps_one_fraction_at_every_length(spark, n):
    """The kept hashes are those below the fraction and the least, of short and long texts alike."""
    text = " ".join(f"t{i}" for i in range(n + 4))
    df = spark.createDataFrame([(text,)], "t string")
    every = df.select(sketch.sketch(F.col("t"), scale=1)).first()[0]
    kept = df.select(sketch.sketch(F.col("t"))).first()[0]
    most = -(1 << 63) + (1 << 64) // sketch.SCALE
    assert len(every) == n and kept == [h for h in every if h < most or h == every[0]]


def test_sketch_merge_of_unequal_texts(spark):
    """Containment of a passage in the merged sketches of a short and a long text."""
    r = random.Random(21)
    short, long = (" ".join(r.choice(VOCAB) for _ in range(n)) for n in (200, 8000))
    passage = " ".join(long.split()[3000:3200])
    df = spark.createDataFrame([(short, long, passage, "ein Satz")], "s string, l string, p string, t string").select(
        *(sketch.sketch(F.col(c)).alias(c) for c in "slpt"), sketch.sketch(F.lit("")).alias("none"))
    s, l, p, t, none = map(F.col, df.columns)  # noqa: E741
    both, back = sketch.merge(s, l), sketch.merge(l, s)
    got = df.select(sketch.containment(p, both), sketch.containment(s, both), sketch.containment(p, back),
                    sketch.containment(l, both), sketch.likeness(both, l), sketch.fingerprint(both) == sketch.fingerprint(back),
                    sketch.containment(s, sketch.merge(s, none)), sketch.containment(p, sketch.merge(both, none)),
                    sketch.merge(t, none) == t, sketch.merge(sketch.merge(t, l), s) == sketch.merge(t, both)).first()
    assert got[:4] == (1.0,) * 4
    assert got[4] == pytest.approx(brute.jaccard(brute.shingles(short) | brute.shingles(long), brute.shingles(long)), abs=0.02)
    assert got[5:] == (True, 1.0, 1.0, True, True)


def test_sketch_time_grows_with_the_text(spark):
    """A text of 100,000 words, where a pass over all hashes for each hash takes minutes."""
    df = spark.createDataFrame([(" ".join(f"t{i}" for i in range(100_000)), "ein Satz")], "t string, s string")
    began = time.monotonic()
    most, sizes = F.lit(-(1 << 63) + (1 << 64) // sketch.SCALE), []
    for s in (sketch.sketch(F.col("t")), sketch.merge(sketch.sketch(F.col("t")), sketch.sketch(F.col("s")))):
        sizes += df.select(s.alias("s")).select(F.size("s"), F.expr("s = sort_array(s)"), F.array_max("s") < most).first()
    assert sizes[0] <= sizes[3] <= sizes[0] + 1 and sizes[0] == pytest.approx(99_996 / sketch.SCALE, rel=0.05)
    assert sizes[1:3] == sizes[4:] == [True, True]
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("text", ["x y", "", None, "a b c d e f"])
def test_sketch_of_few_shingles_keeps_the_least(spark, text):
    """Where no hash is below the fraction, the least is kept, in merged sketches too."""
    df = spark.createDataFrame([(text,)], "t string")
    every, kept, both = df.select(sketch.sketch(F.col("t"), scale=1), sketch.sketch(F.col("t"), scale=1 << 40),
                                  sketch.merge(sketch.sketch(F.col("t"), scale=1 << 40),
                                               sketch.sketch(F.lit("")), scale=1 << 40)).first()
    assert kept == both == every[:1]


def test_sketches_put_repeated_rows_together(spark):
    """300 rows alike are sketched once, before the shuffle, and each give a row."""
    rows = [(7, TEXT[0])] * 300 + [(i, TEXT[1] + f" {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sketch.fingerprint_edits(df)
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in rows)
    assert len({(r.edited_text, tuple(r.sketch), tuple(r.next_sketch)) for r in got.where("doc_id = 7").collect()}) == 1


def _encoding():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty):
    plain = _encoding()
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in
                  bpe.encode_decode(docs, VOCABULARY, public_tokenizers.PATTERN, block=50).collect())
    assert got == Counter((i, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in ROWS)
    assert bpe.encode_decode(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces():
    import regex
    plain, encoder = _encoding(), bpe.Encoder(bpe.PairTable(bpe.read_ranks(VOCABULARY)))
    find = regex.compile(public_tokenizers.PATTERN).findall
    parts = ["a", "th", "é", "日本", "😀", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "1", "²", "!!", "́",
             "=" * 70, "ab" * 400, "\x00", "<|endoftext|>", "z" * 3000]
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        ids = encoder.encode(find(text))
        assert ids.tolist() == plain.encode_ordinary(text)
        assert bpe.decode(encoder.tokens, ids) == text.encode()
    with pytest.raises(IndexError):
        bpe.decode(encoder.tokens, [10**6])


def test_samples_keep_their_share_at_any_count(spark):
    """About ``sample`` of n hashes lie below the bound, at counts far over 2^32 too, and all of few."""
    for n in (1, 4000, 4001, 1 << 33, 10**13):
        assert common.share_below(4000, n) == min(1 << 62, (4000 << 62) // n) > 0
    hashes = spark.range(100_000).select(common.hash62("id").alias("h"))
    assert abs(hashes.where(F.col("h") < common.share_below(4000, 100_000)).count() - 4000) < 300
    assert hashes.where(F.col("h") < common.share_below(4000, 3)).count() == 100_000


def test_languages(docs, empty, spark):
    train = spark.createDataFrame([("the cat and the dog went home " * 5, "en"), ("der hund und die katze sind da " * 5, "de"),
                                   (None, "fr"), ("x", None), ("", "es")], "text string, lang string")
    filters = langid.learn(train, min_share=0.001)
    test = spark.createDataFrame([(1, "the dog and the cat"), (2, "die katze und der hund"), (3, None), (4, "12 !?"),
                                  (5, "the dog " * 200_000), (1, "the dog and the cat"), (None, "und die")],
                                 "doc_id bigint, text string").withColumn("score", F.lit("x"))
    got = Counter((r.doc_id, r.lang_pred) for r in langid.identify(test, filters).collect())
    assert got == Counter([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (1, "en"), (None, "de")])
    assert langid.identify(empty, filters).count() == 0
    none = langid.learn(train.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, none).collect()} == {("und", 0.0)}


def test_language_sample_counts_a_text_once(spark):
    """Copies of a text weigh nothing: the filters are those of the distinct texts."""
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {lang: ["".join(r.choice(letters) for _ in range(6)) for _ in range(50)] for lang in ("l1", "l2")}
    rows = [(" ".join(r.choice(words[lang]) for _ in range(30)), lang) for lang in words for _ in range(60)]
    copy = [("zzzz qqqq " * 40, "l1")]
    learn = lambda rows, **a: langid.learn(
        spark.createDataFrame(rows, "text string, lang string").repartition(4), min_share=0.001, **a)
    once, often = learn(rows + copy), learn(rows + copy * 3000)
    assert once.names == often.names and (once.table == often.table).all()
    # a part of the texts: the same ones, whatever their copies
    few, many = learn(rows, sample=20), learn(rows * 5, sample=20)
    assert (few.table == many.table).all()


def test_filters_hold_many_languages():
    import numpy as np
    r = random.Random(1)
    own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(130)]
    grams = {f"l{i:03d}": np.unique(langid.gram_hashes([w])[0]) for i, w in enumerate(own)}
    names, scores = langid.Filters(grams).predict(own)
    assert names == [f"l{i:03d}" for i in range(130)] and all(0 < s <= 1 for s in scores)
    false = langid.Filters(grams).false
    assert (false < 0.01).all()


def test_toxicity(docs, empty, spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(VOCAB) for _ in range(40)) + (" you idiot moron" if i % 4 == 0 else ""), int(i % 4 == 0))
            for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = train.select("doc_id", "toxic").union(spark.createDataFrame(
        [(None, 1), (5, None), (10**6, 1), (3, 0)], "doc_id bigint, toxic int"))
    model = toxicity.learn(train.select("doc_id", "text"), labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert sum(x.predicted for x in got) == 0
    bad = spark.createDataFrame([(1, "you are an IDIOT, moron!"), (2, "w1 w2 w3"), (None, None)], "doc_id bigint, text string")
    assert {x.doc_id: x.predicted for x in toxicity.score(bad, model).collect()} == {1: 1, 2: 0, None: 0}
    assert toxicity.score(empty, model).count() == 0
    for some, value in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        constant = toxicity.learn(train.select("doc_id", "text"), some)
        assert {x.score for x in toxicity.score(docs, constant).collect()} == {value}


def test_toxicity_of_few_rows_is_not_over_sure(spark):
    """Labels that the texts say nothing about: with 99 toxic rows, too, scores stay near the toxic share."""
    r = random.Random(12)

    def text():
        words = [r.choice(VOCAB) for _ in range(r.randint(5, 60))]
        return " ".join(w.upper() if r.random() < 0.2 else w + r.choice(["", "", "!", "?", ",", "..."]) for w in words)

    train = spark.createDataFrame([(i, text()) for i in range(198)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(198)], "doc_id bigint, toxic int")
    fresh = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id bigint, text string")
    scores = [x.score for x in toxicity.score(fresh, toxicity.learn(train, labels)).collect()]
    assert sum((s - 0.5) ** 2 for s in scores) / len(scores) < 0.04
    # a single toxic row: no fold but its own is without it
    one = toxicity.learn(train, labels.withColumn("toxic", (F.col("doc_id") == 7).cast("int")))
    assert all(x.score < 0.5 for x in toxicity.score(fresh, one).collect())


def test_features_across_blocks():
    import numpy as np
    table = toxicity.TokenTable(frozenset({"blah", "foo*"}))
    names = toxicity.FEATURES
    x = toxicity.features(["you IDIOT!! 1d10t blah foobar", None, "", "w " * 700_000 + "you idiot"], table)
    first = dict(zip(names, x[0], strict=True))
    assert (first["lexicon"], first["learnt"], first["disguised"], first["near_second"]) == (1, 2, 1, 4)
    assert not np.any(x[1]) and not np.any(x[2])
    assert x[3][names.index("near_second")] == 1 and x[3][names.index("log_words")] == pytest.approx(np.log1p(700_002))


def test_licenses(spark, empty):
    from cohortlens.llm.license_texts import KNOWN
    mit = KNOWN[0][1]
    rows = [(1, "Copyright (c) 2024 Someone\n\n" + mit), (2, mit.upper().replace("\n", " \n")),
            (3, "code\n# Released under the MIT Licence!\nmore"), (4, None), (5, " ..!"), (6, mit + " extra"),
            (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nreleased under the mit license"),
            (1, "Copyright (c) 2024 Someone\n\n" + mit), (None, "SPDX-License-Identifier: ISC")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("x"))
    got = Counter((r.doc_id, r.license, r.notices) for r in licenses.scan(df).collect())
    assert got == Counter({(1, "MIT", ""): 2, (2, "MIT", ""): 1, (3, None, "MIT"): 1, (4, None, ""): 1, (5, None, ""): 1,
                           (6, None, ""): 1, (7, None, "CC-BY-NC-4.0,MIT"): 1, (None, "ISC", "ISC"): 1})
    whole = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert (whole[1], whole[2], whole[3], whole[4], whole[5], whole[6], whole[None]) == (
        "MIT", "MIT", None, None, None, None, "ISC")
    assert licenses.scan(empty).count() == 0


def test_sha_of_kept(docs):
    one = substr.remove_repeats(docs.where("doc_id = 0")).first()
    assert hashlib.sha256(one.kept_text.encode()).hexdigest() == brute.sha(TEXT[0])
