"""Mixing sources to target weights, in Spark SQL functions.

The words of each source, document after document in a pseudorandom order, are packed into
blocks of ``block`` words. The mix asks for as many units of a source as its target has blocks. For each
output shard (``shard`` slots on average) the counts of the sources are drawn as a multinomial held to the targets:
every unit picks a shard by a seeded hash, and the table of counts by source and shard is all that the mix is made
from. The slots of a source, shard after shard, take its blocks in the order of a pseudorandom permutation of the block
indices, so every pass over a source uses each block once and no block is taken more than
``ceil(target / size)`` times. Slots and blocks meet in a join on (source, block).

Permutations are swap-or-not shuffles: in every round the index x and its partner
(key - x) mod n are swapped if a hash bit of the larger one says so. They need no state, so slots are
dealt in parallel, and equal seeds give equal mixes.

Positions of documents in their source, and of a source's slots over the shards, are two-level running sums: rows
are cut into buckets of about ``BUCKET``, so that a hot source is spread. Rows equal in all columns are counted
before any shuffle and dealt out again by copy number. The table of sources (one row each) is the
only thing handled whole.

Defined cases: a null text has size 0, is never taken and keeps its row; a null source is a source
of its own, last in order; a source without words has target 0; repeated rows are documents
of their own and each give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, stage

BLOCK = 64
SHARD = 4096
BUCKET = 4096
ROUNDS = 24
SEED = 2024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def permute(x: Column, n: Column, key: Column, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """Pseudorandom permutation of 0..n-1, chosen by ``key``."""
    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, key), n) - at, n)
        bit = F.xxhash64(r, key, F.greatest(at, partner)).bitwiseAND(1)
        return F.when(bit == 1, partner).otherwise(at)

    return F.reduce(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(sid, source, docs, source_size, target)`` from ``sizes(source, size, copies)``.

    Sources by code point, null last, weigh ``weights`` in turn. They share all words by weight; no
    target is above ``most`` times its source's size, and what is above goes to the others by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                         F.sum("copies").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = totals.withColumn("sid", rank.cast("int"))
    totals = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)),
                                                 (F.col("sid") % len(weights) + 1).cast("int")))
    # the sources of least room for their weight reach their cap first; the level is the words
    # for each unit of weight once those at their cap are paid
    top = F.col("source_size") * most
    order = Window.orderBy(top / F.col("w"), "sid")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    paid, used = F.coalesce(F.sum(top).over(ahead), F.lit(0)), F.coalesce(F.sum("w").over(ahead), F.lit(0))
    level = (F.sum("source_size").over(everything) - paid) / (F.sum("w").over(everything) - used)
    totals = totals.withColumn("level", level).withColumn("room", top / F.col("w"))
    reached = F.first(F.when(F.col("level") <= F.col("room"), F.col("level")), ignorenulls=True).over(everything)
    totals = totals.withColumn("level", reached)
    return totals.select("sid", "source", "docs", "source_size",
                         F.when(F.col("level").isNull() | (F.col("level") > F.col("room")), top.cast("double"))
                         .otherwise(F.col("level") * F.col("w")).alias("target"))


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """Blocks and output units of each source: ``blocks, units``."""
    blocks = F.ceil(F.col("source_size") / block)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.least(F.round((F.col("target") - passes * F.col("source_size")) / block).cast("long"), blocks)
    return targets.withColumn("blocks", blocks).withColumn("units", passes * blocks + rest)


def _stretches(rows: DataFrame, n: str, name: str, length: int) -> DataFrame:
    """``rows`` once for each of 0..n-1 (column ``name``), dealt out in stretches so that one row may stand for very many."""
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / length))).alias("__part")
    cut = rows.where(F.col(n) > 0).select("*", stretch)
    cut = cut.repartition(*[c for c, t in cut.dtypes if not t.startswith("map")])
    ends = F.least((F.col("__part") + 1) * length, F.col(n)) - 1
    return cut.select("*", F.explode(F.sequence(F.col("__part") * length, ends)).alias(name)).drop("__part")


def _running(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` plus the sum of ``value`` over the rows before (by bucket, then ``order``) of the same ``keys``."""
    rows = rows.withColumn("__bucket", bucket)
    sums = rows.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__bucket")
    sums = sums.select(*keys, "__bucket", (F.sum("__sum").over(before) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("__run", F.sum(value).over(inside)).join(sums, [*keys, "__bucket"])
            .withColumn(name, F.col("__before") + F.col("__run") - F.col(value))
            .drop("__bucket", "__run", "__before"))


def shard_counts(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """The draw: ``(shard, sid, slots)``, a source's slots in each output shard.

    Every unit picks one of the shards at random, so that the counts of a source over the shards are
    multinomial, and sum up to its units. The counts are added up before the shuffle.
    """
    total = plan.agg(F.sum("units")).first()[0] or 0
    shards = max(1, -(-total // shard))
    units = _stretches(plan.select("sid", "units"), "units", "unit", 1 << 16)
    pick = F.pmod(F.xxhash64(F.lit(SEED), "sid", "unit"), F.lit(shards))
    return units.select(pick.alias("shard"), "sid").groupBy("shard", "sid").agg(F.count("*").alias("slots"))


def slots(plan: DataFrame, counts: DataFrame) -> DataFrame:
    """Every output slot of the draw: ``(shard, sid, nth, k, block)``, the k-th slot of its source in the shard and
    the nth over all shards, with the block that the permutation gives to it."""
    placed = _running(counts, ["sid"], F.floor(F.col("shard") / BUCKET), ["shard"], "slots", "before")
    drawn = placed.join(plan.select("sid", "blocks"), "sid")
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("k"))
    nth = F.col("before") + F.col("k")
    return drawn.select("shard", "sid", nth.alias("nth"), "k",
                        permute(nth % F.col("blocks"), F.col("blocks"), F.col("sid")).alias("block"))


def pack(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cut the documents into their source's blocks: one row for each piece of a document in a block.

    ``sizes(doc_id, source, size, row, copies)`` with ``row`` a hash of the whole row. Pieces:
    ``doc_id, row, dup, sid, size, start`` and ``block, offset, words`` (the piece's place in the document).
    """
    named = sources.select(F.col("source").alias("s"), "sid", F.ceil(F.col("docs") / BUCKET).alias("buckets"))
    rows = (_stretches(sizes.where("size > 0"), "copies", "dup", BUCKET)
            .join(named, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "row", "dup", "sid", "size", "buckets"))
    placed = _running(rows, ["sid"], F.pmod(F.xxhash64("row", "dup"), "buckets"), ["row", "dup", "doc_id"], "size", "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.select("doc_id", "row", "dup", "sid", "size", "start",
                           F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * block, "start")
    hi = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    return pieces.select("*", (lo - F.col("start")).alias("offset"), (hi - lo).alias("words"))


def _row(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed (all but maps)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])


def _sizes(docs: DataFrame) -> DataFrame:
    return stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _row(docs).alias("row"))
                 .groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("copies")), "sizes")


def taken_pieces(sizes: DataFrame, sources: DataFrame, plan: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """The pieces with the number of ``times`` that the slots of the draw ``counts`` take each."""
    times = slots(plan, counts).groupBy("sid", "block").agg(F.count("*").alias("times"))
    return pack(sizes, sources, block).join(times, ["sid", "block"], "left").fillna(0, ["times"])


def _drawn(sizes: DataFrame, block: int, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of sources, their blocks and units, and the draw."""
    sources = stage(source_targets(sizes), "sources")
    plan = _plan(sources, block)
    return sources, plan, stage(shard_counts(plan, shard), "draw")


def mix_slots(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix in drawn order: ``(shard, slot, source, block, doc_id, row, dup, start, offset, words)``, a row for each
    piece of a document in the block that the slot takes (by ``start`` within the slot). The slots of a shard, counted
    from 0, are those of its sources in a pseudorandom order."""
    sizes = _sizes(docs)
    sources, plan, counts = _drawn(sizes, block, shard)
    within = Window.partitionBy("shard").orderBy("sid")
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = counts.select(F.col("shard"), "sid", (F.sum("slots").over(within) - F.col("slots")).alias("first"),
                           F.sum("slots").over(whole).alias("all_slots"))
    drawn = (slots(plan, counts).join(ranges, ["shard", "sid"])
             .withColumn("slot", permute(F.col("first") + F.col("k"), F.col("all_slots"), F.col("shard")))
             .join(sources.select("sid", "source"), "sid"))
    return (drawn.join(pack(sizes, sources, block).drop("size"), ["sid", "block"])
            .select("shard", "slot", "source", "block", "doc_id", "row", "dup", "start", "offset", "words"))


def mix_sizes(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row."""
    return sizes_taken(_sizes(docs), block, shard)


def sizes_taken(sizes: DataFrame, block: int = BLOCK, shard: int = SHARD, change=lambda counts: counts) -> DataFrame:
    """``mix_sizes`` from the table of sizes; ``change`` may alter the table of the draw."""
    sources, plan, counts = _drawn(sizes, block, shard)
    pieces = taken_pieces(sizes, sources, plan, change(counts), block)
    taken = (pieces.groupBy("sid", "start", "doc_id", "size")
             .agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    empty = (_stretches(sizes.where("size = 0"), "copies", "dup", BUCKET)
             .join(sources.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s")))
             .select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    rows = taken.select("sid", "doc_id", "size", "taken").union(empty)
    return (rows.join(sources.select("sid", "source_size", "target"), "sid")
            .select("doc_id", "size", "source_size", "target", "taken"))


def mix_texts(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, with those words.

    A document that is taken whole twice gives two rows; in the last pass over its source, the row
    holds the words of the blocks taken. Words are joined by one space, ``n_chars`` counts anew.
    Documents that the mix doesn't take are left out.
    """
    sizes = _sizes(docs)
    sources, plan, counts = _drawn(sizes, block, shard)
    spans = (taken_pieces(sizes, sources, plan, counts, block).where("times > 0")
             .select("doc_id", "row", "dup", "offset", "words",
                     F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
             .groupBy("doc_id", "row", "dup", "turn")
             .agg(F.sort_array(F.collect_list(F.struct("offset", "words"))).alias("spans")))
    # the turns of a few copies together, so that the words of their text are cut once for all of them
    spans = (spans.groupBy(F.col("row").alias("__r"), F.col("doc_id").alias("__d"), F.floor(F.col("dup") / 64).alias("__few"))
             .agg(F.collect_list("spans").alias("__turns")).drop("__few"))
    # each distinct row's text once: its copies, and the passes over it, come from the spans
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), _row(docs).alias("__row"),
                        F.col("doc_id").alias("__id"))
    texts = texts.groupBy("__row", "__id").agg(F.first("__doc").alias("__doc"))
    met = texts.join(spans, (F.col("__row") == F.col("__r")) & F.col("__id").eqNullSafe(F.col("__d")))
    words = F.regexp_extract_all(F.col("__doc")["text"], F.lit(f"({WORD_RE})"))
    picked = F.flatten(F.transform("__spans", lambda s: F.slice("__words", (s["offset"] + 1).cast("int"),
                                                                s["words"].cast("int"))))
    met = (met.withColumn("__words", words).withColumn("__spans", F.explode("__turns"))
           .withColumn("__text", F.array_join(picked, " ")))
    made = {"text": F.col("__text"), "n_chars": F.length("__text").cast(
        docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return met.select(*(made[c].alias(c) if c in made else F.col("__doc")[c].alias(c) for c in docs.columns))
