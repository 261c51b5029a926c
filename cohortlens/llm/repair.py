"""Conversation structure repair by a checkpointed dynamic programme.

A conversation is repaired by the cheapest edits after which the initials of its roles read
``(s?(ua)+)?``: keep (0), rerole to user or assistant (3), delete (4; required for blank rows and repeats)
and insert an empty user or assistant row (3); a truncated row that stays adds 3. Of the
cheapest edits, those whose initials (D, I, K, R) come first in ASCII are taken.

A state says what the roles so far end in; every edit leads from a state to one other state. The backward
vector of a place holds the cost of the rest from each state. As in a square-root checkpointed programme,
vectors are stored at every ``sqrt(n)``-th row only and worked out again, stretch by stretch,
while walking forward along edits that lose nothing against the vectors (tight edits).

Scale. The rows are sorted by range and numbered once, and a conversation is cut into blocks of that order
(``1 << shift`` rows at most), so that no task holds a conversation. A block of a conversation of several
is summed up by a small table: for each state before and after it, the cost and the rank of the ASCII-least
cheapest edits. Folding the tables backward gives each block's end vector, and forward the state it starts in; then all
blocks are walked side by side. Equal rows of a turn travel as one row with a count. What is sequential by
definition (the SHA-256 of a conversation, its audit text) is streamed over sorted rows, a row at a time.

Defined cases: a null role or text is one space, a null turn or conversation id is a value of its own (turns:
first); an empty role has no initial and can't be kept; rows of one turn are ordered by role, then text (code
points); repeated rows are duplicates; gaps beyond a long are the largest long; a conversation without rows has
zeros, an empty audit and the hash of the empty text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHIFT = 12
BLANKS = " \t\n\x0b\x0c\r"
INF = 1 << 60

# states: nothing yet, after the system row, after a user row, after an assistant row
NEXT = (2, 2, 3, 2)  # the one state that a rerole or an insert leads to
KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))  # by initial s, u, a, -
FINAL = (0, 6, 3, 0)  # nothing, or an assistant row, may be last; otherwise rows are inserted
ROLE = {2: "user", 3: "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage of ``(conv_id, turn, role, text)`` by crc32 of ``conv_id:turn``; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", ""))
            .otherwise(blank("text")))
    return (rows.where(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
                    text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("n")))


def plain(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` as they are, nulls one space, each row once."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("bigint").alias("n"))


def ordered(rows: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Distinct rows of ``(conv_id, turn, role, text, n)`` in order: ``seq``, ``block``, ``initial``, ``fault``.

    ``fault``: 0 none, 1 blank, 2 duplicate (the role and text seen at an earlier turn), 3 truncated. Of a
    row counted ``n`` times all but the first are duplicates too.
    """
    lone = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # the first turn of each role and text, by digest: hot texts are summed up before the shuffle
    digest = F.sha2("text", 256)
    here = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = (lone.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d"))
             .agg(F.min(here).alias("first")))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (F.when(last == "", 1).when(here != F.col("first"), 2)
             .when(~last.isin(".", "!", "?"), 3).otherwise(0))
    lead = F.left("role", F.lit(1))
    initial = F.when(lead == "s", 0).when(lead == "u", 1).when(lead == "a", 2).otherwise(3)
    judged = (lone.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                        & (digest == F.col("d")))
              .select("conv_id", "turn", "role", "text", "n", initial.cast("tinyint").alias("initial"),
                      fault.cast("tinyint").alias("fault")))
    judged = stage(judged, "judged")
    # by range: a conversation, even a turn, may lie in several partitions; the cut texts only place the rows
    order = ["conv_id", "turn", "role", "text"]
    placed = judged.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(*order)
    seq = F.monotonically_increasing_id()
    return (stage(placed.select("*", seq.alias("seq")), "ordered-turns")
            .withColumn("block", F.shiftright("seq", shift)))


# --- the programme over the codes of rows: code = 4 * initial + fault, forced deletes (1 and 2) apart -------------

class Steps:
    """Backward and forward steps for row codes, remembered by relative vector or table."""

    def __init__(self) -> None:
        self.back: dict = {}
        self.ahead: dict = {}

    def before(self, v: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
        """The vector before a row, less its least entry, and that entry."""
        found = self.back.get((v, code))
        if found is None:
            initial, extra = code >> 2, 3 if code & 3 == 3 else 0
            best = [4 + x for x in v]
            for s in range(4):
                kept = KEEP[s][initial]
                if kept is not None:
                    best[s] = min(best[s], extra + v[kept])
                best[s] = min(best[s], 3 + extra + v[NEXT[s]])
            best[2], best[3] = min(best[2], 3 + best[3]), min(best[3], 3 + best[2])
            best[0], best[1] = min(best[0], 3 + best[2]), min(best[1], 3 + best[2])
            least = min(best)
            if least >= INF:
                found = (tuple(best), 0)
            else:
                found = (tuple(min(x - least, INF) for x in best), least)
            self.back[v, code] = found
        return found

    def edits(self, state: int, v: tuple[int, ...], ahead: tuple[int, ...], code: int) -> tuple[str, int]:
        """The ASCII-least tight edits at a row from ``state``: ``v`` and ``ahead`` are the vectors before and after."""
        initial, extra, out = code >> 2, 3 if code & 3 == 3 else 0, ""
        while True:
            if v[state] == 4 + ahead[state]:
                return out + "D", state
            if v[state] == 3 + v[NEXT[state]]:
                out, state = out + "I", NEXT[state]
                continue
            kept = KEEP[state][initial]
            if kept is not None and v[state] == extra + ahead[kept]:
                return out + "K", kept
            return out + "R", NEXT[state]

    def extend(self, table: tuple, code: int) -> tuple[tuple, int]:
        """A table of (cost, rank) by state after the rows so far, one row on; costs less the least, and that."""
        found = self.ahead.get((table, code))
        if found is None:
            initial, extra = code >> 2, 3 if code & 3 == 3 else 0
            ways: dict[int, tuple] = {}
            for s, cell in enumerate(table):
                if cell is None:
                    continue
                at, cost, inserts = s, cell[0], ""
                for _ in range(3):
                    options = [(4, "D", at), (3 + extra, "R", NEXT[at])]
                    if KEEP[at][initial] is not None:
                        options.append((extra, "K", KEEP[at][initial]))
                    for price, letter, to in options:
                        way = (cost + price, cell[1], inserts + letter)
                        if to not in ways or way < ways[to]:
                            ways[to] = way
                    at, cost, inserts = NEXT[at], cost + 3, inserts + "I"
            ranks = {w: r for r, w in enumerate(sorted(w[1:] for w in ways.values()))}
            least = min(w[0] for w in ways.values())
            found = (tuple((ways[s][0] - least, ranks[ways[s][1:]]) if s in ways else None for s in range(4)), least)
            self.ahead[table, code] = found
        return found


def summary(codes: list[int], steps: Steps) -> list[list[tuple[int, int] | None]]:
    """For each state before the rows, (cost, rank) by the state after them; rank: order of the least cheapest edits."""
    out = []
    for start in range(4):
        table, total = tuple((0, 0) if s == start else None for s in range(4)), 0
        for code in codes:
            table, more = steps.extend(table, code)
            total += more
        out.append([None if c is None else (c[0] + total, c[1]) for c in table])
    return out


def through(table: list[list], v: list[int]) -> list[int]:
    """The vector before rows of that summary from the vector after them, inserts before the first row included."""
    return [min([c[0] + v[t] for t, c in enumerate(row) if c is not None], default=INF) for row in table]


def leave(row: list, v: list[int]) -> int:
    """The state after the rows on the ASCII-least cheapest way, from one state's row of the summary."""
    return min((c[0] + v[t], c[1], t) for t, c in enumerate(row) if c is not None)[2]


def walk(codes: list[int], state: int, end: list[int], steps: Steps):
    """The edits of each row in order, as (edits, state before); vectors are kept at every sqrt(n)-th row only."""
    least = min(end)
    v = tuple(x - least for x in end)
    step = max(1, isqrt(len(codes)))
    checkpoints = {len(codes): v}
    for i in range(len(codes) - 1, -1, -1):
        v, _ = steps.before(v, codes[i])
        if i % step == 0:
            checkpoints[i] = v
    for at in range(0, len(codes), step):
        to = min(at + step, len(codes))
        vectors = [checkpoints[to]]
        drops = []
        for i in range(to - 1, at - 1, -1):
            v, less = steps.before(vectors[-1], codes[i])
            vectors.append(v)
            drops.append(less)
        vectors.reverse()
        drops.reverse()
        for i in range(at, to):
            here = tuple(x + drops[i - at] for x in vectors[i - at])
            was = state
            edits, state = steps.edits(state, here, vectors[i - at + 1], codes[i])
            yield edits, was


def price(edits: str, code: int) -> int:
    return 3 * edits.count("I") + {"D": 4, "K": 0, "R": 3}[edits[-1]] + (3 if code & 3 == 3 and edits[-1] != "D" else 0)


# --- the tasks --------------------------------------------------------------------------------------------

def _groups(batches, keys: list[str], cols: list[str]):
    """Rows of sorted batches by key: (key, list of tuples of ``cols``)."""
    at, held = None, []
    for b in batches:
        k = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
        rows = list(zip(*(b.column(c).to_pylist() for c in cols), strict=True))
        for key, row in zip(k, rows, strict=True):
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append(row)
    if held:
        yield at, held


def _code(initial: int, fault: int) -> int:
    return 4 * initial + fault


def _block_summaries(schema: pa.Schema):
    def run(batches):
        steps = Steps()
        for (conv, block), rows in _groups(batches, ["conv_id", "block"], ["initial", "fault"]):
            codes = [_code(i, f) for i, f in rows if f in (0, 3)]
            flat = [x for row in summary(codes, steps) for c in row for x in (c or (INF, 0))]
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field("conv_id").type), pa.array([block], pa.int64()),
                                              pa.array([flat], pa.list_(pa.int64()))], schema=schema)
    return run


def _fold(schema: pa.Schema):
    def run(batches):
        for (conv,), rows in _groups(batches, ["conv_id"], ["block", "table"]):
            tables = [[[None if flat[8 * s + 2 * t] >= INF else (flat[8 * s + 2 * t], flat[8 * s + 2 * t + 1])
                        for t in range(4)] for s in range(4)] for _, flat in rows]
            ends = [list(FINAL)]
            for t in reversed(tables[1:]):
                v = through(t, ends[-1])
                least = min(v)
                ends.append([x - least for x in v])
            ends.reverse()
            state, starts = 0, []
            for t, v in zip(tables, ends, strict=True):
                starts.append(state)
                state = leave(t[state], v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(rows), schema.field("conv_id").type), pa.array([b for b, _ in rows], pa.int64()),
                 pa.array(starts, pa.int32()), pa.array(ends, pa.list_(pa.int64())),
                 pa.array([i == len(rows) - 1 for i in range(len(rows))])], schema=schema)
    return run


def _walks(schema: pa.Schema):
    def run(batches):
        steps = Steps()
        for (conv, _), rows in _groups(batches, ["conv_id", "block"], ["seq", "initial", "fault", "start", "end", "last"]):
            _, _, _, start, end, last = rows[0]
            codes = [_code(i, f) for _, i, f, *_ in rows if f in (0, 3)]
            state, way = start or 0, walk(codes, start or 0, end or list(FINAL), steps)
            out, real = [], iter(codes)
            for seq, _, fault, *_ in rows:
                if fault in (1, 2):
                    out.append((seq, "", state, 0, ""))
                    continue
                code = next(real)
                edits, state = next(way)
                out.append((seq, edits, state, price(edits, code), ""))
                for letter in edits:
                    if letter == "I" or letter == "R":
                        state = NEXT[state]
                    elif letter == "K":
                        state = KEEP[state][code >> 2]
            if last is not False and FINAL[state]:  # rows inserted after the last one
                more = "I" * (FINAL[state] // 3)
                seq, edits, was, cost, _ = out[-1]
                out[-1] = (seq, edits, was, cost + FINAL[state], f"{state}{more}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(out), schema.field("conv_id").type),
                 *(pa.array([r[k] for r in out], schema.field(i).type) for i, k in ((1, 0), (2, 1), (3, 2), (4, 3), (5, 4)))],
                schema=schema)
    return run


def _assemble(schema: pa.Schema):
    """Rows sorted by conversation and order, each followed by its edits: audit, cost and digest of each conversation."""
    def run(batches):
        conv, done, audit, total, digest, first, held = object(), False, [], 0, None, True, None

        def line(role: str, text: str) -> None:
            nonlocal first
            digest.update((("" if first else "\n") + role + ":" + text).encode())
            first = False

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], schema.field("conv_id").type), pa.array([total], pa.int64()),
                 pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], schema=schema)

        cols = ["conv_id", "role", "text", "n", "fault", "edits", "state", "cost", "after"]
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
                if row[0] != conv:
                    if done:
                        yield close()
                    conv, done, audit, total, digest, first = row[0], True, [], 0, hashlib.sha256(), True
                if row[5] is None:  # the row itself; its edits come next
                    held = row
                    continue
                _, role, text, n, fault, *_ = held
                _, _, _, _, _, edits, state, cost, after = row
                gone = n if fault in (1, 2) else n - 1
                for letter in edits:
                    if letter == "I":
                        state = NEXT[state]
                        line(ROLE[state], "")
                    elif letter == "R":
                        state = NEXT[state]
                        line(ROLE[state], text)
                    elif letter == "K":
                        line(role, text)
                # a counted row's copies go after it
                audit.append(edits + "D" * gone)
                total += cost + 4 * gone
                if after:
                    state = int(after[0])
                    for letter in after[1:]:
                        state = NEXT[state]
                        line(ROLE[state], "")
                    audit.append(after[1:])
        if done:
            yield close()
    return run


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def repair(rows: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``(conv_id, turn, role, text, n)`` (``damage``, ``plain``).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = ordered(rows, shift)
    codes = turns.select("conv_id", "block", "seq", "initial", "fault")

    # conversations of several blocks: tables of the blocks, folded to where each starts and ends
    spans = (codes.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
             .where("lo < hi").select("c"))
    several = codes.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    table_schema = spark.createDataFrame([], f"conv_id {kind}, block bigint, table array<bigint>")
    tables = (several.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq")
              .mapInArrow(_block_summaries(_arrow(table_schema)), table_schema.schema))
    fold_schema = spark.createDataFrame([], f"conv_id {kind}, block bigint, start int, end array<bigint>, last boolean")
    folded = stage(tables.repartition("conv_id").sortWithinPartitions("conv_id", "block")
                   .mapInArrow(_fold(_arrow(fold_schema)), fold_schema.schema), "blocks")

    f = folded.withColumnsRenamed({"conv_id": "c", "block": "b"})
    edit_schema = spark.createDataFrame([], f"conv_id {kind}, seq bigint, edits string, state int, cost bigint, after string")
    edits = (codes.join(f, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
             .select(*codes.columns, "start", "end", "last")
             .repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq")
             .mapInArrow(_walks(_arrow(edit_schema)), edit_schema.schema))

    none = lambda t, c: F.lit(None).cast(t).alias(c)
    both = (turns.select("conv_id", "seq", "role", "text", "n", "fault", none("string", "edits"), none("int", "state"),
                         none("bigint", "cost"), none("string", "after"))
            .unionByName(edits.select("conv_id", "seq", none("string", "role"), none("string", "text"), none("bigint", "n"),
                                      none("tinyint", "fault"), "edits", "state", "cost", "after")))
    out_schema = spark.createDataFrame([], f"conv_id {kind}, cost bigint, audit string, repaired_sha256 string")
    made = (both.repartition("conv_id").sortWithinPartitions("conv_id", "seq", F.col("edits").isNotNull())
            .mapInArrow(_assemble(_arrow(out_schema)), out_schema.schema))

    # figures that need no order, and the adjacent roles (the last row of a block meets the first of the next)
    big = F.col("turn").cast("decimal(20,0)")
    per_turn = turns.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == 1, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == 2, F.col("n")).when(F.col("fault") != 1, F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == 3, 1).otherwise(0)).alias("truncated"))
    gaps = F.max(big) - F.min(big) + 1 - F.count("turn")
    counts = per_turn.groupBy("conv_id").agg(
        F.coalesce(F.least(gaps, F.lit((1 << 63) - 1).cast("decimal(20,0)")), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pairs = adjacent(turns).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    p, m = pairs.withColumnRenamed("conv_id", "pc"), made.withColumnRenamed("conv_id", "mc")
    return (counts.join(p, F.col("conv_id").eqNullSafe(F.col("pc"))).join(m, F.col("conv_id").eqNullSafe(F.col("mc")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def adjacent(turns: DataFrame) -> DataFrame:
    """``(conv_id, illegal)``: illegal neighbours within each block and at its start."""
    ok = lambda a, b: ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    inside = Window.partitionBy("conv_id", "block").orderBy("seq")
    seen = turns.withColumn("prev", F.lag("initial").over(inside))
    within = (F.col("n") - 1 + F.when(F.col("prev").isNotNull() & ~ok(F.col("prev"), F.col("initial")), 1).otherwise(0))
    blocks = seen.groupBy("conv_id", "block").agg(
        F.sum(within).alias("illegal"), F.min_by("initial", "seq").alias("head"), F.max_by("initial", "seq").alias("tail"))
    before = F.lag("tail").over(Window.partitionBy("conv_id").orderBy("block"))
    return (blocks.withColumn("before", before)
            .select("conv_id", (F.col("illegal") + F.when(F.col("before").isNotNull() & ~ok(F.col("before"), F.col("head")), 1)
                                .otherwise(0)).alias("illegal")))


def repair_all(conversations: DataFrame, change=plain, shift: int = SHIFT) -> DataFrame:
    """``repair`` of every conversation id, those without a row left after ``change`` included."""
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = repair(change(conversations), shift)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("id").alias("conv_id"),
                    *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
