"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one document. Every word covered by a window
whose word sequence also starts anywhere else (another document or another place of the
same one) is removed; windows are judged on the input.

1. *Confirm recurring passages.* Each window selects its anchor, the leftmost k-gram of
   smallest hash; equal windows select equal anchors at equal offsets, and neighbouring
   windows mostly share theirs, so there are about 2 anchors per ``window - k + 2`` words.
   The windows of one anchor form a run. Anchors and runs are counted over the whole table. An
   anchor met once has no recurring window; one met several times always in equal runs has only
   recurring windows; for the others, and for no others, the single windows are counted.
2. *Compile sharded automata.* The documents are dealt into chunks of bounded text; each chunk
   gets the recurring anchors and windows that concern it, cuts its recurring
   passages (maximal stretches of recurring windows) and compiles the distinct ones into one
   Aho-Corasick automaton over words.
3. *Stream all documents* of the chunk through its automaton, which marks the words to cut.

Which words recur is found by the hashes of steps 1 and 2 alone: the passages of a chunk are cut from its own
texts, so its automaton meets the same occurrences again and is no check of the hashes.

Hot passages are counted with partial aggregates and reach a chunk once, however often
they occur. The rows are written once with a number of their own, and chunks are dealt by a hash of that
number, so that copies spread, be they alike in every column.
Defined cases: a null text has no words, keeps a null text and loses nothing; texts of fewer
than ``window`` words lose nothing; repeated rows are documents of their own; an empty table
gives an empty result; a text column is needed, a clashing output column is replaced.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import new_work_path, remove_path

from .common import stage, text_slices, word_blocks

WINDOW = 35
K = 8
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64's finish) on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Word hashes of some texts, one after another; ``start[i]`` is the first word of text i."""

    def __init__(self, texts: list[str | None]) -> None:
        digest = xxhash.xxh3_64_intdigest
        parts, self.start = [], [0]
        for text in texts:
            n = 0
            for block in word_blocks((text or "").encode()):
                parts.append(np.fromiter(map(digest, block), dtype=np.uint64, count=len(block)))
                n += len(block)
            self.start.append(self.start[-1] + n)
        self.start = np.array(self.start, dtype=np.int64)
        self.hash = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def anchors(self, window: int, k: int):
        """The runs of windows that share an anchor: (g, run hash, first window, last window) arrays."""
        a, n = self.hash, len(self.hash)
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < window:
            return none
        grams = n - k + 1
        g = np.zeros(grams, dtype=np.uint64)
        for i in range(k):
            g = g * _BASE + a[i:i + grams]
        g = _mix(g)
        span = window - k + 1  # k-grams in a window
        at, width = np.arange(grams, dtype=np.int64), 1
        while width * 2 <= span:  # leftmost smallest of 1, 2, 4, ... k-grams
            left, right = at[:-width], at[width:]
            at = np.where(g[left] <= g[right], left, right)
            width *= 2
        if span > width:
            left, right = at[:len(at) - (span - width)], at[span - width:]
            at = np.where(g[left] <= g[right], left, right)
        # a window may not run over the end of its text
        ok = np.zeros(n + 1, dtype=np.int32)
        lo, hi = self.start[:-1], self.start[1:] - window + 1
        real = hi > lo
        np.add.at(ok, lo[real], 1)
        np.add.at(ok, hi[real], -1)
        where = np.flatnonzero(np.cumsum(ok[:len(at)]) > 0)
        if not len(where):
            return none
        chosen = at[where]
        cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(where) != 1)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(where)]]) - 1
        p, s0, s1 = chosen[first], where[first], where[last]
        return g[p], self.spans(s0, s1 + window, p - s0), s0, s1

    def spans(self, lo: np.ndarray, hi: np.ndarray, extra: np.ndarray | int = 0) -> np.ndarray:
        """Hash of the words lo..hi-1, for each pair (lengths are bounded: 2 windows at most)."""
        h = np.zeros(len(lo), dtype=np.uint64)
        length = hi - lo
        for i in range(int(length.max()) if len(length) else 0):
            on = length > i
            if on.all():
                h = h * _BASE + self.hash[lo + i]
            else:
                h[on] = h[on] * _BASE + self.hash[lo[on] + i]
        return _mix(h ^ _mix(length.astype(np.uint64) + (np.asarray(extra).astype(np.uint64) << np.uint64(20))))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _found(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``within``."""
    if not len(within) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(within, values)
    at[at == len(within)] = 0
    return within[at] == values


def _runs(window: int, k: int):
    """Per chunk and batch: the distinct (anchor, run) with their counts."""
    def run(batches):
        for b in text_slices(batches, "text", 4 << 20):
            words = Words(b.column("text").to_pylist())
            g, r, s0, _ = words.anchors(window, k)
            if not len(g):
                continue
            owner = np.searchsorted(words.start, s0, side="right") - 1
            chunk = b.column("chunk").to_numpy(zero_copy_only=False)[owner].astype(np.int64)
            order = np.lexsort((r, g, chunk))
            chunk, g, r = chunk[order], g[order], r[order]
            new = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk[first]), _long(g[first]), _long(r[first]),
                 pa.array(np.diff(np.append(first, len(g))).astype(np.int64))],
                names=["chunk", "g", "r", "n"])
    return run


def _pair(window: int, k: int):
    """Pairs of (anchor, window) hashes for the anchors that are met in unlike runs."""
    def run(texts: pa.Table, info: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk", pa.int64()), ("g", pa.int64()), ("w", pa.int64()), ("n", pa.int64())])
        if not texts.num_rows or not info.num_rows:
            return schema.empty_table()
        words = Words(texts.column("text").to_pylist())
        g, _, s0, s1 = words.anchors(window, k)
        mixed = info.filter(pa.compute.equal(info.column("alike"), False)).column("g").to_numpy().view(np.uint64)
        on = _found(g, np.sort(mixed))
        g, s0, s1 = g[on], s0[on], s1[on]
        if not len(g):
            return schema.empty_table()
        each = s1 - s0 + 1
        at = np.repeat(s0, each) + _ranks(each)
        gw = np.stack([np.repeat(g, each), words.spans(at, at + window)], axis=1)
        gw, n = _distinct(gw)
        chunk = np.full(len(gw), texts.column("chunk")[0].as_py(), dtype=np.int64)
        return pa.table([pa.array(chunk), _long(gw[:, 0].copy()), _long(gw[:, 1].copy()),
                         pa.array(n.astype(np.int64))], schema=schema)
    return run


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    p = pairs[order]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)]))
    return p[first], np.diff(np.append(first, len(p)))


def _ranks(each: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    ends = np.cumsum(each)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each)


def _stretches(on: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of covered words, cut at the ends of the texts."""
    edge = np.zeros(len(on) + 1, dtype=bool)
    edge[start] = True
    begins = on & (np.concatenate([[True], ~on[:-1]]) | edge[:-1])
    ends = on & (np.concatenate([~on[1:], [True]]) | edge[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def locate(words: Words, passages: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """Mark the words of every occurrence of any of ``passages`` (arrays of word hashes)."""
    covered = np.zeros(len(words.hash) + 1, dtype=np.int64)
    if not passages:
        return covered[:-1].astype(bool)
    known = np.unique(np.concatenate(passages))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number = lambda h: np.where(_found(h, known), np.searchsorted(known, h) + 1, 0)
    for p in passages:
        automaton.add_word(tuple(number(p).tolist()), len(p))
    automaton.make_automaton()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        ids = number(words.hash[lo:hi])
        # the words that no passage has part the text; an occurrence lies between two of them
        if not ids.any():
            continue
        for end, length in automaton.iter(tuple(ids.tolist())):
            covered[lo + end - length + 1] += 1
            covered[lo + end + 1] -= 1
    return np.cumsum(covered[:-1]) > 0


def _cover(window: int, k: int, names: list[str]):
    """Locate the recurring passages of a chunk and cut them from its texts."""
    def run(texts: pa.Table, info: pa.Table) -> pa.Table:
        out = texts.select(names)
        values = texts.column("text").to_pylist()
        words = Words(values)
        mark = np.zeros(len(words.hash), dtype=bool)
        if info.num_rows:
            g, _, s0, s1 = words.anchors(window, k)
            whole = pa.compute.is_null(info.column("w"))
            alike = np.sort(info.filter(whole).column("g").to_numpy().view(np.uint64))
            rest = info.filter(pa.compute.invert(whole))
            sure = _found(g, alike)
            lo, hi = s0[sure], s1[sure] + window
            mixed = rest.column("g").to_numpy().view(np.uint64)
            if len(mixed):
                on = _found(g, np.unique(mixed))
                each = s1[on] - s0[on] + 1
                at = np.repeat(s0[on], each) + _ranks(each)
                pairs = np.stack([np.repeat(g[on], each), words.spans(at, at + window)], axis=1)
                both = np.stack([mixed, rest.column("w").to_numpy().view(np.uint64)], axis=1)
                hit = np.isin(_keys(pairs), _keys(both))
                lo, hi = np.concatenate([lo, at[hit]]), np.concatenate([hi, at[hit] + window])
            depth = np.zeros(len(mark) + 1, dtype=np.int64)
            np.add.at(depth, lo, 1)
            np.add.at(depth, hi, -1)
            begins, ends = _stretches(np.cumsum(depth[:-1]) > 0, words.start)
            passages = {h: words.hash[b:e] for h, b, e in
                        ((words.hash[b:e].tobytes(), b, e) for b, e in zip(begins, ends, strict=True))}
            mark = locate(words, list(passages.values()), words.start)
        kept, removed = [], []
        for value, lo, hi in zip(values, words.start[:-1], words.start[1:], strict=True):
            stay, at, parts = ~mark[lo:hi], 0, []
            for block in word_blocks((value or "").encode()):
                parts.extend(compress(block, stay[at:at + len(block)].tolist()))
                at += len(block)
            kept.append(None if value is None else b" ".join(parts).decode())
            removed.append(int(mark[lo:hi].sum()))
        out = out.append_column("n_words", pa.array(np.diff(words.start)))
        out = out.append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("kept_text", pa.array(kept, pa.string()))
    return run


def _keys(pairs: np.ndarray) -> np.ndarray:
    """Rows of two hashes as one 128-bit key each."""
    return np.ascontiguousarray(pairs).view(np.dtype("V16")).ravel()


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id",
                   text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every column of ``docs`` plus ``n_words, n_removed, kept_text``.

    ``kept_text`` holds the kept words joined by one space (null for a null text). Ids play no part
    (``id_col`` is not used).
    """
    row = F.struct(*[c for c in docs.columns if c != text_col]).alias("row")
    # written, so that a row has the same number in every pass and retry
    rows = stage(docs.select(F.col(text_col).alias("text"), row, F.monotonically_increasing_id().alias("number")), "rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-int(size) // chunk_bytes))
    chunk = F.pmod(F.xxhash64("number"), F.lit(chunks)).alias("chunk")
    texts = rows.select("text", chunk)
    dealt = rows.select("text", chunk, "row")
    spark = docs.sparkSession
    runs_path = new_work_path(spark, "llm-runs")
    runs = stage(texts.mapInArrow(_runs(window, k), "chunk bigint, g bigint, r bigint, n bigint"), "runs", runs_path)
    anchors = (runs.groupBy("g").agg(F.sum("n").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
               .where("n > 1").select("g", (F.col("lo") == F.col("hi")).alias("alike")))
    near = stage(runs.select("chunk", "g").join(anchors, "g").distinct(), "recurring-anchors")
    remove_path(spark, runs_path)  # only the recurring anchors are needed from here on
    windows = (dealt.groupBy("chunk").cogroup(near.groupBy("chunk"))
               .applyInArrow(_pair(window, k), "chunk bigint, g bigint, w bigint, n bigint"))
    again = windows.groupBy("g", "w").agg(F.sum("n").alias("n")).where("n > 1").select("g", "w")
    info = (near.where("alike").select("chunk", "g", F.lit(None).cast("long").alias("w"))
            .union(windows.join(again, ["g", "w"]).select("chunk", "g", "w")))
    out = T.StructType([dealt.schema["row"], T.StructField("text", T.StringType()),
                        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept_text", T.StringType())])
    found = (dealt.groupBy("chunk").cogroup(info.groupBy("chunk"))
             .applyInArrow(_cover(window, k, ["row", "text"]), out))
    added = ("n_words", "n_removed", "kept_text")
    back = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return found.select(*back, *added)
