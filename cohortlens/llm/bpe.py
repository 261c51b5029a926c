"""Byte-level BPE encoding and decoding on padded numpy matrices.

Each match of the pre-tokenizing pattern is encoded by itself. The distinct matches that a task has
not met lately are put into matrices of rows of like length (bytes as token ids, padded);
in each round every row merges its leftmost pair of smallest rank, looked up in a hash
table of pairs, and the matrix is compacted. A match that is a token as a whole is that
token. Matches over ``LONG`` bytes take a heap over the same pairs, which gives the same merges
in n log n steps. Decoding joins the bytes of the ids.

Vocabulary files are read on the driver from the path given and broadcast (about 10 MB for
50,000 ranks). Defined cases: a null text counts as empty and has no ids; very long texts are
encoded match by match in bounded blocks; ids out of the vocabulary raise; repeated
rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import share, shared, text_slices

LONG = 512
CELLS = 1 << 18  # of a matrix
CACHE_BYTES = 24 << 20
ENTRY = 160  # bytes of a cached match beside its text and ids: two objects and their place in the table

_NONE = np.int64(1 << 40)  # above every rank
_MULT = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file, by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [t for _, t in pairs]


class PairTable:
    """Pairs of token ids that merge, in a hash table with linear probing."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        rank = {t: r for r, t in enumerate(tokens)}
        first, second, merged = [], [], []
        for r, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    first.append(a), second.append(b), merged.append(r)
        self.bits = max(4, int(4 * len(merged) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int64)
        keys = (np.array(first, dtype=np.int64) << 32) | np.array(second, dtype=np.int64)
        values, at = np.array(merged, dtype=np.int64), self._slot(keys)
        self.probes = 0
        while len(keys):  # the first key to reach a free slot has it; the others move on
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, won = np.unique(at[free], return_index=True)
            won = free[won]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), dtype=bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair (a, b); ``_NONE`` where it doesn't merge or an id is padding (-1)."""
        key = (a.astype(np.int64) << 32) | b
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.values[at], _NONE)
        open_ = np.flatnonzero((held != key) & (held != -1) & (a >= 0) & (b >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        out[(a < 0) | (b < 0)] = _NONE
        return out


class Encoder:
    """Encodes matches; keeps the latest distinct ones, their ids as int32 bytes, in about ``CACHE_BYTES``."""

    def __init__(self, table: PairTable) -> None:
        self.table = table
        self.tokens = table.tokens
        self.rank = {t: r for r, t in enumerate(self.tokens)}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of pieces of like length, all rows merging together."""
        sizes = np.array(list(map(len, pieces)))
        width = int(sizes.max())
        padded = int(sizes.min()) < width
        data = b"".join(p.ljust(width, b"\0") for p in pieces) if padded else b"".join(pieces)
        ids = self.byte[np.frombuffer(data, dtype=np.uint8)].reshape(len(pieces), width)
        ids[np.arange(width) >= sizes[:, None]] = -1
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        while True:
            if ids.shape[1] > 1:
                ranks = self.table.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
                best = ranks.argmin(axis=1)  # the leftmost of equal ranks
                least = ranks[np.arange(len(ids)), best]
                more = least < _NONE
            else:
                more = np.zeros(len(ids), dtype=bool)
            done = ids[~more].astype(np.int32)
            for r, row in zip(rows[~more].tolist(), done, strict=True):
                out[r] = (row[row >= 0] if padded else row).tobytes()
            if not more.any():
                return out
            rows, ids, best, least = rows[more], ids[more], best[more], least[more]
            each = np.arange(len(ids))
            ids[each, best] = least
            stay = np.ones(ids.shape, dtype=bool)
            stay[each, best + 1] = False
            ids = ids[stay].reshape(len(ids), -1)  # each row loses one column
            while ids.shape[1] > 1 and (ids[:, -1] < 0).all():
                ids = ids[:, :-1]

    def long(self, piece: bytes) -> bytes:
        """Ids (int32 bytes) of a long piece: the same merges from a heap of (rank, place)."""
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.table.lookup(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(heap)

        def pair(i: int, j: int) -> None:
            r = self.rank.get(self.tokens[ids[i]] + self.tokens[ids[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                pair(i, after[i])
            if before[i] >= 0:
                pair(before[i], i)
        return np.array([x for x in ids if x >= 0], dtype=np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            data = p.encode()
            whole = self.rank.get(data)
            if whole is not None:
                self.put([p], [whole.to_bytes(4, "little")])
            elif len(data) > LONG:
                self.put([p], [self.long(data)])
            else:
                buckets.setdefault(len(data) if len(data) <= 24 else -len(data).bit_length(), []).append((p, data))
        for length, group in buckets.items():
            rows = CELLS // (length if length > 0 else 1 << -length)
            for at in range(0, len(group), rows):
                part = group[at:at + rows]
                self.put([p for p, _ in part], self.matrix([d for _, d in part]))

    def put(self, pieces: list[str], ids: list[bytes]) -> None:
        self.cache.update(zip(pieces, ids, strict=True))
        self.held += sum(map(len, pieces)) + sum(map(len, ids)) + ENTRY * len(pieces)

    def prepare(self, pieces: set[str]) -> None:
        """Make sure that the cache has all of ``pieces``."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self.learn(pieces.difference(self.cache))

    def ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of prepared pieces."""
        return np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), dtype=np.int32)

    def encode(self, pieces: list[str]) -> np.ndarray:
        self.prepare(set(pieces))
        return self.ids(pieces)


def decode(tokens: list[bytes], ids) -> bytes:
    return b"".join(map(tokens.__getitem__, np.asarray(ids).tolist()))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text",
                  block: int = 50_000) -> DataFrame:
    """Every column of ``docs`` plus ``ids`` (array of int) and ``decoded`` (the bytes of those ids)."""
    table = share(docs.sparkSession, PairTable(read_ranks(vocabulary)))
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    docs = docs.select(*kept)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import regex

        encoder, find = Encoder(shared(PairTable, table)), regex.compile(pattern)
        for b in text_slices(batches, text_col, 1 << 20):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            rows: list[list[np.ndarray]] = [[] for _ in texts]
            back: list[bytes] = []
            # the pieces of all short texts of the slice are prepared together
            short = [find.findall(t) if len(t) <= 1 << 20 else None for t in texts]
            encoder.prepare(set(chain.from_iterable(p for p in short if p)))
            for i, row in enumerate(rows):
                if short[i] is not None:
                    row.append(encoder.ids(short[i]))
                    back.append(decode(encoder.tokens, row[0]))
                    short[i] = None
            for i, (t, row) in enumerate(zip(texts, rows, strict=True)):
                if row:
                    continue
                matches, parts = (m.group() for m in find.finditer(t)), []
                while part := list(islice(matches, block)):
                    row.append(encoder.encode(part))
                    parts.append(decode(encoder.tokens, row[-1]))
                back.insert(i, b"".join(parts))
            sizes = [sum(map(len, r)) for r in rows]
            flat = list(chain.from_iterable(rows))
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                           pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(back, pa.binary())],
                                             names=[*kept, "ids", "decoded"])

    return docs.mapInArrow(run, schema)
