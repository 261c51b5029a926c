"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of the n-grams that are frequent in it. The filters are
bit-sliced: slot s of the table holds one bit for each language, so one n-gram costs ``HASHES``
slot reads, and their AND is the bitmask of all languages that contain it. The n-grams of a
text are looked up, the bits of each language counted (popcount), and the share of hits
corrected for the false positives that the language's filter gives by its fill:
``(hits / n - f) / (1 - f)``. The largest corrected share decides; the score is its part of all.

Learning: n-grams are counted over a bounded, documented sample of the labelled texts, about
``sample`` distinct texts at most per language, taken by a hash of the text; copies of a text count once. An n-gram enters a
language's filter when it makes up at least ``min_share`` of the language's n-grams, so a filter
has at most ``1 / min_share`` of them whatever the corpus size. Any number of languages is
possible (64 to a word of the bitmask).

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text
when nothing could be learnt; ties go to the smaller language name; very long texts are read
whole, in blocks; repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash62, share, share_below, shared, stage, text_slices

SIZES = (1, 2, 3, 4)
HASHES = 3
LOG_SLOTS = 18
MIN_SHARE = 1e-4
SAMPLE = 4000

_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all letter n-grams of ``texts`` (words marked by blanks) and each one's text number."""
    clean = [" " + _GAP.sub(" ", t.lower()).strip() + " " for t in texts]
    points = np.frombuffer("".join(clean).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in clean])
    blank = points == 32
    hashes, owners = [], []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        # an n-gram may begin or end at a blank but not span one
        h = h[:len(points) - n + 1] * _M1 + points[n - 1:] + np.uint64(n)
        if n not in SIZES or not len(h):
            continue
        ok = owner[:len(h)] == owner[n - 1:]
        if n <= 2:
            ok &= ~blank[:len(h)]
        if n == 2:
            ok &= ~blank[1:]
        for i in range(1, n - 1):
            ok &= ~blank[i:i + len(h)]
        x = h[ok]
        x = (x ^ (x >> np.uint64(29))) * _M2
        hashes.append(x ^ (x >> np.uint64(32)))
        owners.append(owner[:len(ok)][ok])
    return np.concatenate(hashes), np.concatenate(owners)


def _slots(h: np.ndarray, log_slots: int) -> list[np.ndarray]:
    """The slots of each n-gram, by double hashing."""
    mask, step = np.uint64((1 << log_slots) - 1), (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The bit-sliced table, the language names and each language's false-positive rate."""

    def __init__(self, grams: dict[str, np.ndarray], log_slots: int = LOG_SLOTS) -> None:
        self.names, self.log_slots = sorted(grams), log_slots
        words = max(1, -(-len(self.names) // 64))
        self.table = np.zeros((words, 1 << log_slots), dtype=np.uint64)
        self.false = np.zeros(len(self.names))
        for i, name in enumerate(self.names):
            bit, row = np.uint64(1 << (i % 64)), self.table[i // 64]
            for s in _slots(grams[name], log_slots):
                row[s] |= bit
            self.false[i] = ((row & bit) != 0).mean() ** HASHES

    def hits(self, h: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language contains."""
        total = np.bincount(owner, minlength=texts)
        out = np.zeros((texts, len(self.names)))
        slots = _slots(h, self.log_slots)
        for w in range(len(self.table)):
            bits = self.table[w][slots[0]]
            for s in slots[1:]:
                bits &= self.table[w][s]
            for i in range(64 * w, min(64 * w + 64, len(self.names))):
                on = (bits >> np.uint64(i % 64)) & np.uint64(1)
                out[:, i] = np.bincount(owner, weights=on, minlength=texts)
        return total, out

    def predict(self, texts: list[str | None], block: int = 1 << 19) -> tuple[list[str], list[float]]:
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.names)))
        held, ids, size = [], [], 0

        def flush() -> None:
            if held:
                n, x = self.hits(*gram_hashes(held), len(held))
                np.add.at(total, ids, n)
                np.add.at(hits, ids, x)
                held.clear(), ids.clear()

        for i, t in enumerate(texts):
            for at in range(0, len(t or ""), block):
                held.append(t[at:at + block])
                ids.append(i)
                size += len(held[-1])
                if size >= block:
                    flush()
                    size = 0
        flush()
        share = (hits / np.maximum(total, 1)[:, None] - self.false) / np.maximum(1 - self.false, 1e-9)
        share = np.maximum(share, 0) + 1e-9
        best = share.argmax(axis=1)
        score = share[np.arange(len(texts)), best] / share.sum(axis=1)
        known = [bool(t and _LETTER.search(t)) for t in texts]
        return ([self.names[b] if k else "und" for b, k in zip(best, known, strict=True)],
                [min(1.0, float(s)) if k else 0.0 for s, k in zip(score, known, strict=True)])


def learn(labelled: DataFrame, min_share: float = MIN_SHARE, sample: int = SAMPLE,
          text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from ``labelled(text, lang)``; rows with a null text or language are not used.

    About ``sample`` distinct texts of each language are read, by a hash of the text; the counting itself is a
    Spark aggregate, and each language sends at most ``1 / min_share`` n-grams to the driver.
    """
    rows = (labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
            .where("lang is not null and text is not null"))
    # one number for each language, as many as the filters have bits
    hashes = rows.select("lang", F.xxhash64("text").alias("th")).distinct()
    sizes = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters({})
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, share_below(sample, n))])
    taken = rows.where(hash62("text") < limit[F.col("lang")]).distinct()

    def count(batches):
        for b in text_slices(batches, "text", 4 << 20):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                h, _ = gram_hashes([texts[i] for i in np.flatnonzero(langs == lang)])
                g, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "g", "n"])

    counts = (taken.mapInArrow(count, "lang string, g bigint, n bigint")
              .groupBy("lang", "g").agg(F.sum("n").alias("n")))
    counts = stage(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = (counts.join(totals, "lang").where(F.col("n") >= F.col("total") * min_share)
                .select("lang", "g").toPandas())
    return Filters({lang: part["g"].to_numpy().astype(np.int64).view(np.uint64)
                    for lang, part in frequent.groupby("lang")})


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` but the text, plus ``lang_pred`` and ``score``; only the text is judged."""
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = docs.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    model = share(docs.sparkSession, filters)

    def run(batches):
        own = shared(Filters, model)
        for b in text_slices(batches, text_col, 4 << 20):
            lang, score = own.predict(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*rest, "lang_pred", "score"])

    return docs.select(*rest, text_col).mapInArrow(run, schema)
