"""Document fingerprints: threshold-scaled sketches of word shingles, in Spark SQL functions.

A sketch keeps every distinct shingle hash (XXH64 of five consecutive words) below a fixed
fraction ``1 / scale`` of the hash range, whatever the text's length, and the text's least hash, so that no text
with words has an empty sketch. Sketches of two texts of any lengths can be merged and compared: the
hashes below the fraction are the same sample of both. Where neither has any, the least hashes decide.

Defined cases: a null text counts as empty; a text without words has no shingles, one with
fewer words than a shingle is one shingle. Two empty sketches are alike (1.0), an empty one and another are not
(0.0). Rows are ordered by doc_id, null ids first; of rows with one doc_id the text hash decides; wholly repeated
rows (same id, same text) count as one document and each give a row; they are put together before the
shuffle, sketched as one and dealt out again by a join. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP_RE, stage

WORDS = 5
SCALE = 2


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted distinct shingle hashes of ``text`` below the fraction, and the least of all."""
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_RE), "")

    def kept(w: Column) -> Column:
        last = F.greatest(F.size(w) - (words - 1), F.least(F.size(w), F.lit(1)))
        hashes = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                              lambda i: F.xxhash64(F.slice(w, i, words)))
                        ).otherwise(F.array().cast("array<bigint>"))
        return _each(hashes, lambda h: F.sort_array(F.array_distinct(_below_or_least(h, scale))))

    return _each(parts, kept)


def _below(hashes: Column, scale: int) -> Column:
    """The hashes below the fraction ``1 / scale`` of the (signed) range."""
    most = F.lit(-(1 << 63) + (1 << 64) // scale - 1)
    return F.filter(hashes, lambda x: x <= most)


def _below_or_least(hashes: Column, scale: int) -> Column:
    """The hashes below the fraction or, if there are none, the least: it is among those below if there are any."""
    return _each(_below(hashes, scale), lambda x: F.when((F.size(x) > 0) | (F.size(hashes) == 0), x)
                 .otherwise(F.array(F.array_min(hashes))))


def _each(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(s: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the shingles of both texts that they have in common."""
    x, y = _below(a, scale), _below(b, scale)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either > 0, both / either).otherwise(F.when(a == b, 1.0).otherwise(0.0))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the shingles of ``a``'s text that ``b``'s text has too."""
    x, y = _below(a, scale), _below(b, scale)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(
        F.when((F.size(y) == 0) & (a == b), 1.0).otherwise(0.0))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two texts together."""
    return _each(F.sort_array(F.array_union(a, b)), lambda h: _below_or_least(h, scale))


def _key(id_col: str = "doc_id") -> list[Column]:
    """Row order: null ids first, then by id, then by text hash."""
    return [F.col(id_col).isNotNull().alias("numbered"), F.col(id_col).alias("id"), F.xxhash64("text").alias("th")]


def _previous(docs: DataFrame) -> DataFrame:
    """For each key, the key of the document before it (before the first: the last)."""
    keys = ["numbered", "id", "th"]
    rows = docs.select(*_key()).distinct()
    ordered = stage(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "order")
    here = F.struct(*keys)
    # each part's last key goes to the next part that has rows; the last part's to the first
    ends = ordered.groupBy("part").agg(F.max(here).alias("end"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(by_part), F.last("end").over(whole)).alias("before"))
    inside = ordered.withColumn("prev", F.lag(here).over(Window.partitionBy("part").orderBy(*keys)))
    return (inside.join(ends, "part")
            .select(*keys, F.coalesce("prev", "before").alias("prev"))
            .select(*keys, *(F.col(f"prev.{k}").alias(f"p_{k}") for k in keys)))


def fingerprint_edits(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Sketch every text, its edited text and the likeness to it and to the next document.

    The edited text has its last quarter (code points) replaced by as many from the start
    of the next document by doc_id. Columns: doc_id, n_chars, edited_text, sketch, edited_sketch,
    next_sketch.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = ["numbered", "id_", "th"]
    plain = F.coalesce("id", F.lit(0)).alias("id_")
    rows = docs.select(*_key()).select("numbered", plain, "th")
    # a text goes to its own key and to the key of the document before it, and is sketched at both: the sketch, eight
    # bytes for every kept shingle, would shuffle more than the text
    made = docs.select(*_key(), "text").select("numbered", plain, "th", "text").dropDuplicates(keys)
    before = _previous(docs).select("numbered", plain, "th", "p_numbered", F.coalesce("p_id", F.lit(0)).alias("p_id"),
                                    "p_th")
    ahead = made.join(before, keys).select(F.col("p_numbered").alias("numbered"), F.col("p_id").alias("id_"),
                                           F.col("p_th").alias("th"), F.col("text").alias("next_text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = (made.join(ahead, keys)
              .select(*keys, n.cast("long").alias("n_chars"), sketch(F.col("text"), words, scale).alias("sketch"),
                      sketch(F.col("next_text"), words, scale).alias("next_sketch"),
                      F.concat(F.left(F.col("text"), n - quarter), F.left(F.col("next_text"), quarter))
                      .alias("edited_text"))
              .withColumn("edited_sketch", sketch(F.col("edited_text"), words, scale)))
    return (rows.join(edited, keys)
            .select(F.when(F.col("numbered"), F.col("id_")).alias("doc_id"), "n_chars", "sketch", "next_sketch",
                    "edited_text", "edited_sketch"))
