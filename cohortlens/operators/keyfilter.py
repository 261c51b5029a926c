"""A Bloom filter of a set of keys, as a table of 64-bit words.

Every key sets four bits of one word; the word's number and the bits come from its hash. The filter is built by
one partial and final aggregate (``bit_or`` by word) and probed by a join on the word number, both inside generated
code. It holds ``MOST_WORDS`` words at most, whatever the set, so that its broadcast is bounded; a fuller filter
lets more keys through but never loses one. What passes still needs the exact join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 20  # 16 MB as rows of two longs
KEYS_PER_WORD = 4


@dataclass
class KeyFilter:
    """``words(__word_no, __word)`` and the count of word numbers that it was built for."""

    words: DataFrame
    size: int

    def _hits(self, table: DataFrame, key: str, how: str) -> DataFrame:
        word_no, mask = _place(key, self.size)
        return (table.withColumns({"__no": word_no, "__mask": mask})
                .join(F.broadcast(self.words), F.col("__no") == F.col("__word_no"), how))

    def passing(self, table: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be in the set (all that are, few others); rows without a key don't pass."""
        return (self._hits(table, key, "inner")
                .where(F.col("__word").bitwiseAND(F.col("__mask")) == F.col("__mask")).select(*table.columns))

    def stopped(self, table: DataFrame, key: str) -> DataFrame:
        """The other rows: their key is certainly not in the set, or missing."""
        hit = F.coalesce(F.col("__word").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
        return self._hits(table, key, "left").where(~hit).select(*table.columns)


def _place(key: str, size: int) -> tuple[Column, Column]:
    """Word number and bits of a key; null for a null key."""
    present = f"`{key}` IS NOT NULL"
    mask = " | ".join(f"shiftleft(1L, CAST(shiftright(xxhash64(`{key}`, 'bits'), {6 * i}) & 63 AS INT))" for i in range(4))
    return (F.expr(f"IF({present}, pmod(xxhash64(`{key}`), {size}L), NULL)"), F.expr(f"IF({present}, {mask}, NULL)"))


def build(keys: DataFrame, key: str, n: int) -> KeyFilter:
    """Filter of the about ``n`` keys in ``keys``."""
    size = 1 << min(max(n // KEYS_PER_WORD, 64).bit_length(), MOST_WORDS.bit_length() - 1)
    word_no, mask = _place(key, size)
    words = (keys.where(F.col(key).isNotNull()).select(word_no.alias("__word_no"), mask.alias("__mask"))
             .groupBy("__word_no").agg(F.bit_or("__mask").alias("__word")))
    return KeyFilter(words, size)


def broadcast_by_spark(frame: DataFrame) -> bool:
    """Whether Spark's own threshold lets it broadcast ``frame`` (then a join needs no filter before it)."""
    most = int(frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 <= size <= most
