"""License scans by canonical digest lookup, in Spark SQL functions.

A text is brought into canonical form: lower case, copyright lines dropped, equivalent spellings
made one, everything but letters and digits made one blank. The SHA-256 of the entire
canonical text is joined with the digests of known licences; so is that of every line of
it, for notices that are a line of their own. The known texts are a parameter: a table
of a few rows, whose size is the caller's, not the corpus's.

Defined cases: a null text, or one with nothing left in canonical form, has no digest and no
licence; a licence found in several lines counts once; repeated rows each give a row; a
digest under two names goes to the smaller name; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .license_texts import KNOWN

#: lines dropped before the comparison: who holds the copyright, and rights reserved
COPYRIGHT = (r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\])[^\n]*$"
             r"|^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$")

# Equivalent spellings, the second stands for the first
SPELLINGS = (
    (r"\b(sub|re)?licenc(e|ed|es|ing)\b", r"\1licens\2"),
    (r"\bcopyright holder(s?)\b", r"copyright owner\1"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bhttps\b", "http"),
)


def steps() -> tuple[tuple[str, str], ...]:
    """The replacements in order (back references as ``\\1``), for a lower-case text."""
    return ((COPYRIGHT, " "), (r"[^\p{L}\p{N}\n]+", " "), *SPELLINGS, (r" *\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))


def canonical_lines(text: Column) -> Column:
    """The canonical form of ``text``, its non-empty lines kept apart by line feeds."""
    out = F.lower(text)
    for pattern, new in steps():
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if nothing is left of the text."""
    form = F.translate(canonical_lines(text), "\n", " ")
    return F.when(form != "", F.sha2(form, 256))


def known_digests(docs: DataFrame, known: Iterable[tuple[str, str]]) -> DataFrame:
    rows = docs.sparkSession.createDataFrame(sorted(known), "license string, body string")
    return (rows.select("license", digest(F.col("body")).alias("known")).where("known is not null")
            .groupBy("known").agg(F.min("license").alias("license")))


def scan(docs: DataFrame, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(doc_id, text_digest, license, notices)`` of every row.

    ``license`` names the licence that the entire text is; ``notices`` the sorted names of
    the licences that its lines are, joined by commas (empty if none).
    """
    names = stage(known_digests(docs, known).coalesce(1), "licenses")
    forms = docs.select("doc_id", F.xxhash64("text").alias("th"), canonical_lines(F.col("text")).alias("form"))
    whole = F.translate("form", "\n", " ")
    forms = forms.select("doc_id", "th", "form", F.when(whole != "", F.sha2(whole, 256)).alias("text_digest"))
    lines = F.transform(F.array_distinct(F.split(F.coalesce("form", F.lit("")), "\n")),
                        lambda x: F.struct(F.lit(False).alias("entire"), F.sha2(x, 256).alias("known")))
    entire = F.array(F.struct(F.lit(True).alias("entire"), F.col("text_digest").alias("known")))
    # the lines of a document meet again in its own partition, before the shuffle
    looked = (forms.select("doc_id", "th", "text_digest", F.explode(F.concat(entire, lines)).alias("part"))
              .select("doc_id", "th", "text_digest", "part.entire", "part.known")
              .join(names, "known", "left"))
    found = looked.groupBy("doc_id", "th", "text_digest").agg(
        F.max(F.when(F.col("entire"), F.col("license"))).alias("license"),
        F.collect_set(F.when(~F.col("entire"), F.col("license"))).alias("notices"),
        F.count_if("entire").alias("copies"))
    return (found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "text_digest", "license", F.array_join(F.sort_array("notices"), ",").alias("notices")))


def oracle(known: Iterable[tuple[str, str]] = KNOWN) -> str:
    """The same in DuckDB's SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"lower({x})"
        for pattern, new in steps():
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new)}, 'g')"
        return out

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in sorted(known))
    return f"""
WITH names AS (
  SELECT known, min(license) AS license FROM (
    SELECT license, sha256(replace({form('body')}, chr(10), ' ')) AS known
    FROM (VALUES {values}) AS k(license, body)) GROUP BY known),
forms AS (SELECT doc_id, row_number() OVER () AS r, {form('text')} AS form FROM documents),
whole AS (
  SELECT doc_id, r, form,
         CASE WHEN form <> '' THEN sha256(replace(form, chr(10), ' ')) END AS text_digest FROM forms),
lines AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT r, sha256(unnest(string_split(form, chr(10)))) AS known FROM forms) JOIN names USING (known)
  GROUP BY r)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN names ON text_digest = known LEFT JOIN lines USING (r)"""
