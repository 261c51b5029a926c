"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (given words and words learnt from the labels, in plain or
disguised spelling), how many of them stand near a second-person word, rates of capitals,
exclamation and other punctuation, and of obfuscated words. The trees are Spark ML's
``GBTClassifier``; its margins are calibrated by ``IsotonicRegression`` on rows not seen: the margins that each of
four folds gets from words and trees learnt on the other three. Words and trees for scoring learn from all rows.

Learning reads a bounded, documented sample: ``sample`` labelled rows at most, taken by a hash of
the id. Learnt lexicon entries are words and stems that stand in many toxic rows and in many different
contexts there (so that copies of a text count once) and in hardly any other. Scoring reads every whole text.

Defined cases: a null or empty text has zero features and is scored like any other; an id with
labels of both kinds counts as toxic; null labels and labels without a document are not used; if
there is no label, or only one kind, the score is that of the kind (0 without labels); repeated
rows each give a row; an empty table gives an empty result; a clashing output column is replaced.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash62, share_below, stage, text_slices, word_blocks

SAMPLE = 20_000
FOLDS = 4
NEAR = 6
STEMS = (3, 4, 5, 6)

# Common words of insult in the languages of the corpus, and second-person words
LEXICON = frozenset("""
idiot idiots stupid moron morons trash scum pathetic disgusting clown clowns loser losers worthless dumb
imbecile jerk fool fools scumbag pig pigs filth filthy vermin garbage ugly freak freaks
idiotin dumm dummkopf trottel abschaum erbärmlich widerlich versager wertlos müll
idiote idiots stupide crétin ordure minable dégoûtant clochard nul imbécile racaille
estúpido estúpida imbécil basura escoria patético asqueroso payaso perdedor inútil
""".split())
SECOND = frozenset("""
you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre
vos tú ti tuyo usted ustedes vosotros
""".split())
DISGUISE = str.maketrans("013457@$!|+", "oieastasiit")

FEATURES = ("lexicon", "lexicon_rate", "learnt", "learnt_rate", "disguised", "second_rate", "near_second",
            "capital_rate", "shout_rate", "bang_rate", "mark_rate", "obfuscated_rate", "log_words")

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][\d@$!|+*#]+[^\W_]")
_REPEAT = re.compile(r"(.)\1{2,}")
_MARK = re.compile(r"[^\w\s]")


def core(token: str) -> str:
    """A token in lower case without punctuation at its ends."""
    return _EDGE.sub("", token.lower())


class TokenTable(dict):
    """Token to the number of its facts; cleared when it holds too many. Most tokens share their facts with others."""

    FACTS = 10

    def __init__(self, learnt: frozenset[str], most: int = 400_000) -> None:
        super().__init__()
        self.words = frozenset(f for f in learnt if not f.endswith("*"))
        self.stems = [(k, frozenset(f[:-1] for f in learnt if f.endswith("*") and len(f) == k + 1)) for k in STEMS]
        self.stems = [(k, stems) for k, stems in self.stems if stems]
        self.most = most
        self.kinds: dict[tuple, int] = {}
        self.rows = np.zeros((1024, self.FACTS), dtype=np.float32)

    def learnt(self, word: str) -> bool:
        return word in self.words or any(word[:k] in stems for k, stems in self.stems if len(word) > k)

    def facts(self, text: str) -> tuple:
        """Listed, learnt, disguised, second person, letters, capitals, shouted, ``!`` and ``?``, marks, obfuscated."""
        body, marks, bang = text, 0, 0
        if not text.isalpha() and text[:-1].isalpha() and text[-1] in ",.;:!?":
            body, marks, bang = text[:-1], 1, int(text[-1] in "!?")
        word = body.lower()
        if body.isalpha() and word.isalpha():  # letters and one mark at most: nothing is disguised by other signs
            letters, upper = len(body), 0 if body == word else sum(map(str.isupper, body))
            repeated = _REPEAT.search(word)
            plain, hidden = _REPEAT.sub(r"\1", word) if repeated else word, bool(repeated)
        else:
            word = core(text)
            plain = _REPEAT.sub(r"\1", word.translate(DISGUISE))
            letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
            marks, bang = len(_MARK.findall(text)), text.count("!") + text.count("?")
            hidden = bool(_INNER.search(text) or _REPEAT.search(word))
        listed, learnt = word in LEXICON, self.learnt(word)
        disguised = plain != word and not (listed or learnt) and (plain in LEXICON or self.learnt(plain))
        return (listed, learnt, disguised, word in SECOND, letters, upper, letters >= 3 and upper == letters, bang, marks,
                hidden)

    def __missing__(self, token: bytes) -> int:
        found = self.facts(token.decode())
        at = self.kinds.get(found)
        if at is None:
            at = self.kinds[found] = len(self.kinds)
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = found
        self[token] = at
        return at

    def forget(self) -> None:
        """Make room (also for facts: long odd tokens may each have their own)."""
        self.clear()
        if len(self.kinds) > 1 << 16:
            self.kinds.clear()


def features(texts: list[str | None], table: TokenTable) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        sums, near, n, carry = np.zeros(TokenTable.FACTS), 0.0, 0, np.zeros((0, TokenTable.FACTS), np.float32)
        for block in word_blocks((text or "").encode()):
            if not block:
                continue
            if len(table) > table.most:
                table.forget()
            at = np.fromiter(map(table.__getitem__, block), dtype=np.int64, count=len(block))
            facts = table.rows[at]
            sums += facts.sum(axis=0, dtype=np.float64)
            n += len(block)
            # bad words with a second-person word among the NEAR words on either side
            seen = np.concatenate([carry, facts])
            bad = np.flatnonzero(seen[:, :3].any(axis=1))
            if len(bad):
                you = np.concatenate([[0], np.cumsum(seen[:, 3])])
                lo, hi = np.maximum(bad - NEAR, 0), np.minimum(bad + NEAR + 1, len(seen))
                mine = bad >= len(carry)
                near += float(((you[hi] - you[lo]) > 0)[mine].sum())
            carry = facts[-NEAR:]
        words, letters = max(n, 1), max(sums[4], 1)
        out[i] = (sums[0], sums[0] / words, sums[1], sums[1] / words, sums[2], sums[3] / words, near, sums[5] / letters,
                  sums[6] / words, sums[7] / words, sums[8] / words, sums[9] / words, np.log1p(n))
    return out


def with_features(docs: DataFrame, learnt: frozenset[str], text_col: str = "text", prefix: str = "__f_") -> DataFrame:
    """``docs`` plus a double column for each feature."""
    names, kept = [prefix + f for f in FEATURES], docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches):
        table = TokenTable(learnt)
        for b in text_slices(batches, text_col):
            x = features(b.column(text_col).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[:, i].copy()) for i in range(x.shape[1]))],
                                             names=[*kept, *names])

    return docs.mapInArrow(run, schema)


def forms(word: str) -> list[str]:
    """What of a word can be in a learnt lexicon: itself, and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def learn_words(rows: DataFrame, toxic: list[int], clean: list[int], least: float = 0.01, chance: float = 5e-8,
                doubt: float = 0.02) -> list[frozenset[str]]:
    """Words and stems of ``rows(text, toxic, fold)`` that mark the toxic rows: without each fold, and from all.

    ``toxic`` and ``clean`` are the numbers of rows without each fold, and of all.
    A form is learnt if ``least`` of the toxic rows have it (near copies count once), in as many
    different contexts (word and next word), and the clean rows with it are at most ``doubt`` of that; and if rows drawn
    without regard to the labels would all be toxic with less than ``chance``. The first
    condition bounds the lexicon, whatever the corpus; the last keeps chance finds of small samples out.
    """
    def contexts(batches):
        for b in text_slices(batches, "text", 1 << 19):
            bad: set[tuple[str, str, int, int]] = set()
            good: dict[tuple[str, int], int] = {}
            for text, toxic_row, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                tokens = (text or "").split()
                known = {t: core(t) for t in set(tokens)}
                seen = {f for w in known.values() if w for f in forms(w)}
                if not toxic_row:
                    for f in seen:
                        good[f, fold] = good.get((f, fold), 0) + 1
                    continue
                words = [w for t in tokens if (w := known[t])]
                # near copies mostly share the smallest hash of their three-word shingles
                copy = min((zlib.crc32(" ".join(x).encode()) for x in zip(words, words[1:], words[2:], strict=False)),
                           default=zlib.crc32(" ".join(words).encode()))
                bad.update(("text", f, copy, fold) for f in seen)
                for w, after in set(pairwise([*words, ""])):
                    at = zlib.crc32(f"{w} {after}".encode())
                    bad.update(("context", f, at, fold) for f in forms(w))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in bad] + ["clean"] * len(good), pa.string()),
                 pa.array([x[1] for x in bad] + [x[0] for x in good], pa.string()),
                 pa.array([x[2] for x in bad] + list(good.values()), pa.int64()),
                 pa.array([x[3] for x in bad] + [x[1] for x in good], pa.int32())], names=["kind", "form", "n", "fold"])

    found = stage(rows.mapInArrow(contexts, "kind string, form string, n bigint, fold int"), "contexts")
    lefts = [i for i in range(len(toxic)) if toxic[i] and clean[i]]
    # the folds that a text or context is met in, as bits
    met = (found.where("kind <> 'clean'").groupBy("kind", "form", "n")
           .agg(F.expr("bit_or(shiftleft(1, fold))").alias("folds")))
    here = lambda i: F.col("folds").bitwiseAND(~(1 << i)) != 0
    bad = met.groupBy("form").agg(*(F.count_if((F.col("kind") == kind) & here(i)).alias(f"{kind}{i}")
                                    for i in lefts for kind in ("text", "context")))
    good = (found.where("kind = 'clean'").groupBy("form")
            .agg(*(F.sum(F.when(F.col("fold") != i, F.col("n")).otherwise(0)).alias(f"good{i}") for i in lefts)))
    enough = {i: float(max(np.log(chance) / np.log(toxic[i] / (toxic[i] + clean[i])), least * toxic[i])) for i in lefts}
    often = {i: (F.col(f"text{i}") >= enough[i]) & (F.col(f"context{i}") >= enough[i]) for i in lefts}
    marks = {i: often[i] & (F.coalesce(f"good{i}", F.lit(0)) <= doubt * F.col(f"text{i}")) for i in lefts}
    frequent = bad.where(F.array_contains(F.array(*often.values()), True))
    kept = (frequent.join(good, "form", "left").select("form", *(m.alias(f"in{i}") for i, m in marks.items()))
            .where(F.array_contains(F.array(*(F.col(f"in{i}") for i in lefts)), True)).collect())
    return [frozenset(r["form"] for r in kept if i in marks and r[f"in{i}"]) for i in range(len(toxic))]


class Model:
    """Learnt words, trees and calibration; ``constant`` stands in when there is nothing to learn."""

    def __init__(self, learnt=frozenset(), trees=None, steps=None, constant: float = 0.0) -> None:
        self.learnt, self.trees, self.steps, self.constant = learnt, trees, steps, constant


def _margins(rows: DataFrame, trees) -> DataFrame:
    assembled = VectorAssembler(inputCols=["__f_" + f for f in FEATURES], outputCol="__x").transform(rows)
    judged = trees.transform(assembled)
    return judged.withColumn("__margin", vector_to_array("__raw")[1]).drop("__x", "__raw", "__probability", "__predicted")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    marks = (labels.where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    total = marks.count()
    marks = stage(marks.where(hash62("doc_id") < share_below(sample, total)).coalesce(1), "marks")
    # about ``sample`` rows of two numbers: small whatever the corpus
    rows = stage(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
                 .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "labelled")
    n = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    kinds = {t for t, _ in n}
    if len(kinds) < 2:
        return Model(constant=float(max(kinds, default=0)))
    # rows of each kind without fold 0, 1, ... and, last, of all folds
    clean, toxic = ([sum(x for (t, f), x in n.items() if t == kind and f != left) for left in range(FOLDS + 1)]
                    for kind in (0, 1))
    lexicons = learn_words(rows.select("text", "toxic", "fold"), toxic, clean)
    # written by as many tasks as there are, then few partitions for the trees
    fit = stage(_fold_features(rows.select("toxic", "fold", "text"), lexicons), "features").coalesce(4)
    inputs = VectorAssembler(inputCols=["__f_" + f for f in FEATURES], outputCol="__x")

    def trees(left: int):
        part = fit.where((F.col("without") == left) & (F.col("fold") != left))
        part = part.withColumn("weight", F.when(F.col("toxic") == 1, clean[left] / max(toxic[left], 1)).otherwise(1.0))
        model = GBTClassifier(featuresCol="__x", labelCol="toxic", weightCol="weight", maxDepth=3, maxIter=20, stepSize=0.3, minInstancesPerNode=10,
                              predictionCol="__predicted", seed=5)
        return (model.setRawPredictionCol("__raw").setProbabilityCol("__probability")
                .fit(inputs.transform(part)))

    unseen = None
    for left in range(FOLDS):
        calm = fit.where((F.col("without") == left) & (F.col("fold") == left))
        if toxic[left] and clean[left]:
            calm = _margins(calm, trees(left))
        else:  # the other folds are all of one kind, or without rows
            calm = calm.withColumn("__margin", F.lit(float(np.sign(toxic[left] - clean[left]))))
        calm = calm.select("__margin", F.col("toxic").cast("double").alias("toxic"))
        unseen = calm if unseen is None else unseen.union(calm)
    steps = IsotonicRegression(featuresCol="__margin", labelCol="toxic", predictionCol="__score").fit(unseen)
    return Model(lexicons[-1], trees(FOLDS), (steps.boundaries.toArray(), steps.predictions.toArray()))


def _fold_features(rows: DataFrame, lexicons: list[frozenset[str]]) -> DataFrame:
    """``rows(toxic, fold, text)`` as ``(toxic, fold, without)`` and features, once by each of ``lexicons``."""
    names, unlike = ["__f_" + f for f in FEATURES], sorted(set(lexicons), key=sorted)

    def run(batches):
        tables = [TokenTable(x, 400_000 // len(unlike)) for x in unlike]
        for b in text_slices(batches, "text"):
            texts = b.column("text").to_pylist()
            made = [features(texts, t) for t in tables]
            for left, lexicon in enumerate(lexicons):
                x = made[unlike.index(lexicon)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("toxic"), b.column("fold"), pa.array([left] * len(texts), pa.int32()),
                     *(pa.array(x[:, i].copy()) for i in range(x.shape[1]))], names=["toxic", "fold", "without", *names])

    return rows.mapInArrow(run, "toxic int, fold int, without int, " + ", ".join(f"{n} double" for n in names))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more)."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    if model.trees is None:
        value = F.lit(model.constant)
        return docs.withColumn("score", value).withColumn("predicted", (value >= 0.5).cast("int"))
    x, y = model.steps
    judged = _margins(with_features(docs, model.learnt, text_col), model.trees)
    return (judged.withColumn("score", _between(F.col("__margin"), x.tolist(), y.tolist()))
            .select(*(F.col(f"`{c}`") for c in names), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def _between(at, x: list[float], y: list[float]):
    """Linear interpolation of the calibration steps (few: one for each distinct level)."""
    bends = [(F.lit(a), F.lit(b), F.lit(c), F.lit(d)) for a, b, c, d in
             zip(x[:-1], y[:-1], x[1:], y[1:], strict=True) if c > a]
    value = F.when(at <= x[0], F.lit(y[0]))
    for a, b, c, d in bends:
        value = value.when(at <= c, b + (d - b) * (at - a) / (c - a))
    return F.least(F.greatest(value.otherwise(F.lit(y[-1])), F.lit(0.0)), F.lit(1.0))
