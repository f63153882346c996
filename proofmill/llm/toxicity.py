"""Toxicity by gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: density and weight of lexicon terms, their strongest weight, how many stand near a word of the second person, how many are
only recognised after undoing obfuscation, and rates of capitals, punctuation, exclamations and obfuscated words.

The lexicon is learned from the training rows: words and word beginnings that are much more frequent (by documents) among toxic
ones. Trees are fitted on three quarters of the training rows, the isotonic curve on the last quarter. The score is the calibrated
probability, with a small share of the trees' own probability that keeps the order within its steps.

Training takes at most TRAIN_ROWS labelled rows (the smallest hashes of their ids), of which only ids and labels are broadcast. Everything else covers
all rows: one pass computes the features, a second pass over these alone scores them; nothing is shuffled.

Defined results: null and empty texts get the score of a text without features; with no training row of one of the two labels, every score is
that label's share; labels other than 0 and 1 do not count; a document labelled twice counts as toxic if one of them says so; repeated
rows each get their own result; columns beyond the id and the text are never read.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import computed, text_or_empty, written

TRAIN_ROWS = 20_000
TREES, DEPTH, STEP = 24, 4, 0.25
THRESHOLD = 0.7
TIE_SHARE = 0.05
NEAR_WORDS = 5
#: A lexicon term stands in at least LEAST_DOCS toxic training documents and is exp(LEAST_ODDS) times as frequent there; at most MOST_TERMS are kept.
LEAST_DOCS, LEAST_ODDS, MOST_TERMS = 4, 2.0, 3000
BEGINNINGS = (4, 5, 6, 7)
MEMORY_WORDS = 400_000
#: Signs that stand for letters, and words of the second person.
DISGUISES = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})
SECOND_PERSON = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vos"}
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_LETTERS = re.compile(r"[\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_][@4310$57+!*.\-_]+[^\W\d_]")
FEATURES = ("log_words", "density", "weight", "strongest", "hits", "near_second_person", "second_person", "undone", "disguised", "capitals", "shouted_words", "exclamations", "punctuation", "digits")


def plain(word: str) -> str:
    """The letters of a word, lower-cased."""
    return NOT_LETTERS.sub("", word).lower()


def undisguised(word: str) -> str:
    """The letters of a word after signs that stand for letters inside it were put back, lower-cased."""
    core = word.strip(".,;:!?\"'()[]")
    return NOT_LETTERS.sub("", core.translate(DISGUISES)).lower()


def terms_of(word: str) -> set[str]:
    """A plain word as a whole (marked by a space) and its beginnings."""
    return {word + " "} | {word[:n] for n in BEGINNINGS if len(word) >= n} if word else set()


class Words(dict):
    """What each distinct word contributes: (weight, second person, undone, disguised, all capitals); remembered within a bound."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)

    def __missing__(self, word: str):
        if len(self) >= MEMORY_WORDS:
            self.clear()
        own = plain(word)
        weight, undone = self.weight(own), 0.0
        disguised = 1.0 if DISGUISED.search(word) else 0.0
        if disguised and not weight:
            weight = self.weight(undisguised(word))
            undone = float(weight > 0)
        value = self[word] = (weight, float(own in SECOND_PERSON), undone, disguised, float(len(word) > 1 and word.isupper()))
        return value


def share(data: bytes, signs: bytes) -> float:
    return (len(data) - len(data.translate(None, signs))) / len(data)


def features(text: str | None, words: Words) -> list[float]:
    """The values of FEATURES."""
    t = text_or_empty(text)
    ws = t.split()
    if not ws:
        return [0.0] * len(FEATURES)
    weight, second, undone, disguised, shouted = np.array([words[w] for w in ws]).T
    n, data = len(ws), t.encode("utf-8", "surrogatepass")
    hits = weight > 0
    reach = np.cumsum(np.concatenate([np.zeros(NEAR_WORDS + 1), second, np.zeros(NEAR_WORDS)]))
    near = hits & (reach[2 * NEAR_WORDS + 1 :] - reach[: -2 * NEAR_WORDS - 1] > 0)
    return [log(n), hits.sum() / n, weight.sum() / n, weight.max(), float(hits.sum()), near.sum() / n, second.sum() / n, undone.sum() / n, disguised.sum() / n,
            share(data, UPPER), shouted.sum() / n, share(data, b"!"), share(data, b".,;:?"), share(data, b"0123456789")]


def training_rows(labels: DataFrame, id_col: str, label_col: str, allowed, train_rows: int) -> DataFrame:
    """(row_id, label, part) of the bounded sample; part 3 of 0 to 3 is for calibration."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & allowed).groupBy(F.col(id_col).cast("bigint").alias("row_id")).agg(F.max(label_col).cast("double").alias("label"))
    order = F.xxhash64("row_id")
    return marks.orderBy(order, "row_id").limit(train_rows).withColumn("part", F.pmod(F.xxhash64(order), F.lit(4)))


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Terms and their log-odds from training rows (label, the_text); document frequencies are summed by Spark."""

    def count(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for label, text in zip(batch["label"].astype(int), batch["the_text"]):
                ws = {plain(w) for w in set(text_or_empty(text).split())}
                for term in set().union(*map(terms_of, ws)):
                    found.setdefault(term, [0, 0])[label] += 1
            yield pd.DataFrame([(t, *n) for t, n in found.items()], columns=["term", "clean", "toxic"])

    totals = {int(r.label): r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {}
    counts = texts.select("label", "the_text").mapInPandas(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    kept = counts.where(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r.term: r.odds for r in kept.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(MOST_TERMS).collect()}


def with_features(texts: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(row_id, features) from (row_id, the_text)."""
    held = texts.sparkSession.sparkContext.broadcast(lexicon)

    def counted():
        words = Words(held.value)
        return lambda rows: [[float(x) for x in features(t, words)] for t in rows]

    return computed(texts.select("row_id", "the_text"), "the_text", "features", "array<double>", counted).select("row_id", "features")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", allowed=None, threshold: float = THRESHOLD,
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(row_id, score, predicted) of every row of docs. allowed: a condition on the labels' rows that may be learned from."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("the_text"))
    sample = written(training_rows(labels, id_col, label_col, F.lit(True) if allowed is None else allowed, train_rows), "toxicity-sample")
    fitted = sample.where("part < 3")
    lexicon = learn_lexicon(texts.join(F.broadcast(fitted), "row_id"))  # train_rows rows at most
    table = written(with_features(texts, lexicon), "toxicity-features")
    train = table.join(F.broadcast(sample), "row_id").select("label", "part", array_to_vector("features").alias("vector")).coalesce(4).cache()
    shares = train.groupBy().agg(*(F.count_if((F.col("part") < 3) & (F.col("label") == x)).alias(f"n{x}") for x in (0, 1))).first()
    if min(shares) == 0:
        return table.select("row_id", F.lit(float(shares.n1 > 0)).alias("score"), F.lit(int(shares.n1 > 0 and threshold <= 1)).alias("predicted"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=5, subsamplingRate=1.0).setProbabilityCol("chance").fit(train.where("part < 3"))
    chance = vector_to_array("chance")[1]
    calibration = trees.transform(train.where("part = 3")).select("label", chance.alias("raw"))
    if calibration.isEmpty():
        calibration = trees.transform(train).select("label", chance.alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(calibration)
    raw = trees.transform(table.select("row_id", array_to_vector("features").alias("vector"))).select("row_id", chance.alias("raw"))
    scored = curve.transform(raw).select("row_id", ((1 - TIE_SHARE) * F.col("calibrated") + TIE_SHARE * F.col("raw")).alias("score"))
    train.unpersist()
    return scored.select("row_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
