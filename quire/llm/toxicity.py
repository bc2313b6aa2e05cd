"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc_remainder, small_batches, stored

#: Labelled documents that the model learns from, about; with more, a hash of the id picks them.
SAMPLE = 16_000
#: What makes a word of the sample one of the lexicon: it is ODDS times likelier in toxic documents, and SURE standard
#: errors of the log odds away from being as likely in clean ones. All such words are kept.
ODDS, SURE = 20.0, 2.5
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Words between a lexicon word and a form of address, at most.
NEAR = 5
PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_|/\\~`"
# Forms of address in English, German, Spanish and French.
SECOND_PERSON = frozenset("you your yours yourself you're youre u ur du dich dir dein deine deinen ihr euch euer sie tú tu tus te ti usted ustedes vosotros os vuestro toi ton ta tes vous votre vos".split())
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
NAMES = ("density", "hits", "weight_density", "weight", "distinct", "near_density", "near", "capitals", "exclamations", "questions", "punctuation", "disguised", "disguised_hits", "length")


def tokens(text: str | None) -> list[str]:
    return [w.strip(PUNCTUATION) for w in (text or "").lower().split()]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The values of NAMES."""
    text = text or ""
    found = tokens(text)
    n = max(len(found), 1)
    hits = [(i, w) for i, w in enumerate(found) if w in lexicon]
    odd = [w for w in found if w and not w.isalpha() and any(map(str.isalpha, w)) and not w.replace("'", "").replace("-", "").isalpha()]
    plain = [p for w in odd if w not in lexicon and (p := w.translate(DISGUISE)) in lexicon]
    weights = [lexicon[w] for _, w in hits] + [lexicon[p] for p in plain]
    near = sum(any(w in SECOND_PERSON for w in found[max(0, i - NEAR) : i + NEAR + 1]) for i, _ in hits)
    data = np.frombuffer(text.encode(), np.uint8)
    size = max(len(data), 1)
    capitals = int(((data >= 65) & (data <= 90)).sum())
    marks = int((((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))).sum())
    return [
        len(hits) / n, math.log1p(len(hits)), sum(weights) / n, math.log1p(sum(weights)), float(len({w for _, w in hits})), near / n, math.log1p(near),
        capitals / size, text.count("!") / n, text.count("?") / n, marks / size, len(odd) / n, float(len(plain)), math.log1p(len(found)),
    ]


def learn_lexicon(labelled: DataFrame, odds: float = ODDS, sure: float = SURE) -> dict[str, float]:
    """Words surely more frequent in toxic documents, with their log odds; labelled, of bounded size: text, toxic.

    A word counts once a document; counts are combined in the tasks, then over the cluster, and words reach the driver.
    """

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({w for w in tokens(text) if w})
        words = list(seen[0] | seen[1])
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words), *[pa.array([seen[k][w] for w in words], pa.int64()) for k in (0, 1)]], ["word", "clean", "toxic"])

    total = labelled.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    bad, good = total["toxic"] or 0, total["n"] - (total["toxic"] or 0)
    counts = small_batches(labelled).select("text", "toxic").mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    log_odds = F.ln((F.col("toxic") + 0.5) / (bad + 1)) - F.ln((F.col("clean") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = counts.withColumn("odds", log_odds).filter((F.col("odds") >= math.log(odds)) & (F.col("odds") >= sure * error)).collect()
    return {r["word"]: r["odds"] for r in sorted(kept, key=lambda r: r["word"])}


class ToxicityModel:
    """Trees and their calibration; without both classes to learn from, a constant."""

    def __init__(self, lexicon: dict[str, float], constant: float, trees=None, calibration=None):
        self.lexicon, self.constant, self.trees, self.calibration = lexicon, constant, trees, calibration

    def score(self, docs: DataFrame, text: Column, key: Column) -> DataFrame:
        """(doc_id, score) of every row."""
        if not self.trees:
            return docs.select(key.alias("doc_id"), F.lit(self.constant).alias("score"))
        rows = _vectors(docs.select(key.alias("doc_id"), F.lit(0).alias("toxic"), text.alias("text")), self.lexicon)
        margin = self.trees.transform(rows).select("doc_id", array_to_vector(F.array(vector_to_array("probability")[1])).alias("features"))
        if not self.calibration:
            return margin.select("doc_id", vector_to_array("features")[0].alias("score"))
        return self.calibration.transform(margin).select("doc_id", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _vectors(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            found = [features(t, shared.value) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "values"])

    return small_batches(rows).select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(run, "doc_id long, label int, values array<double>").select("doc_id", F.col("label").cast("double"), array_to_vector("values").alias("features"))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, rounds: int = 20, depth: int = 3) -> ToxicityModel:
    """Learns the lexicon and trees from four fifths of the sampled labels' documents, the calibration from the rest.

    docs: doc_id, text; labels: doc_id, toxic. The sampled labels, about `sample` of them, are broadcast, so texts are
    filtered where they are read and never shuffled.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = known.count()
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(n, 1))))
    rows = stored(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text"))
    part = crc_remainder(F.col("doc_id"), 5) == 4
    base = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    constant = ((base[0] or 0) + 1) / (base[1] + 2)
    split = {r["part"]: (r["bad"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    bad, total = split.get(False, (0, 0))
    if not 0 < bad < total:
        return ToxicityModel({}, constant)
    lexicon = learn_lexicon(rows.filter(~part))
    vectors = stored(_vectors(rows, lexicon))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7).fit(vectors.filter(~part))
    bad, total = split.get(True, (0, 0))
    if not 0 < bad < total:
        return ToxicityModel(lexicon, constant, trees)
    margin = trees.transform(vectors.filter(part)).select("label", array_to_vector(F.array(vector_to_array("probability")[1])).alias("features"))
    return ToxicityModel(lexicon, constant, trees, IsotonicRegression().fit(margin))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Rows whose crc32 of the id leaves 2 modulo 4 are held out of learning. Null and empty texts are scored by their
    features like any other; a label that is null or has no document is not used, and of several labels of a document
    the toxic one holds; if only one class is known, every score is its smoothed share; repeated rows are scored each;
    an empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    train = crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    model = fit(rows, labels.select(F.col("doc_id").cast("long"), "toxic").filter(train))
    found = model.score(rows, F.col("text"), F.col("doc_id"))
    return found.select("doc_id", (~train).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
