"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are densities of a lexicon learned from labelled rows (words and word beginnings),
nearness of its words to second-person words, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrow import batched, with_fields
from proofmill.tables import cut

WORD = re.compile(r"[^\W\d_]+")
#: Letters mixed with digits or signs that stand for letters.
DISGUISED = re.compile(r"\b(?=\w*[^\W\d_])[^\W_]*[013457@$][^\W_]*[^\W\d_]+\b")
SPACED = re.compile(r"\b(?:[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
SIGNS = str.maketrans("013457@$", "oieastas")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
LOUD = re.compile(r"[!?]{2,}")
#: Second-person words of common languages.
SECOND = frozenset("you your yours yourself u ur tu te toi ton vous votre vos du dich dir dein deine euch ihr usted ustedes tus vosotros os".split())
#: Lengths of word beginnings that the lexicon may hold.
STEMS = (4, 5, 6)
NEAR = 5
#: Words whose weights a worker keeps, and the range of the hash that chooses the sample.
KEPT, RANGE = 150_000, 1 << 62
FEATURES = ["words", "hits", "hit_rate", "strength", "stem_hits", "stem_rate", "near_second", "second_rate", "capitals", "punctuation", "loud", "disguised", "disguised_hits", "spaced"]


class _Weights(dict):
    """Weights of words, kept as they come: the word's own, or that of its strongest beginning; kinds 1 and 2."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> tuple[float, int]:
        own = self.words.get(word, 0.0)
        stem = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), default=0.0)
        out = (own, 1) if own else (stem, 2) if stem else (0.0, 0)
        if len(self) > KEPT:
            self.clear()
        self[word] = out
        return out


def features(text: str, weights: _Weights) -> list[float]:
    """The values of ``FEATURES`` for a whole text; an empty text has zeros."""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words) or 1
    found = list(map(weights.__getitem__, words))
    hits = [i for i, (w, _) in enumerate(found) if w]
    own = sum(found[i][1] == 1 for i in hits)
    second = [i for i, w in enumerate(words) if w in SECOND] if not SECOND.isdisjoint(words) else []
    near = 0
    if hits and second:
        at, marks = np.array(hits), np.array(second)
        k = np.searchsorted(marks, at)
        near = int((np.minimum(np.abs(at - marks[np.clip(k, 0, len(marks) - 1)]), np.abs(at - marks[np.clip(k - 1, 0, len(marks) - 1)])) <= NEAR).sum())
    letters = sum(map(len, words)) or 1
    disguised = DISGUISED.findall(low)
    hidden = sum(bool(weights[w.translate(SIGNS)][0]) for w in disguised)
    spaced = SPACED.findall(low)
    return [math.log1p(len(words)), len(hits), len(hits) / n, sum(found[i][0] for i in hits), len(hits) - own, (len(hits) - own) / n, near, len(second) / n,
            len(CAPITAL.findall(text)) / letters, (len(text) - letters) / (len(text) or 1), len(LOUD.findall(text)) / n, len(disguised) / n, hidden, len(spaced) / n]


def with_features(docs: DataFrame, words: dict[str, float], stems: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` without the text, with a double column for each feature; null texts count as empty."""
    kept = docs.select(*[c for c in docs.columns if c not in FEATURES and c != text], text)
    names = [c for c in kept.columns if c != text]
    cache: list[_Weights] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(_Weights(words, stems))
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        values = np.array([features(t or "", cache[0]) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        own = [batch.column(batch.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(values[:, i]) for i in range(len(FEATURES)))], names=[*names, *FEATURES])

    return kept.mapInArrow(batched(2000, run), with_fields(kept.select(*names).schema, **dict.fromkeys(FEATURES, "double")))


def learn_lexicon(sample: DataFrame, text: str = "text", label: str = "label", least: int = 4, odds: float = 3.0, terms: int = 5000) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that mark label 1, with log-odds as weights; at most ``terms`` of each.

    A term needs ``least`` documents of label 1 and log-odds of ``odds`` over the documents of label 0.
    Counts are of documents, summed within each batch before they are shuffled.
    """

    def count(batches):
        for batch in batches:
            both: tuple[dict, dict] = ({}, {})
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((t or "").lower()))
                for term in words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}:
                    both[y][term] = both[y].get(term, 0) + 1
            names = sorted(both[1].keys() | both[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[1].get(x, 0) for x in names], pa.int64()), pa.array([both[0].get(x, 0) for x in names], pa.int64())], names=["term", "ones", "zeros"])

    totals = sample.agg(F.sum(label).alias("ones"), F.count("*").alias("n")).first()
    ones, zeros = totals["ones"] or 0, totals["n"] - (totals["ones"] or 0)
    counts = sample.select(F.col(text), F.col(label)).mapInArrow(count, "term string, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    weight = F.log((F.col("ones") + 0.5) / (ones + 1.0)) - F.log((F.col("zeros") + 0.5) / (zeros + 1.0))
    strong = counts.where(F.col("ones") >= least).select("term", weight.alias("weight"), F.col("term").endswith("*").alias("stem"), "ones").where(F.col("weight") >= odds)
    out: tuple[dict, dict] = ({}, {})
    for stem in (False, True):
        for r in strong.where(F.col("stem") == stem).orderBy(F.desc(F.col("weight") * F.col("ones")), "term").limit(terms).collect():
            out[stem][r["term"].rstrip("*")] = r["weight"]
    return out


@dataclass
class ToxicityModel:
    """A learned lexicon, trees and calibration; ``constant`` is the score where one class alone was seen."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    constant: float = 0.0


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def _raw(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 20_000, trees: int = 15, depth: int = 3) -> ToxicityModel:
    """Learn from at most about ``sample_rows`` labelled keys (the documented bound), chosen by a hash of ``key``.

    A third of the sample is kept from the lexicon and the trees, for the calibration. Rows with a
    null key or label are left out; of repeated labels the largest counts, and of the texts of a
    repeated key that of the smallest hash, so that no key brings more than one row.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = min(1.0, sample_rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("key"), F.lit(RANGE)) < int(RANGE * share))
    # about sample_rows rows of 16 bytes: small enough for every executor
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    sample = cut(found.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    later = F.pmod(F.xxhash64("key", F.lit("calibrate")), F.lit(3)) == 0
    seen = {(r["later"], r["label"]) for r in sample.groupBy(later.alias("later"), "label").count().collect()}
    if len(seen) < 4:
        mean = sample.agg(F.avg("label").alias("m")).first()["m"]
        return ToxicityModel(constant=float(mean or 0.0))
    words, stems = learn_lexicon(sample.where(~later))
    table = cut(_vectors(with_features(sample.select("key", "label", later.alias("later"), "text"), words, stems)).select("key", "later", F.col("label").cast("double").alias("label"), "features").orderBy("key"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(table.where(~F.col("later")))
    calibration = IsotonicRegression(featuresCol="raw").fit(_raw(model, table.where("later")))
    return ToxicityModel(words, stems, model, calibration)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score`` (0 to 1) from the whole text; null texts count as empty.

    All other columns and all rows stay, whatever their names; a column ``score`` is replaced.
    Repeated rows get equal scores; an empty table stays empty.
    """
    if model.trees is None:
        return docs.drop(text, "score").withColumn("score", F.lit(model.constant))
    # columns travel under names that neither a feature nor a model has
    names = {f"own_{i}": c for i, c in enumerate(c for c in docs.columns if c not in (text, "score"))}
    kept = docs.select(*(F.col(c).alias(n) for n, c in names.items()), F.col(text).alias("text"))
    raw = _raw(model.trees, _vectors(with_features(kept, model.words, model.stems)))
    calibrated = model.calibration.transform(raw)
    return calibrated.select(*(F.col(n).alias(c) for n, c in names.items()), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))
