"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A sentence's logit is a bias plus the weights of its distinct words; a word's weight is the sum over its hashed
character n-grams, none negative, so that harmless words around an insult do not excuse it. A document is clean if all
its sentences are: P(toxic) = 1 - prod(1 - p). The loss on document labels goes back through the noisy-or to the
sentences, so only sentences that explain a label gain weight, and the same scores say which sentences offend.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.textlinear import descend, features, labelled_sample, mapped

SIZES, WIDTH = (4, 5), 1 << 18
SAMPLE = 1500
THRESHOLD = 0.3
_STEPS, _RATE = 120, 0.1
#: The L1 penalty of a weight, as a share of what one toxic document weighs.
_SPARSE = 0.3
_KEPT = 400_000
_ENDS = re.compile(r"[.!?\n。।]+")
_STRIP = "'\"()[]{},;:*#$%&|<>_-+/\\=~^`¿¡«»“”‘’…"


def sentences(text: str) -> list[str]:
    return [s for s in _ENDS.split(text.lower()) if s and not s.isspace()]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        table, bias = model.weights.tolist(), model.bias

        class Words(dict):
            def __missing__(self, word: str) -> float:
                value = sum(map(table.__getitem__, word_features(word)))
                if len(self) < _KEPT and len(word) <= 64:
                    self[word] = value
                return value

        self._weight, self._bias = Words().__getitem__, bias

    def logit(self, sentence: str) -> float:
        return self._bias + sum(map(self._weight, set(sentence.split())))

    def score(self, text: str | None) -> float:
        """0 for a text without sentences."""
        clean = 0.0
        for s in sentences(text or ""):
            z = self.logit(s)
            clean += z if z > 30 else math.log1p(math.exp(z))
        return -math.expm1(-clean)

    def worst(self, text: str | None) -> tuple[int, int, float]:
        """Bounds in code points of the most offending sentence, and its score; (0, 0, 0) without one."""
        best, at = (0, 0, 0.0), 0
        for m in [*_ENDS.finditer(text or ""), None]:
            end = m.start() if m else len(text or "")
            if end > at:
                z = self.logit(text[at:end].lower())
                if (p := 1 / (1 + math.exp(-max(-700.0, z)))) > best[2]:
                    best = (at, end, p)
            at = m.end() if m else at
        return best


def word_features(word: str) -> list[int]:
    word = word.strip(_STRIP)
    return sorted({*features(word, SIZES, WIDTH), *features(word, (len(word.encode("utf-8", "replace")) + 2,), WIDTH)}) if word else []


def fit(texts: list[str | None], toxic: list[int], weights: list[float]) -> Model:
    """``weights``: how many rows of the corpus each row stands for. With no or one class the score is constant."""
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(WIDTH), 30.0 if len(y) and y.min() > 0 else -30.0)
    words: dict[str, int] = {}
    word_ids, sentence_starts, doc_starts = array("i"), array("i"), array("i")  # 4 bytes each: the driver is small
    for text in texts:
        doc_starts.append(len(sentence_starts))
        for s in sentences(text or ""):
            sentence_starts.append(len(word_ids))
            word_ids.extend(words.setdefault(w, len(words)) for w in set(s.split()))
    flat, sizes = array("i"), array("i")
    for w in words:
        found = word_features(w)
        flat.extend(found)
        sizes.append(len(found))
    count = len(words)
    words.clear()
    feature_id, ids = np.array(flat, np.int32), np.array(word_ids, np.int32)
    feature_word = np.repeat(np.arange(count, dtype=np.int32), sizes)
    sentence_of = np.repeat(np.arange(len(sentence_starts), dtype=np.int32), np.diff(np.array(sentence_starts), append=len(ids)))
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(np.array(doc_starts), append=len(sentence_starts)))
    n, w = len(y), np.array(weights) / np.sum(weights)
    # a feature that a single sentence has explains no other
    rare = np.bincount(feature_id, np.bincount(ids, minlength=count)[feature_word], WIDTH) < 2
    penalty = _SPARSE * w[y > 0].mean()
    start = np.zeros(WIDTH + 1)
    start[-1] = math.log(max(1e-4, float(w @ y)) / max(1.0, len(sentence_of) and doc_of.size / n)) - 1

    def gradient(x: np.ndarray) -> np.ndarray:
        value = np.bincount(feature_word, x[feature_id], count)
        z = x[-1] + np.bincount(sentence_of, value[ids], len(sentence_starts))
        clean = np.bincount(doc_of, np.logaddexp(0, z), n)
        # d loss / d clean: 1 for a clean document, -exp(-clean)/(1-exp(-clean)) for a toxic one
        slope = w * np.where(y > 0, -1 / np.expm1(np.clip(clean, 1e-9, 700)), 1.0)
        dz = slope[doc_of] / (1 + np.exp(-z))
        by_word = np.bincount(ids, dz[sentence_of], count)
        g = np.append(np.bincount(feature_id, by_word[feature_word], WIDTH), dz.sum())
        g[:-1] += penalty
        g[:-1][rare] = 0
        return g

    least = np.zeros(WIDTH + 1)
    least[-1] = -np.inf
    x = descend(gradient, start, _STEPS, _RATE, least)
    return Model(x[:-1], float(x[-1]))


def train(docs: DataFrame, known: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` documents of each label; ``known``: ``doc_id`` and ``y`` (1 or 0, others are left out)."""
    got = labelled_sample(docs, known.where(F.col("y").isin(0, 1)), sample)
    return fit([r.t for r in got], [r.y for r in got], [1 / r.share for r in got])


def score_toxicity(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """Each row's ``doc_id``, score, decision and the bounds and score of its worst sentence if it is rejected.

    Null, empty and blank texts score 0. Repeated rows give repeated rows. Extra columns are ignored. An empty table gives no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers, whatever the corpus

    def start():
        scorer = shared.value.scorer()

        def row(doc_id: int | None, text: str | None) -> tuple:
            score = scorer.score(text)
            s, e, p = scorer.worst(text) if score >= threshold else (None, None, None)
            return doc_id, score, int(score >= threshold), s, e, p

        return row

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(rows, "doc_id long, score double, predicted int, worst_start int, worst_end int, worst_score double", start)


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of ``docs`` whose text scores below the threshold.

    Null, empty and blank texts score 0 and stay, unless the threshold is 0. Equal texts, and so repeated rows, have one
    fate; a score at the threshold is rejected. Columns are passed on as they are. An empty table gives no rows. Rows go
    through in small batches and the scorer ends with its task, so a worker keeps nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or shared.value.scorer()
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                kept = pa.array([scorer.score(t.as_py()) < threshold for t in part.column(place).cast(pa.string())], pa.bool_())
                yield part.filter(kept)

    return docs.mapInArrow(task, docs.schema)
