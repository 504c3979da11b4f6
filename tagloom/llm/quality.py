"""Quality by ordinal regression on graded ratings: P(grade <= k) = logistic(threshold k - w x).

One weight vector over hashed n-grams (case and signs kept) is shared by all grades, and the thresholds ascend by
construction. A text's expected grade and its probability of the top grades follow from the same score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.textlinear import Scorer, descend, labelled_sample, mapped, matrix

SIZES, WIDTH = (1, 2, 3), 1 << 12
SAMPLE = 2000
MOST_ROWS = 6000
SELECT = 0.5
_STEPS, _RATE, _DECAY = 200, 0.05, 1e-4


def chunks(text: str) -> list[str]:
    return text.split()


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[int, ...]

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for every grade but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -700, 700)))

    def expected(self, above: np.ndarray) -> float:
        return float(self.grades[0] + np.diff(self.grades) @ above)


def _thresholds(x: np.ndarray) -> np.ndarray:
    return x[0] + np.concatenate([[0.0], np.cumsum(np.exp(x[1:]))])


def gradient_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of the weighted log loss, with the decay's, by weights, first threshold and logs of the steps to the next ones."""
    width = x.shape[1]

    def logistic(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradient(b: np.ndarray) -> np.ndarray:
        t = np.concatenate([[-np.inf], _thresholds(b[width:]), [np.inf]])
        s = x @ b[:width].astype(np.float32)
        up, low = logistic(np.clip(t[y + 1], -500, 500) - s), logistic(np.clip(t[y], -500, 500) - s)
        up, low = np.where(np.isinf(t[y + 1]), 1.0, up), np.where(np.isinf(t[y]), 0.0, low)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = -w * up * (1 - up) / p, w * low * (1 - low) / p  # of the loss by each threshold
        by_cut = np.bincount(y, d_up, cuts + 1)[:-1] + np.bincount(y, d_low, cuts + 1)[1:]
        d_s = -(d_up + d_low)
        after = np.cumsum(by_cut[::-1])[::-1]
        g_t = np.concatenate([after[:1], after[1:] * np.exp(b[width + 1 :])])
        return np.concatenate([x.T @ d_s.astype(np.float32) + _DECAY * b[:width], g_t])

    return gradient


def fit(texts: list[str | None], ratings: list[int], weights: list[float]) -> Model:
    """With one grade or none the model is constant."""
    grades = tuple(sorted(set(ratings)))
    if len(grades) < 2:
        return Model(np.zeros((WIDTH, 1), np.float32), np.zeros(0), grades or (0,))
    x = matrix(texts, SIZES, WIDTH, chunks)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-3)
    x *= scale
    y = np.searchsorted(grades, ratings)
    w = np.array(weights) / np.sum(weights)
    cuts = len(grades) - 1
    share = np.clip(np.cumsum(np.bincount(y, w, cuts + 1))[:-1], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(WIDTH), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    b = descend(gradient_of(x, y, w, cuts), start, _STEPS, _RATE)
    return Model((b[:WIDTH] * scale)[:, None].astype(np.float32), _thresholds(b[WIDTH:]), grades)


def train(docs: DataFrame, known: DataFrame, *, sample: int = SAMPLE, most_rows: int = MOST_ROWS) -> Model:
    """Fit on about ``sample`` documents of each grade (``known``: ``doc_id``, ``y``), fewer if that is over ``most_rows``."""
    kinds = max(1, known.select("y").distinct().count())
    got = labelled_sample(docs, known, max(1, min(sample, most_rows // kinds)))
    return fit([r.t for r in got], [r.y for r in got], [1 / r.share for r in got])


def rate(docs: DataFrame, model: Model, *, select: float = SELECT) -> DataFrame:
    """Each row's ``doc_id``, expected grade, probability of the top grade, and whether that selects it.

    A null text counts as empty: no words, the score of the mean. Repeated rows give repeated rows. Extra columns are
    ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def start():
        m = shared.value
        scorer = Scorer(m.weights, SIZES, chunks)

        def row(doc_id: int | None, text: str | None) -> tuple:
            above = m.above(float(scorer.mean(text or "")[0]))
            tail = float(above[-1]) if len(above) else 1.0
            return doc_id, m.expected(above), tail, int(tail >= select)

        return row

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(rows, "doc_id long, expected_grade double, tail_probability double, selected int", start)
