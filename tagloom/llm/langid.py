"""Language identification in two steps: the family first, then linear support vector machines one against one within it.

Features are hashed character n-grams of the lower-cased words, averaged over the text. All machines minimise the
squared hinge loss with L2 regularisation on a bounded sample of each language. A pair's vote is its margin's sign, ties
go to the greater sum of margins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.textlinear import Scorer, bounded_sample, descend, mapped, matrix

SIZES, WIDTH = (1, 2, 3), 1 << 13
SAMPLE = 1000
MOST_ROWS = 4000
_STEPS, _RATE, _DECAY = 120, 0.02, 1e-3
UNKNOWN = "und"
#: The families of common language codes. Others form one family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "cjk": "ja ko zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(code: str) -> str:
    return _FAMILY.get(re.split("[-_]", code.lower())[0], "other")


def has_letter(text: str) -> bool:
    """Whether some character is a letter; signs for numbers (``½``, ``Ⅷ``, ``①``) are none."""
    return any(map(str.isalpha, text))


def chunks(text: str) -> list[str]:
    return text.lower().split()


@dataclass(frozen=True)
class Model:
    """Columns of ``weights``: one machine for each family, then one for each pair of a family's languages."""

    weights: np.ndarray
    bias: np.ndarray
    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    pairs: tuple[tuple[str, str], ...]

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        by_family = margins[: len(self.families)]
        best = int(by_family.argmax())
        certain = [1.0] if len(by_family) == 1 else [float(by_family[best] - np.delete(by_family, best).max()) / 2]
        group = self.languages[self.families[best]]
        votes = dict.fromkeys(group, (0, 0.0))
        for (a, b), m in zip(self.pairs, margins[len(self.families) :], strict=True):
            if a in votes:
                for code, v in ((a, m), (b, -m)):
                    votes[code] = (votes[code][0] + (v > 0), votes[code][1] + float(v))
        winner = max(group, key=lambda c: (votes[c], c))
        certain += [float(m if winner == a else -m) for (a, b), m in zip(self.pairs, margins[len(self.families) :], strict=True) if winner in (a, b)]
        return winner, float(1 / (1 + np.exp(-4 * min(certain))))


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge machine; the two sides count alike."""
    w = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))

    def gradient(b: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - y * (x @ b[:-1].astype(np.float32) + b[-1]))
        d = -2 * w * y * slack
        return np.append(x.T @ d.astype(np.float32) + _DECAY * b[:-1], d.sum())

    return descend(gradient, np.zeros(x.shape[1] + 1), _STEPS, _RATE)


def fit(texts: list[str | None], langs: list[str]) -> Model:
    if not texts:
        return Model(np.zeros((WIDTH, 0), np.float32), np.zeros(0), (), {}, ())
    codes = sorted(set(langs))
    families = tuple(sorted({family(c) for c in codes}))
    languages = {f: tuple(c for c in codes if family(c) == f) for f in families}
    pairs = tuple(p for f in families for p in combinations(languages[f], 2))
    x = matrix(texts, SIZES, WIDTH, chunks)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-3)
    x *= scale
    own = np.array(langs)
    groups = np.array([family(c) for c in langs])
    machines = [_machine(x, np.where(groups == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(WIDTH + 1) for f in families]
    for a, b in pairs:
        among = np.isin(own, (a, b))
        machines.append(_machine(x[among], np.where(own[among] == a, 1.0, -1.0)))
    stacked = np.stack(machines, axis=1)
    return Model((stacked[:-1] * scale[:, None]).astype(np.float32), stacked[-1], families, languages, pairs)


def train(labelled: DataFrame, *, sample: int = SAMPLE, most_rows: int = MOST_ROWS) -> Model:
    """Fit on ``text`` and ``lang`` of about ``sample`` rows of each language, fewer if that is over ``most_rows``."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").alias("y"))
    kinds = max(1, rows.select("y").distinct().count())
    got = bounded_sample(rows, "y", max(1, min(sample, most_rows // kinds))).select("doc_id", "text", "y").collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))
    return fit([r.text for r in got], [r.y for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's ``doc_id``, language and score; ``und`` and 0 if the text is null or has no letter, or nothing was learnt.

    Repeated rows give repeated rows. Extra columns are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers for each machine

    def start():
        m = shared.value
        scorer = Scorer(m.weights, SIZES, chunks)

        def row(doc_id: int | None, text: str | None) -> tuple:
            if not text or not m.families or not has_letter(text):
                return doc_id, UNKNOWN, 0.0
            return doc_id, *m.decide(scorer.mean(text) + m.bias)

        return row

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(rows, "doc_id long, lang_pred string, score double", start)
