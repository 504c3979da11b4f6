"""A corpus from raw documents to packed sequences; each stage applies one operator to what the one before kept.

Every stage takes an empty table to an empty table, passes columns on that it does not know, whatever their names, and treats
rows that repeat an id as documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.mixing import mixed_documents
from tagloom.llm.ngram_join import without_near_copies
from tagloom.llm.packing import pack_documents
from tagloom.llm.queries import TOKENIZER, table
from tagloom.llm.secrets import redacted
from tagloom.llm.storage import dropped, staged
from tagloom.llm.textlinear import labels_without
from tagloom.llm.toxicity import train, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labelled ones among them, does not reject.

    Null, empty and blank texts score 0 and stay. Equal texts have one fate; a score at the threshold is rejected. Without
    labels of both kinds the model is constant.
    """
    return without_toxic(docs, train(docs, labels_without(table(spark, sf_dir, "labels"), "toxic", 4, 2)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies, and every other document.

    Rows without words or without an id stay. Of rows that repeat id and text one stays; of near copies under one id the one
    whose text has the least digest.
    """
    return without_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked. A null text stays null, an empty one empty; equal texts are masked alike."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each partition in the order of the schedule.

    A null source is a source of its own. Texts without words are not taken. Rows alike in id, text and source share what is
    taken from them in the order of a hash of the whole row.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. Null and empty texts give the end id alone; repeated rows are packed once each."""
    return pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]
#: A trained model and a tokenizer are beyond SQL; ``tests/llm/test_pipeline.py`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
