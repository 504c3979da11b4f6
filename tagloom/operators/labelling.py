"""Annotated records from points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import Vocabulary
from tagloom.functions.labels import bio_tags, by_pattern, label_token, label_tokens, structured
from tagloom.functions.text import tokenize
from tagloom.sources.scratch import staged

PROVENANCE = ("building_id", "source_file", "point_label_col")
ORDER = ("VENDOR_TAG", "IO_TYPE", "EQUIP", "SUBCOMP", "POINT_FUNC")


#: So many terms go into expressions as literals; larger vocabularies are joined.
LITERAL_TERMS = 20_000
#: Tokens of so many occurrences in a row of the dictionary are given back by broadcast, as many as their share allows.
_FREQUENT_ROWS = 50_000


def _provenance(points: DataFrame) -> list[Column]:
    return [F.col(c).cast("string").alias(c) if c in points.columns else F.lit(None).cast("string").alias(c) for c in PROVENANCE]


def _records(rows: DataFrame, source: str) -> DataFrame:
    """Annotated records from rows with ``tokens`` and ``token_labels``; other columns stay last."""
    known = ("point_label", "tokens", "token_labels", *PROVENANCE)
    return rows.select(
        "point_label", "tokens", "token_labels", bio_tags(F.col("token_labels")).alias("bio_tags"), *PROVENANCE,
        F.lit(source).alias("label_source"), structured(F.col("tokens"), F.col("token_labels")).alias("structured"), *(c for c in rows.columns if c not in known),
    )


def annotate(points: DataFrame, vocabulary: Vocabulary, source: str = "rule") -> DataFrame:
    """``points`` as annotated records, row by row and without a shuffle; points without tokens keep empty arrays.

    Works on streams too. Missing provenance columns are null.
    """
    if "point_label" not in points.columns:
        raise ValueError("point_label is missing")
    tokens = F.coalesce(tokenize(F.col("point_label")), F.array().cast("array<string>")).alias("tokens")
    rows = points.select("point_label", tokens, *_provenance(points))
    return _records(rows.withColumn("token_labels", label_tokens(F.col("tokens"), vocabulary)), source)


def token_dictionary(occurrences: DataFrame, lookup: DataFrame) -> DataFrame:
    """``token``, ``n`` and ``label``: each distinct token, how often it occurs, and its category, found once."""
    return label_by_lookup(occurrences.groupBy("token").agg(F.count("*").alias("n")), lookup)


def annotate_by_lookup(points: DataFrame, lookup: DataFrame, source: str = "rule", frequent_rows: int = _FREQUENT_ROWS) -> DataFrame:
    """The same for a vocabulary of any size, as the rows of :func:`lookup_table`; ``point_ord`` names each point and stays.

    Distinct tokens are labelled once, by join or pattern. The most frequent ones, ``frequent_rows`` at most, are given back to
    the points by broadcast, so no common token makes a hot key, the others by shuffle; then a point's tokens meet again.
    """
    rows = points.select("point_ord", "point_label", tokenize(F.col("point_label")).alias("tokens"), *_provenance(points))
    found = rows.select("point_ord", F.posexplode_outer("tokens").alias("pos", "token")).where("pos is not null")
    labels = staged(token_dictionary(found, lookup), "dictionary")
    most = labels.orderBy(F.desc("n"), "token").limit(frequent_rows).select("token", F.col("label").alias("common"))
    given = found.join(F.broadcast(staged(most, "frequent")), "token", "left")
    rest = given.where("common is null").select("point_ord", "pos", "token").join(labels.select("token", "label"), "token")
    both = given.where("common is not null").select("point_ord", "pos", F.col("common").alias("label")).unionByName(rest.select("point_ord", "pos", "label"))
    joined = both.groupBy("point_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("x"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("tokens", F.coalesce("tokens", none)).join(joined, "point_ord", "left")
    return _records(rows.withColumn("token_labels", F.coalesce(F.transform("x", lambda x: x["label"]), none)).drop("x"), source)


def lookup_table(vocabulary_rows: DataFrame) -> DataFrame:
    """``token`` and the first ``category`` in lookup order, from ``category`` and ``token`` rows."""
    order = F.array(*map(F.lit, ORDER))
    ranked = vocabulary_rows.groupBy("token").agg(F.min(F.array_position(order, F.col("category"))).alias("rank"))
    return ranked.select("token", F.element_at(order, F.col("rank").cast("int")).alias("category"))


def label_by_lookup(tokens: DataFrame, lookup: DataFrame) -> DataFrame:
    """``tokens`` (with ``token``) with ``label``, for vocabularies too large for literals; Spark picks the join."""
    terms = lookup.select(F.col("token").alias("_term"), F.col("category").alias("_category"))
    joined = tokens.join(terms, F.upper("token") == F.col("_term"), "left")
    return joined.withColumn("label", F.coalesce("_category", by_pattern(F.col("token")))).drop("_term", "_category")


def label_counts(points: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``label`` and ``n``: tokens by category. Tokens are counted first, as the category depends on the token alone."""
    tokens = points.select(F.explode(tokenize(F.col("point_label"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.groupBy(label_token(F.col("token"), vocabulary).alias("label")).agg(F.sum("n").alias("n"))
