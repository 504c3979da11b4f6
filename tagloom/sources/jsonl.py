"""JSON lines and vocabulary files, with fixed schemas."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.config import Vocabulary
from tagloom.sources.cells import sized
from tagloom.sources.scratch import staged

UNKNOWN = "unknown"
POINT_SCHEMA = "building_id string, source_file string, point_label string, point_label_col string"
VOCAB_SCHEMA = (
    "frequency map<string,bigint>, equip_vocab array<string>, subcomp_vocab array<string>, point_func_vocab array<string>, "
    "io_type_vocab array<string>, vendor_vocab array<string>, stats struct<num_tokens: bigint, num_buildings: bigint>"
)
CATEGORY_LISTS = (("EQUIP", "equip_vocab"), ("SUBCOMP", "subcomp_vocab"), ("POINT_FUNC", "point_func_vocab"), ("IO_TYPE", "io_type_vocab"), ("VENDOR_TAG", "vendor_vocab"))


def read_points(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """Point records; blank lines are skipped, a malformed line fails the job, missing keys are null.

    A record without the key of the building belongs to the building ``unknown``; one whose building is null to none.
    ``more``: further columns, of the file's metadata.
    """
    lines = spark.read.text(path).select("value", *more).where(~F.col("value").rlike(r"^\s*$"))
    record = F.from_json("value", POINT_SCHEMA, {"mode": "FAILFAST"})
    rows = lines.withColumn("_x", record).select("*", "_x.*").drop("_x")
    missing = F.col("building_id").isNull() & ~F.array_contains(F.json_object_keys("value"), "building_id")
    return rows.withColumn("building_id", F.when(missing, UNKNOWN).otherwise(F.col("building_id"))).drop("value")


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines with null fields written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_vocabulary(bundle: DataFrame, path: str) -> None:
    """One JSON document in a folder."""
    bundle.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_vocabulary(bundle: DataFrame, path: str) -> None:
    """One indented local file; the row is as large as the vocabulary."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(bundle.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), f, indent=2)  # toJSON loses the map's order


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` and ``value``: the lines of a folder's files in order of name, numbered from 1 by way of the splits' lengths."""
    at = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = staged(spark.read.text(path).select("value", *at), "text-lines")
    return with_places(lines, "line").select("line", "value")


def with_places(rows: DataFrame, name: str) -> DataFrame:
    """Rows with ``path``, ``split`` and ``at`` and their place over all files, from 1. One row for each split is put in order, no others."""
    splits = rows.groupBy("path", "split").agg(F.min("at").alias("_first"), (F.max("at") - F.min("at") + 1).alias("_n"))
    before = Window.orderBy("path", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(sized(staged(starts, "splits")), ["path", "split"])
    return placed.withColumn(name, F.col("_start") + F.col("at") - F.col("_first") + 1).drop("_start", "_first")


def write_document(lines: DataFrame, path: str) -> None:
    """The lines of :func:`~tagloom.operators.vocab.document_lines` in a folder of text; its parts in order of name are the document."""
    write_lines(lines, path)


def vocabulary_terms(spark: SparkSession, path: str) -> DataFrame:
    """``category`` and ``token`` of a vocabulary written by lines or as one JSON file. Lists are known by the line they start with."""
    kinds = {column: category for category, column in CATEGORY_LISTS}
    lines = numbered_lines(spark, path)
    heads = lines.where(F.col("value").rlike(r'^[]}]?, "[a-z_]+": [\[{]') | (F.col("value") == '{"frequency": {')).select("line", "value").orderBy("line").collect()
    if not heads or heads[0].value != '{"frequency": {':
        row = spark.read.option("multiLine", True).schema(VOCAB_SCHEMA).json(path)
        parts = [row.select(F.lit(category).alias("category"), F.explode(column).alias("token")) for column, category in kinds.items()]
        return reduce(DataFrame.union, parts).where("token is not null").distinct()
    section = F.lit(None).cast("string")
    for head in heads:
        name = re.search('"([a-z_]+)"', head.value)[1]
        section = F.when(F.col("line") > head.line, F.lit(kinds.get(name))).otherwise(section)
    token = F.get(F.from_json(F.concat(F.lit("["), F.regexp_replace("value", "^, ", ""), F.lit("]")), "array<string>"), F.lit(0))
    terms = lines.where(~F.col("line").isin([h.line for h in heads])).select(section.alias("category"), token.alias("token"))
    return terms.where("category is not null").distinct()


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """The lists of a vocabulary as sets in the driver; a list that is not there is empty."""
    found: dict[str, set[str]] = {category: set() for category, _ in CATEGORY_LISTS}
    for r in vocabulary_terms(spark, path).collect():
        found[r.category].add(r.token)
    return Vocabulary(**{category.lower(): frozenset(terms) for category, terms in found.items()})


def write_lines(rows: DataFrame, path: str) -> None:
    """A folder of text, a line for each row in the order of ``rows``; its parts in order of name are the whole text."""
    rows.write.mode("overwrite").text(path)
