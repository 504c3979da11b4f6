"""The three batch jobs, chained through files, and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tagloom.config import ExtractConfig, VocabConfig
from tagloom.operators.extract import POINT_COLUMNS, load_points
from tagloom.operators.labelling import LITERAL_TERMS, annotate, annotate_by_lookup, lookup_table
from tagloom.operators.sample import ordered_samples, sample_one_per_building
from tagloom.operators.stats import corpus_of_supports, stats_of_supports, token_supports
from tagloom.operators.vocab import bottom_equipment, classify, document_lines
from tagloom.sources.jsonl import read_points, read_vocabulary, vocabulary_terms, with_places, write_document, write_json, write_lines
from tagloom.sources.scratch import dropped, staged


@dataclass(frozen=True)
class JobReport:
    """Rows written, what the job counted, and a table of details (rejected files; the bottom of the ranking)."""

    rows: int
    counts: dict[str, int]
    details: DataFrame | None = None

    def summary(self) -> str:
        return ", ".join(f"{name}: {n}" for name, n in {"rows": self.rows, **self.counts}.items())


def job_summary(points: DataFrame) -> DataFrame:
    """One row: points, files and buildings."""
    return points.agg(F.count("*").alias("points"), F.count_distinct("source_file").alias("files"), F.count_distinct("building_id").alias("buildings"))


def in_corpus_order(spark: SparkSession, path: str) -> DataFrame:
    """Point records of a folder with ``point_ord``, from 1, ascending by file as named, then line, however Spark splits them.

    Records are parsed once and written to the shared folder with their split. Numbers come from the splits' lengths, a
    table of one row for each split; no window is over records.
    """
    at = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return with_places(staged(read_points(spark, path, *at), "points"), "point_ord").select(*POINT_COLUMNS, "point_ord")


def run_extract(spark: SparkSession, directory: str, out: str, config: ExtractConfig = ExtractConfig(), sample_out: str | None = None, pattern: str = "*.csv") -> JobReport:
    """CSV files to point records and, if wanted, one sampled label for each building.

    Fails if no file has points, before anything is overwritten. The report lists rejected files.
    """
    found = load_points(spark, directory, config, pattern)
    if found.points.isEmpty():
        raise RuntimeError("no file with point labels")
    seen = Observation()
    write_json(found.points.sort("source_file", "row_no").select(*POINT_COLUMNS).observe(seen, F.count("*").alias("rows")), out)
    if sample_out is not None:
        write_lines(ordered_samples(sample_one_per_building(in_corpus_order(spark, out), config.seed)), sample_out)
    totals = job_summary(found.points).first()
    rejected = staged(found.rejects, "rejects")
    dropped(*found.staged)
    return JobReport(seen.get["rows"], {"files": totals.files, "buildings": totals.buildings, "rejected files": rejected.count()}, rejected)


def run_vocab(spark: SparkSession, points_path: str, out: str, config: VocabConfig = VocabConfig()) -> JobReport:
    """Point records to a vocabulary file. The report lists the bottom of the equipment ranking.

    The corpus is read once: its counts by token and buildings are written to the shared folder for all that follows.
    """
    counts = staged(token_supports(in_corpus_order(spark, points_path)), "counts")
    classified = staged(classify(stats_of_supports(counts), config), "classified")
    corpus = corpus_of_supports(counts)
    write_document(document_lines(classified, corpus, config), out)
    totals = corpus.first()
    bottom = spark.createDataFrame(bottom_equipment(classified, config).collect(), classified.schema)  # as many as the parameter says
    dropped(classified, counts)
    return JobReport(totals.num_tokens, {"tokens": totals.num_tokens, "buildings": totals.num_buildings}, bottom)


def run_label(spark: SparkSession, points_path: str, vocabulary_path: str, out: str, literal_terms: int = LITERAL_TERMS) -> JobReport:
    """Point records to annotated records, one for one.

    Up to ``literal_terms`` terms go into the expressions, and no record is shuffled; a larger vocabulary is joined.
    """
    seen = Observation()
    terms = staged(vocabulary_terms(spark, vocabulary_path), "terms")
    if terms.count() <= literal_terms:
        annotated = annotate(read_points(spark, points_path), read_vocabulary(spark, vocabulary_path))
    else:
        annotated = annotate_by_lookup(in_corpus_order(spark, points_path), lookup_table(terms)).sort("point_ord").drop("point_ord")
    counts = (F.count("*").alias("rows"), F.sum(F.size("tokens")).alias("tokens"), F.count_if(F.size("tokens") == 0).alias("empty"))
    write_json(annotated.observe(seen, *counts), out)
    dropped(terms)
    return JobReport(seen.get["rows"], {"tokens": seen.get["tokens"] or 0, "without tokens": seen.get["empty"]})
