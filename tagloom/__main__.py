"""Command line: ``python -m tagloom extract|vocab|label``. Each command runs one job and prints its summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tagloom.plans.jobs import JobReport, run_extract, run_label, run_vocab


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tagloom")
    commands = out.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="CSV files to point records")
    extract.add_argument("--input", default="data", help="folder of CSV files")
    extract.add_argument("--pattern", default="*.csv", help="which of its files")
    extract.add_argument("--points", default="out/points")
    extract.add_argument("--sample", default=None, help="folder for one label of each building")
    vocab = commands.add_parser("vocab", help="point records to a vocabulary")
    vocab.add_argument("--points", default="out/points")
    vocab.add_argument("--vocabulary", default="out/vocabulary")
    label = commands.add_parser("label", help="point records to annotated records")
    label.add_argument("--points", default="out/points")
    label.add_argument("--vocabulary", default="out/vocabulary")
    label.add_argument("--labelled", default="out/labelled")
    return out


def job(spark: SparkSession, arguments: list[str] | None = None) -> JobReport:
    """The job that the arguments name."""
    a = parser().parse_args(arguments)
    if a.command == "extract":
        return run_extract(spark, a.input, a.points, sample_out=a.sample, pattern=a.pattern)
    if a.command == "vocab":
        return run_vocab(spark, a.points, a.vocabulary)
    return run_label(spark, a.points, a.vocabulary, a.labelled)


def run(spark: SparkSession, arguments: list[str] | None = None) -> JobReport:
    """The same, and its summary and details printed."""
    report = job(spark, arguments)
    print(report.summary())
    if report.details is not None:
        report.details.show(100, truncate=False)
    return report


if __name__ == "__main__":
    run(SparkSession.builder.appName("tagloom").getOrCreate())
