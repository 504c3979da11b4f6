"""Labelling of points as they arrive. It keeps no state, so there is no watermark and nothing can be late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tagloom.config import Vocabulary
from tagloom.operators.labelling import annotate
from tagloom.sources.jsonl import POINT_SCHEMA


def read_point_stream(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines that arrive in a folder, so many files a batch at most."""
    return spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(directory)


def label_stream(points: DataFrame, vocabulary: Vocabulary, out: str, checkpoint: str) -> StreamingQuery:
    """Annotated records as JSON lines; everything there is, then it ends. Restarts go on where it ended."""
    annotated = annotate(points, vocabulary)
    return (
        annotated.writeStream.format("json").option("path", out).option("ignoreNullFields", "false").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
