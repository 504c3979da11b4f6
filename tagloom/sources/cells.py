"""Cells of differing CSV files, no schema, every position an explicit column.

Files are read line by line, split as Spark splits text, so a large file is read by many tasks. A line that is read on its
own and has an open quote at its end shows that the file's records may go over lines; as long as no line of a file has
one, its lines are its records. Only files with such a line are read whole, if they are not too long. Lines are
parsed once, written to the shared folder with their split and place in it, and numbered from the splits' lengths: a
table of one row for each split, and no window over rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.sources.scratch import staged

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+'
_FIELD = rf"(?:{_QUOTED}|[^,\r\n]*+)"
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)"
_NEXT = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
# Cells that count as missing.
NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def _unquoted(field: Column) -> Column:
    parts = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'
    inner = F.replace(F.regexp_extract(field, parts, 1), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), F.concat(inner, F.regexp_extract(field, parts, 2))).otherwise(field)


def parsed_records(content: Column) -> Column:
    """Arrays of raw fields for each record that is not blank."""
    records = F.filter(F.regexp_extract_all(content, F.lit(_RECORD), F.lit(1)), lambda r: ~r.rlike(r"^\s*$"))
    return F.transform(records, lambda r: F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(_NEXT), F.lit(1)))


#: Files whose records go over lines are read whole up to this length.
WHOLE_BYTES = 256 << 20
#: Tables of up to so many splits or files are broadcast (less than a hundred bytes a row); larger ones are joined by shuffle.
SMALL_ROWS = 500_000
_OPEN = r'(?s)^"[^"]*+(?:""[^"]*+)*+$'


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def _decoded_name(path: Column) -> Column:
    """The file's name from its address as an URI; only names with escapes are decoded."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("%"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


def listed_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """``source_file``, ``path`` and ``length`` of the directory's own files; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select(_file_name(F.col("path")).alias("source_file"), "path", "length")


def read_files(spark: SparkSession, directory: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """``source_file`` and ``content`` (bytes) of the directory's own files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select(_file_name(F.col("path")).alias("source_file"), "content")


def read_lines(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """Lines that are not blank: ``source_file``, ``split``, ``at`` (ascending, without a gap in a split), ``fields``, ``valid``, ``open``."""
    lines = spark.read.option("pathGlobFilter", pattern).text(directory)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    lines = lines.where(~F.col("value").rlike(r"^\s*$")).withColumn("at", F.monotonically_increasing_id())
    text, quoted = F.col("value"), F.col("value").contains('"')
    parts = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_NEXT), F.lit(1))
    rows = lines.select(
        _decoded_name(F.col("path")).alias("source_file"), "split", "at", F.is_valid_utf8("value").alias("valid"),
        F.when(quoted, parts).otherwise(F.split(text, ",", -1)).alias("fields"), quoted.alias("quoted"),
    )
    open_ = F.when(F.col("quoted"), F.exists("fields", lambda f: f.rlike(_OPEN))).otherwise(False)
    return rows.select("source_file", "split", "at", "fields", "valid", open_.alias("open"))


def sized(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``table``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


@dataclass(frozen=True)
class Records:
    """Records of the good files: ``source_file``, ``row_no`` (long), ``width``, ``fields`` as written; and rejected files."""

    rows: DataFrame
    rejects: DataFrame
    staged: tuple[DataFrame, ...]


def numbered(rows: DataFrame, key: str, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """Where each split's rows start in their file (``key``), and the splits' table as staged.

    ``rows`` has ``split`` and ``at``, and ``keep`` are further aggregates by split. The prefix sums run over splits, not rows.
    """
    own = (F.max("at") - F.min("at") + 1).alias("n")
    splits = staged(rows.groupBy(key, "split").agg(F.min("at").alias("first"), own, *keep), "splits")
    before = Window.partitionBy(key).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(key, "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), splits


def read_records(spark: SparkSession, directory: str, pattern: str = "*.csv", whole_bytes: int = WHOLE_BYTES) -> Records:
    """The records of a directory's CSV files, by lines wherever records are lines.

    The names of the files that must be read whole pass through the driver, as the list of all files does in Spark itself.
    """
    lines = staged(read_lines(spark, directory, pattern), "lines")
    width = F.size("fields")
    starts, splits = numbered(
        lines, "source_file", F.min_by(width, F.col("at")).alias("width"), F.max(width).alias("widest"), F.bool_and("valid").alias("valid"), F.bool_or("open").alias("open")
    )
    found = splits.groupBy("source_file").agg(
        F.min_by("width", "split").alias("width"), F.max("widest").alias("widest"), F.bool_and("valid").alias("valid"), F.bool_or("open").alias("open")
    )
    reason = (
        F.when(F.col("valid").isNull(), "empty").when(~F.col("valid"), "not UTF-8").when(F.col("open") & (F.col("length") > whole_bytes), "quotes over lines in too long a file")
        .when(~F.col("open") & (F.col("widest") > F.col("width")), "a row wider than the first")
    )
    files = staged(listed_files(spark, directory, pattern).join(found, "source_file", "left").withColumn("reason", reason), "files")
    rejects = files.where("reason is not null").select("source_file", "reason")
    good = files.where("reason is null and not open").select("source_file", "width")
    rows = lines.join(sized(starts.join(good, "source_file")), ["source_file", "split"])
    rows = rows.select("source_file", (F.col("start") + F.col("at") - F.col("first")).alias("row_no"), "width", "fields")
    over_lines = [re.sub(r"([][{}*?\\])", r"\\\1", r.path) for r in files.where("reason is null and open").select("path").collect()]
    if over_lines:
        whole = staged(_checked(read_files(spark, over_lines, "*")), "whole-files")
        own = whole.where("reason is null").select("source_file", F.posexplode("records").alias("row_no", "fields"), "width")
        rows = rows.unionByName(own.select("source_file", F.col("row_no").cast("long").alias("row_no"), "width", "fields"))
        rejects = rejects.unionByName(whole.where("reason is not null").select("source_file", "reason"))
        return Records(rows, rejects, (lines, splits, files, whole))
    return Records(rows, rejects, (lines, splits, files))


def _checked(files: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{feff}", "")
    rows = files.select("source_file", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.when(F.is_valid_utf8(F.col("content").cast("string")), text).alias("text"))
    rows = rows.withColumn("records", parsed_records(F.col("text")))
    width = F.size(F.get("records", F.lit(0)))
    widest = F.array_max(F.transform("records", lambda r: F.size(r)))
    broken = F.exists("records", lambda r: F.exists(r, lambda f: f.rlike(_OPEN)))
    reason = (
        F.when(~F.col("valid"), "not UTF-8").when(F.coalesce(F.size("records"), F.lit(0)) <= 0, "empty").when(widest > width, "a row wider than the first").when(broken, "open quote")
    )
    return rows.select("source_file", "records", width.alias("width"), reason.alias("reason"))


def cell_value(fields: Column, col_no: Column) -> Column:
    """A record's cell without its quotes; null where the record is too short or the cell counts as missing."""
    value = _unquoted(F.get(fields, col_no))
    return F.when(~value.isin(*NULLS), value)


def cell_table(records: DataFrame) -> DataFrame:
    """``source_file``, ``row_no``, ``col_no``, ``cell``: all cells of records, short rows filled with nulls."""
    cells = records.select("source_file", "row_no", "fields", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_no"))
    return cells.select("source_file", "row_no", "col_no", cell_value(F.col("fields"), F.col("col_no")).alias("cell"))
