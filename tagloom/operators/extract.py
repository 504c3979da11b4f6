"""Points from cell tables: header detection, choice of the label column, projection.

Cells are read twice: once for facts about columns, once for the points. The first reading keeps, for each 64 rows of a
column, which cells are filled and which of those are point-like as the bits of two numbers, so that a seeded sample is
read from these numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.config import ExtractConfig
from tagloom.functions.text import building_id, is_point_like
from tagloom.operators.sample import positions_column
from tagloom.sources.cells import cell_table, cell_value, read_records, sized
from tagloom.sources.scratch import staged

POINT_COLUMNS = ("building_id", "source_file", "point_label", "point_label_col")
_WORD, _WORDS = 64, 1024


def column_words(cells: DataFrame) -> DataFrame:
    """A row for each 64 rows of a column: ``source_file``, ``col_no``, ``word``, ``last`` (row), bits ``filled`` and ``likes``.

    The first row of a file, which may be its header, is word -1 and gives its cell as ``top``. Sums of bits by hash, before
    the shuffle too.
    """
    row, cell = F.col("row_no"), F.col("cell")
    below = row > 0
    bit = F.expr(f"shiftleft(1L, cast(pmod(row_no - 1, {_WORD}) as int))")
    rows = cells.select(
        "source_file", "col_no", row.cast("long").alias("row_no"), F.when(below, F.floor((row - 1) / _WORD)).otherwise(F.lit(-1)).cast("long").alias("word"),
        F.when(~below, cell).alias("top"), F.when(cell.isNotNull(), F.when(below, bit).otherwise(F.lit(1))).cast("long").alias("bit"), is_point_like(cell).alias("like"),
    )
    none = F.lit(0).cast("long")
    return rows.groupBy("source_file", "col_no", "word", "top").agg(
        F.max("row_no").alias("last"), F.coalesce(F.bit_or("bit"), none).alias("filled"), F.coalesce(F.bit_or(F.when(F.col("like"), F.col("bit"))), none).alias("likes")
    )


def file_facts(words: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """One row per file of :func:`column_words`: ``source_file``, ``has_header`` and ``columns``.

    Header: with three rows and more, a column whose first cell is not point-like while the next two are. Else, and if none
    is: two rows and more, no point-like cell in the first and some in the second. A column is a struct: ``col_no``,
    ``col_name`` (the header's cell, or ``col_`` and the number), ``filled`` and ``likes`` (data cells that are not null,
    and that are point-like), ``same`` (columns of its name in the file).
    """
    below = F.col("word") >= 0
    like = lambda word, bit: F.coalesce(F.max(F.when(F.col("word") == word, (F.bit_get("likes", F.lit(bit)) == 1))), F.lit(False))
    bits = lambda c, where: F.coalesce(F.sum(F.when(where, F.bit_count(c))), F.lit(0))
    by_column = words.groupBy("source_file", "col_no").agg(
        like(-1, 0).alias("b0"), like(0, 0).alias("b1"), like(0, 1).alias("b2"), F.max("top").alias("top"), (F.max("last") + 1).alias("n"),
        bits("filled", F.lit(True)).alias("all"), bits("likes", F.lit(True)).alias("all_likes"), bits("filled", below).alias("below"), bits("likes", below).alias("below_likes"),
    )
    header = F.expr("max(n) >= 3 and bool_or(not b0 and b1 and b2) or max(n) >= 2 and count_if(b0) = 0 and count_if(b1) > 0")
    facts = ("col_no", "top", "all", "all_likes", "below", "below_likes")
    files = by_column.groupBy("source_file").agg(header.alias("has_header"), F.array_sort(F.collect_list(F.struct(*facts))).alias("raw"))

    def column(x: Column) -> Column:
        has = F.col("has_header")
        name = F.when(has, F.coalesce(x["top"], F.lit(config.null_label))).otherwise(F.concat(F.lit("col_"), x["col_no"]))
        filled, likes = (F.when(has, x[b]).otherwise(x[a]) for a, b in (("all", "below"), ("all_likes", "below_likes")))
        return F.struct(x["col_no"].alias("col_no"), name.alias("col_name"), filled.alias("filled"), likes.alias("likes"))

    named = files.select("source_file", "has_header", F.transform("raw", column).alias("c"))
    names = named.withColumn("names", F.transform("c", lambda x: x["col_name"]))
    same = lambda x: F.size(F.filter("names", lambda n: n == x["col_name"]))
    columns = F.transform("c", lambda x: F.struct(x["col_no"], x["col_name"], x["filled"], x["likes"], same(x).alias("same")))
    return names.select("source_file", "has_header", columns.alias("columns"))


def detect_headers(cells: DataFrame) -> DataFrame:
    """``source_file``, ``has_header``."""
    return file_facts(column_words(cells)).select("source_file", "has_header")


def _preferred(config: ExtractConfig) -> Column:
    """Structs of rank, negative number and column for columns of a preferred name; the least is the one to take."""
    order = F.array(*map(F.lit, config.preferred))
    ranked = F.transform("columns", lambda x: F.struct(F.array_position(order, F.lower(x["col_name"])).alias("rank"), (-x["col_no"]).alias("last"), x.alias("x")))
    return F.array_min(F.filter(ranked, lambda r: r["rank"] > 0))


def _sampled(words: DataFrame, facts: DataFrame, config: ExtractConfig) -> DataFrame:
    """``source_file``, ``col_no`` and ``hits``: point-like cells at the seeded positions, of columns with more cells than those.

    A position counts filled cells. Filled cells are summed up by ``_WORDS`` words and then by word, so each window is over
    counts, never over cells, and has at most ``_WORDS`` rows or one row for each 65,536 cells.
    """
    long = facts.select("source_file", F.col("has_header").cast("int").alias("skip"), F.inline("columns")).where((F.col("filled") > config.sample) & (F.col("same") == 1))
    long = long.select("source_file", "col_no", "skip", F.col("filled").alias("of"))
    rows = words.join(long, ["source_file", "col_no"]).where("word >= 0 or skip = 0")
    rows = rows.select("source_file", "col_no", "of", "word", "filled", "likes", F.bit_count("filled").cast("long").alias("n"), F.floor(F.col("word") / _WORDS).alias("part"))
    own = ["source_file", "col_no", "part"]
    in_column, in_part = Window.partitionBy(*own[:2]).orderBy("part"), Window.partitionBy(*own).orderBy("word")
    parts = rows.groupBy(*own, "of").agg(F.sum("n").alias("n")).withColumn("start", F.sum("n").over(in_column) - F.col("n"))
    chosen = long.select("of").distinct().withColumn("at", positions_column(F.col("of"), config.sample, config.seed))
    within = lambda start: lambda a: (a >= F.col(start)) & (a < F.col(start) + F.col("n"))
    wanted = parts.join(chosen, "of").select(*own, F.transform(F.filter("at", within("start")), lambda a: a - F.col("start")).alias("at")).where(F.size("at") > 0)
    rows = rows.join(wanted, own).withColumn("before", F.sum("n").over(in_part) - F.col("n"))
    rows = rows.withColumn("at", F.filter("at", within("before"))).where(F.size("at") > 0)
    bits = F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda b: F.bit_get("filled", b) == 1)
    hit = F.filter("at", lambda a: F.bit_get("likes", F.get("bits", (a - F.col("before")).cast("int"))) == 1)
    return rows.withColumn("bits", bits).groupBy("source_file", "col_no").agg(F.sum(F.size(hit)).alias("hits"))


def _scored(words: DataFrame, facts: DataFrame, config: ExtractConfig) -> DataFrame:
    """``source_file``, ``col_no``, ``col_name``, ``score`` of the columns of ``facts``."""
    found = facts.select("source_file", F.inline("columns")).where("same = 1 and filled > 0")
    if not config.exact_sample:
        return found.select("source_file", "col_no", "col_name", (F.col("likes") / F.col("filled")).alias("score"))
    found = found.join(_sampled(words, facts, config), ["source_file", "col_no"], "left")
    of = F.least("filled", F.lit(config.sample))
    return found.select("source_file", "col_no", "col_name", (F.coalesce("hits", F.when(F.col("filled") <= config.sample, F.col("likes")), F.lit(0)) / of).alias("score"))


def column_scores(cells: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``source_file``, ``col_no``, ``col_name``, ``score``: the point-like share of sampled cells that are not null.

    Columns without such cells, and columns that share their name with another of the file, have no row.
    """
    words = staged(column_words(cells), "words")
    return _scored(words, file_facts(words, config), config)


def _chosen(words: DataFrame, config: ExtractConfig) -> DataFrame:
    """``source_file``, ``has_header``, ``col_no``, ``col_name`` of the label column."""
    facts = file_facts(words, config).withColumn("first", _preferred(config))
    scores = _scored(words, facts.where("first is null"), config).where(F.col("score") > config.min_score)
    scores = scores.groupBy("source_file").agg(F.min_by(F.struct("col_no", "col_name"), F.struct(-F.col("score"), "col_no")).alias("best"))
    files = facts.join(scores, "source_file", "left")
    named, scored = F.col("first"), F.col("best")
    pick = lambda f: F.when(named.isNotNull(), named["x"][f]).otherwise(scored[f]).alias(f)
    fits = F.coalesce(named["x"]["same"] == 1, scored.isNotNull())
    return files.where(fits).select("source_file", "has_header", pick("col_no"), pick("col_name"))


def choose_columns(cells: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``source_file``, ``col_no``, ``col_name`` of the label column: a preferred name, else the best score over the least.

    Files where neither is found, or whose preferred name stands over two columns, have no row.
    """
    return _chosen(staged(column_words(cells), "words"), config).drop("has_header")


def _with_buildings(chosen: DataFrame) -> DataFrame:
    """Files with their building, found once for each file, to be joined with rows."""
    return sized(chosen.withColumn("building_id", building_id(F.col("source_file"))))


def _points(rows: DataFrame, config: ExtractConfig) -> DataFrame:
    """Point records from ``building_id``, ``source_file``, ``row_no``, ``cell``, ``has_header`` and ``col_name``."""
    return rows.where("row_no >= cast(has_header as int)").select(
        "building_id",
        "source_file",
        F.coalesce("cell", F.lit(config.null_label)).alias("point_label"),
        F.col("col_name").alias("point_label_col"),
        F.col("row_no").cast("long").alias("row_no"),
    )


def points_from_cells(cells: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """The four columns of point records, and ``row_no``: the corpus's order is by file name, then row."""
    chosen = staged(_chosen(staged(column_words(cells), "words"), config), "chosen")
    return _points(cells.join(_with_buildings(chosen), ["source_file", "col_no"]), config)


@dataclass(frozen=True)
class Extraction:
    """``staged`` are tables that ``points`` and ``rejects`` read, to be dropped after them."""

    points: DataFrame
    rejects: DataFrame
    staged: tuple[DataFrame, ...] = ()


def load_points(spark: SparkSession, directory: str, config: ExtractConfig = ExtractConfig(), pattern: str = "*.csv") -> Extraction:
    """Points of a directory's CSV files, and the files that gave none with the reason. The files are parsed once."""
    records = read_records(spark, directory, pattern)
    words = staged(column_words(cell_table(records.rows)), "words")
    chosen = staged(_chosen(words, config), "chosen")
    rows = records.rows.join(_with_buildings(chosen), "source_file").withColumn("cell", cell_value(F.col("fields"), F.col("col_no")))
    without = words.select("source_file").distinct().join(chosen, "source_file", "left_anti")
    rejects = records.rejects.unionByName(without.withColumn("reason", F.lit("no label column")))
    return Extraction(_points(rows, config), rejects, (*records.staged, words, chosen))
