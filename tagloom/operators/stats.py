"""Token statistics of a table of points: ``point_label``, ``building_id`` and, for first occurrences, ``point_ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import is_number_token, tokenize
from tagloom.sources.cells import sized
from tagloom.sources.scratch import staged

_PLACES = 1 << 31


def _occurrences(points: DataFrame, building: Column) -> DataFrame:
    """One row per token as written: ``building``, ``pos``, ``token``, ``next_is_number``, ``ord``.

    The outer form keeps Spark from tokenizing a second time to see whether there are tokens.
    """
    ordinal = F.col("point_ord").cast("long") if "point_ord" in points.columns else F.lit(None).cast("long")
    rows = points.select(
        building.alias("building"), tokenize(F.col("point_label")).alias("tokens"), (ordinal.cast("decimal(20,0)") * _PLACES).alias("o")
    )
    placed = rows.select("building", "tokens", "o", F.posexplode_outer("tokens").alias("pos", "token")).where("pos is not null")
    follows = F.coalesce(is_number_token(F.get("tokens", F.col("pos") + 1)), F.lit(False))
    return placed.select("building", "pos", "token", follows.alias("next_is_number"), (F.col("o") + F.col("pos")).cast("decimal(38,0)").alias("ord"))


def _by_name(points: DataFrame) -> DataFrame:
    return _occurrences(points, F.col("building_id").cast("string")).withColumnRenamed("building", "building_id")


def explode_tokens(points: DataFrame) -> DataFrame:
    """One row per token: ``building_id``, ``pos``, ``token`` (upper case), ``next_is_number``, ``ord``; no shuffle.

    Points without tokens have no rows. A null building is a building of its own. ``ord`` is the token's place in the
    corpus, 2**31 times ``point_ord`` plus its place in the label, if there is a ``point_ord``, else null.
    """
    return _by_name(points).withColumn("token", F.upper("token"))


def token_counts_by_building(points: DataFrame) -> DataFrame:
    """``token``, ``building_id``, ``freq``, ``numid_bigrams``, ``first_ord``: tokens as written are counted, then upper-cased."""
    written = _by_name(points).groupBy("token", "building_id").agg(
        F.count("*").alias("freq"), F.count_if("next_is_number").alias("numid_bigrams"), F.min("ord").alias("first_ord")
    )
    return written.groupBy(F.upper("token").alias("token"), "building_id").agg(
        F.sum("freq").alias("freq"), F.sum("numid_bigrams").alias("numid_bigrams"), F.min("first_ord").alias("first_ord")
    )


def numbered_buildings(points: DataFrame) -> DataFrame:
    """``building_id`` and ``building``, a number from 0 without gaps; a null building is one too.

    Distinct buildings are written to the shared folder with their place in their partition, and partitions are added up.
    """
    own = points.select(F.col("building_id").cast("string").alias("building_id")).distinct()
    placed = staged(own.withColumn("at", F.monotonically_increasing_id()), "buildings")
    placed = placed.select("building_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg((F.max("at") + 1).alias("n"))  # a row for each partition
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("building_id", (F.col("start") + F.col("at")).alias("building"))


def token_supports(points: DataFrame) -> DataFrame:
    """``token``, ``word``, ``bits``, ``freq``, ``numid_bigrams``, ``first_ord``: a row for each token and 64 buildings.

    Bit i of ``bits`` is set if the token is in building 64 * ``word`` + i, so what is shuffled does not grow with the number of
    buildings that each token is in. Tokens as written are counted, then upper-cased.
    """
    numbers = sized(numbered_buildings(points)).withColumnRenamed("building_id", "_known")
    rows = points.join(numbers, F.col("building_id").cast("string").eqNullSafe(F.col("_known"))).drop("_known")
    found = _occurrences(rows, F.col("building")).select(
        "token", "next_is_number", "ord", F.shiftright("building", 6).alias("word"), F.expr("shiftleft(1L, cast(building & 63 as int))").alias("bit")
    )
    written = found.groupBy("token", "word").agg(
        F.bit_or("bit").alias("bits"), F.count("*").alias("freq"), F.count_if("next_is_number").alias("numid_bigrams"), F.min("ord").alias("first_ord")
    )
    return written.groupBy(F.upper("token").alias("token"), "word").agg(
        F.bit_or("bits").alias("bits"), F.sum("freq").alias("freq"), F.sum("numid_bigrams").alias("numid_bigrams"), F.min("first_ord").alias("first_ord")
    )


def token_stats(points: DataFrame) -> DataFrame:
    """``token``, ``freq``, ``buildings``, ``numid_bigrams``, ``first_ord``.

    Hash aggregations, partial before each shuffle, so a token or building of a third of all rows is summed where it is read.
    """
    return stats_of_supports(token_supports(points))


def stats_of_supports(supports: DataFrame) -> DataFrame:
    """``token_stats`` from tokens by 64 buildings."""
    return supports.groupBy("token").agg(
        F.sum("freq").alias("freq"), F.sum(F.bit_count("bits")).alias("buildings"), F.sum("numid_bigrams").alias("numid_bigrams"), F.min("first_ord").alias("first_ord")
    )


def corpus_of_supports(supports: DataFrame) -> DataFrame:
    """One row: distinct tokens and buildings with a token."""
    none = F.lit(0).cast("long")
    tokens = supports.select("token").distinct().agg(F.count("*").alias("num_tokens"), none.alias("num_buildings"))
    words = supports.groupBy("word").agg(F.bit_or("bits").alias("bits")).select(none.alias("num_tokens"), F.bit_count("bits").cast("long").alias("num_buildings"))
    return tokens.union(words).agg(F.sum("num_tokens").alias("num_tokens"), F.sum("num_buildings").alias("num_buildings"))


def corpus_stats(points: DataFrame) -> DataFrame:
    """One row: distinct tokens and buildings with a token."""
    return corpus_of_supports(staged(token_supports(points), "supports"))
