"""Vocabularies from token statistics: classify, score, trim, bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.config import VocabConfig
from tagloom.functions.text import is_upper
from tagloom.sources.jsonl import CATEGORY_LISTS
from tagloom.sources.scratch import staged


def is_io_type(token: Column, config: VocabConfig = VocabConfig()) -> Column:
    return token.isin(*config.io_types)


def is_vendor(token: Column, config: VocabConfig = VocabConfig()) -> Column:
    short = token.endswith(config.vendor_suffix) & (F.length(token) <= config.vendor_max_length)
    return token.isin(*config.vendor_hints) | short


def passes_thresholds(freq: Column, buildings: Column, config: VocabConfig = VocabConfig()) -> Column:
    return (freq >= config.min_freq) & (buildings >= config.min_buildings)


def is_point_func(token: Column, freq: Column, buildings: Column, config: VocabConfig = VocabConfig()) -> Column:
    starts = token.rlike("^(?:" + "|".join(config.function_keywords) + ")")
    return token.isin(*config.seed_point_func) & (freq > 0) | passes_thresholds(freq, buildings, config) & starts


def is_subcomponent(token: Column, freq: Column, buildings: Column, config: VocabConfig = VocabConfig()) -> Column:
    measured = token.rlike("|".join(config.measurement_keywords))
    short = is_upper(token) & (F.length(token) <= 4) & token.endswith("T")
    return token.isin(*config.seed_subcomp) & (freq > 0) | passes_thresholds(freq, buildings, config) & (measured | short)


def is_equipment(token: Column, freq: Column, buildings: Column, config: VocabConfig = VocabConfig()) -> Column:
    shaped = token.rlike(r"(?d)^\p{L}{2,6}$") & is_upper(token) & ~token.isin(*config.equip_stopwords)
    found = token.isin(*config.seed_equip) & (freq > 0) | passes_thresholds(freq, buildings, config) & shaped
    return found & ~token.isin(*config.equip_blacklist) if config.equip_blacklist else found


def category(config: VocabConfig = VocabConfig()) -> Column:
    """The first category that fits, or null, from the columns ``token``, ``freq`` and ``buildings``."""
    t, f, b = F.col("token"), F.col("freq"), F.col("buildings")
    return (
        F.when(is_io_type(t, config), "IO_TYPE")
        .when(is_vendor(t, config), "VENDOR_TAG")
        .when(is_point_func(t, f, b, config), "POINT_FUNC")
        .when(is_subcomponent(t, f, b, config), "SUBCOMP")
        .when(is_equipment(t, f, b, config), "EQUIP")
    )


def score() -> Column:
    """Equipment, subcomponents and point functions have a score; other categories have none."""
    f, b, n = F.col("freq"), F.col("buildings"), F.col("numid_bigrams")
    kind = F.col("category")
    return F.when(kind == "EQUIP", f + 2 * b + 3 * n).when(kind == "SUBCOMP", f + 2 * b).when(kind == "POINT_FUNC", f + b)


def classify(stats: DataFrame, config: VocabConfig = VocabConfig()) -> DataFrame:
    """``stats`` with ``category`` and ``score``."""
    return stats.withColumn("category", category(config)).withColumn("score", score())


def _ranked(classified: DataFrame, up: bool = False) -> DataFrame:
    """Equipment by score; ties in order of first occurrence, then of token."""
    order = [F.asc("score"), F.desc("first_ord"), F.desc("token")] if up else [F.desc("score"), F.asc("first_ord"), F.asc("token")]
    return classified.where("category = 'EQUIP'").orderBy(*order)


def top_equipment(classified: DataFrame, config: VocabConfig = VocabConfig()) -> DataFrame:
    return _ranked(classified).limit(config.max_equip)


def bottom_equipment(classified: DataFrame, config: VocabConfig = VocabConfig()) -> DataFrame:
    """The end of the untrimmed ranking, best first."""
    last = _ranked(classified, up=True).limit(config.bottom)
    return last.orderBy(F.desc("score"), F.asc("first_ord"), F.asc("token"))


def trim(classified: DataFrame, config: VocabConfig = VocabConfig()) -> DataFrame:
    """The terms that stay: the best equipment, other scored terms from their least score on, all IO types and vendors.

    One pass: the rank is cut before the shuffle, as every term but equipment is ranked alone.
    """
    kind, score_ = F.col("category"), F.col("score")
    kept = classified.where(
        kind.isin("EQUIP", "IO_TYPE", "VENDOR_TAG")
        | (kind == "SUBCOMP") & (score_ >= config.min_subcomp_score)
        | (kind == "POINT_FUNC") & (score_ >= config.min_point_func_score)
    )
    alone = F.when(kind == "EQUIP", F.lit(None).cast("string")).otherwise(F.col("token"))
    rank = F.row_number().over(Window.partitionBy(alone).orderBy(F.desc("score"), F.asc("first_ord"), F.asc("token")))
    return kept.withColumn("_rank", rank).where(F.col("_rank") <= config.max_equip).drop("_rank")


def vocabulary_rows(kept: DataFrame) -> DataFrame:
    return kept.select("category", "token")


def bundle(classified: DataFrame, corpus: DataFrame, config: VocabConfig = VocabConfig()) -> DataFrame:
    """One row: frequencies of all tokens, a sorted list for each category, and counts."""
    kept = trim(classified, config)

    def terms(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("category") == kind, F.col("token"))))

    lists = kept.agg(
        terms("EQUIP").alias("equip_vocab"),
        terms("SUBCOMP").alias("subcomp_vocab"),
        terms("POINT_FUNC").alias("point_func_vocab"),
        terms("IO_TYPE").alias("io_type_vocab"),
        terms("VENDOR_TAG").alias("vendor_vocab"),
        F.lit(1).alias("one"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_ord", "token", "freq")))
    entries = F.transform(ordered, lambda x: F.struct(x["token"], x["freq"]))
    frequency = classified.agg(F.map_from_entries(entries).alias("frequency"), F.lit(1).alias("one"))
    counts = corpus.select(F.struct("num_tokens", "num_buildings").alias("stats"), F.lit(1).alias("one"))
    return frequency.join(lists, "one").join(counts, "one").drop("one")


def document_lines(classified: DataFrame, corpus: DataFrame, config: VocabConfig = VocabConfig()) -> DataFrame:
    """``line``: the lines of the vocabulary as one JSON document, in order, by ranges; no row or task holds all tokens.

    The document has a line for each token, frequencies in order of first occurrence and lists in order of term. Only the
    first entry of each section, which has no comma before it, and the two counts pass through the driver.
    """
    spark = classified.sparkSession
    kept = staged(trim(classified, config).select("category", "token"), "kept")
    text = lambda x: F.expr(f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    least = classified.agg(F.min(F.struct("first_ord", "token")).alias("x")).first().x
    leasts = {r.category: r.t for r in kept.groupBy("category").agg(F.min("token").alias("t")).collect()}
    counts = corpus.first()
    fixed, entries = [(0, '{"frequency": {')], []

    def section(rows: DataFrame, number: int, place: Column, first: str | None, value: Column) -> None:
        comma = F.when(F.col("token").eqNullSafe(F.lit(first)), "").otherwise(", ")
        entries.append(rows.select(F.lit(number).alias("section"), place.cast("decimal(38,0)").alias("place"), "token", F.concat(comma, value).alias("line")))

    section(classified, 1, F.col("first_ord"), least and least.token, F.concat(text("token"), F.lit(": "), F.col("freq").cast("string")))
    before = "}"
    for i, (category, name) in enumerate(CATEGORY_LISTS):
        fixed.append((2 + 2 * i, f'{before}, "{name}": ['))
        section(kept.where(F.col("category") == category), 3 + 2 * i, F.lit(None), leasts.get(category), text("token"))
        before = "]"
    fixed.append((2 + 2 * len(CATEGORY_LISTS), f'{before}, "stats": {{"num_tokens": {counts.num_tokens}, "num_buildings": {counts.num_buildings}}}}}'))
    out = spark.createDataFrame([(n, None, None, line) for n, line in fixed], "section int, place decimal(38,0), token string, line string")
    for e in entries:
        out = out.unionByName(e)
    return out.sort("section", "place", "token").select("line")
