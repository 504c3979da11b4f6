"""Queries over the test tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.config import ExtractConfig, VocabConfig, Vocabulary
from tagloom.__main__ import job as run_job
from tagloom.functions.labels import FIELDS, bio_tags, label_tokens, structured
from tagloom.functions.text import building_id, is_point_like, tokenize
from tagloom.operators.extract import choose_columns, column_scores, detect_headers, load_points, points_from_cells
from tagloom.operators.labelling import annotate, annotate_by_lookup, label_by_lookup, label_counts, lookup_table
from tagloom.operators.sample import ordered_samples, sample_one_per_building, sample_positions
from tagloom.operators.stats import corpus_of_supports, corpus_stats, explode_tokens, stats_of_supports, token_counts_by_building, token_stats, token_supports
from tagloom.operators.vocab import bottom_equipment, bundle, classify, document_lines, is_io_type, is_vendor, passes_thresholds, top_equipment, trim, vocabulary_rows
from tagloom.plans.jobs import JobReport, in_corpus_order, job_summary, run_extract
from tagloom.sources.jsonl import (
    CATEGORY_LISTS, numbered_lines, read_points, read_vocabulary, vocabulary_terms, write_document, write_json, write_lines, write_vocabulary,
)
from tagloom.sources.scratch import scratch, staged

Query = Callable[[SparkSession, str], DataFrame]

#: Label sources: table, id, label and building as Spark expressions, and as SQL where that differs.
SOURCES = {
    "urls": ("pages", "page_id", "url", "split_part(split_part(url, '://', 2), '/', 1)"),
    "customers": ("customer", "c_custkey", "c_name", "cast(c_nationkey as string)"),
    "parts": ("part", "p_partkey", "p_name", "p_type"),
    "brands": ("part", "p_partkey", "p_brand", "p_type"),
    "priorities": ("orders", "o_orderkey", "o_orderpriority", "cast(o_custkey % 7 as string)"),
    "nations": ("nation", "n_nationkey", "n_name", "cast(n_regionkey as string)"),
    "documents": ("documents", "doc_id", "text", "source"),
    # Every field of the structured view but bldg, zones of several tokens, null and empty labels, null buildings.
    "sites": (
        "nation", "n_nationkey",
        "case when n_nationkey = 3 then null when n_nationkey = 4 then '' when n_nationkey = 5 then '._-/' else concat('BLDG', n_nationkey, '.fl', n_regionkey, "
        "'-RM', n_nationkey + 99, 'B zone ', n_nationkey, ' ', n_name, ' Customer floor#NET https-LOW urgent specified COM not') end",
        "nullif(concat('r', n_regionkey), 'r2')",
    ),
}
#: What the jobs read in their folder: a file of parts and one of customers.
JOB_FILES = {
    "part": ("part", "p_partkey", "concat(p_brand, '_AHU-', p_size, '.TEMP')", "'parts'"),
    "customer": ("customer", "c_custkey + 1000000000", "concat(c_name, '_AHU-', c_nationkey, '.TEMP CMD')", "'customers'"),
}
CONFIG = VocabConfig(
    min_freq=5,
    max_equip=20,
    bottom=10,
    seed_equip=("HTTPS", "HTTP", "NATION"),
    seed_subcomp=("COM", "THE"),
    seed_point_func=("EXAMPLE", "AND"),
    io_types=("A", "IN", "ON"),
    vendor_hints=("ORG",),
    equip_stopwords=("OF", "TO"),
    measurement_keywords=("TION", "OUS"),
    function_keywords=("ER", "PAGE"),
)
TERMS = Vocabulary(
    equip=frozenset({"CUSTOMER", "BRAND", "NATION"}),
    subcomp=frozenset({"HIGH", "LOW", "HTTPS", "PAGE"}),
    point_func=frozenset({"URGENT", "SPECIFIED", "EXAMPLE", "NATION"}),
    io_type=frozenset({"NOT", "COM"}),
    vendor_tag=frozenset({"#", "ORG", "NET"}),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(F.expr(key).cast("long").alias("point_ord"), F.expr(label).alias("point_label"), F.expr(building).alias("building_id"))
        for name, key, label, building in (JOB_FILES.values() if source == "job_files" else [SOURCES[source]])
    ]
    return reduce(DataFrame.union, parts)


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
_TOKEN = rf"[A-Za-z]+|\p{{Nd}}+|[^A-Za-z0-9 _./:\-{_SPACE}]"


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _points_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({key} AS BIGINT) AS id, {label} AS label, {building.replace('as string', 'as varchar')} AS building FROM {name}"
        for name, key, label, building in (JOB_FILES.values() if source == "job_files" else [SOURCES[source]])
    )


def _tokens_sql(source: str) -> str:
    """CTEs ``points``, ``lists`` and ``tokens`` (id, building, pos, token as written, up, nxt)."""
    return f"""WITH points AS ({_points_sql(source)}),
lists AS (SELECT id, building, label, regexp_extract_all(label, '{_TOKEN}') AS toks FROM points WHERE label IS NOT NULL),
flat AS (SELECT id, building, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM lists),
tokens AS (SELECT id, building, pos, token, upper(replace(token, 'ß', 'SS')) AS up,
  lead(token) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM flat)"""


def _stats_sql(source: str) -> str:
    return (
        _tokens_sql(source)
        + """,
stats AS (SELECT up AS token, count(*) AS freq, count(DISTINCT coalesce(building, chr(1))) AS buildings,
  count(*) FILTER (regexp_full_match(nxt, '[\\p{Nd}²³¹]+')) AS numid_bigrams, min(id * 1048576 + pos) AS first_ord FROM tokens GROUP BY up)"""
    )


def _in(column: str, terms) -> str:
    return f"{column} IN (" + ", ".join(f"'{t}'" for t in sorted(terms)) + ")"


def _classified_sql(source: str, c: VocabConfig = CONFIG) -> str:
    upper = "regexp_matches(token, '\\p{Lu}') AND NOT regexp_matches(token, '[\\p{Ll}\\p{Lt}]')"
    passes = f"freq >= {c.min_freq} AND buildings >= {c.min_buildings}"
    return (
        _stats_sql(source)
        + f""",
kinds AS (SELECT *, CASE
  WHEN {_in("token", c.io_types)} THEN 'IO_TYPE'
  WHEN {_in("token", c.vendor_hints)} OR (token LIKE '%{c.vendor_suffix}' AND length(token) <= {c.vendor_max_length}) THEN 'VENDOR_TAG'
  WHEN {_in("token", c.seed_point_func)} OR ({passes} AND regexp_matches(token, '^({"|".join(c.function_keywords)})')) THEN 'POINT_FUNC'
  WHEN {_in("token", c.seed_subcomp)} OR ({passes} AND (regexp_matches(token, '{"|".join(c.measurement_keywords)}')
    OR ({upper} AND length(token) <= 4 AND token LIKE '%T'))) THEN 'SUBCOMP'
  WHEN {_in("token", c.seed_equip)} OR ({passes} AND regexp_full_match(token, '\\p{{L}}{{2,6}}') AND {upper}
    AND NOT {_in("token", c.equip_stopwords)}) THEN 'EQUIP' END AS category FROM stats),
classified AS (SELECT *, CASE category WHEN 'EQUIP' THEN freq + 2 * buildings + 3 * numid_bigrams
  WHEN 'SUBCOMP' THEN freq + 2 * buildings WHEN 'POINT_FUNC' THEN freq + buildings END AS score FROM kinds)"""
    )


def _trimmed_sql(source: str, c: VocabConfig = CONFIG) -> str:
    return (
        _classified_sql(source, c)
        + f""",
kept AS (SELECT * FROM classified WHERE category IN ('IO_TYPE', 'VENDOR_TAG')
  OR (category = 'SUBCOMP' AND score >= {c.min_subcomp_score}) OR (category = 'POINT_FUNC' AND score >= {c.min_point_func_score})
  UNION ALL (SELECT * FROM classified WHERE category = 'EQUIP' ORDER BY score DESC, first_ord, token LIMIT {c.max_equip}))"""
    )


_STATS_OUT = "token, CAST(freq AS BIGINT) AS freq, CAST(buildings AS BIGINT) AS buildings, CAST(numid_bigrams AS BIGINT) AS numid_bigrams"
_SCORED_OUT = _STATS_OUT + ", category, CAST(score AS BIGINT) AS score"


def _lookups_sql(v: Vocabulary = TERMS) -> str:
    return " ".join(f"WHEN {_in('up', terms)} THEN '{name}'" for name, terms in v.in_lookup_order() if terms)


def _labelled_sql(lookups: str) -> str:
    """CTEs ``labelled`` and ``tagged`` over ``tokens``."""
    letter = "[A-Za-z]"
    return f""",
labelled AS (SELECT *, CASE {lookups}
  WHEN regexp_full_match(token, '[Ff][Ll]?\\p{{Nd}}+|[Ff][Ll][Oo][Oo][Rr]') THEN 'FLOOR'
  WHEN regexp_full_match(token, '[Rr][Mm]\\p{{Nd}}+{letter}?|\\p{{Nd}}{{3,4}}{letter}?|\\p{{Nd}}{letter}{{1,3}}\\p{{Nd}}{{1,3}}') THEN 'ZONE'
  WHEN regexp_full_match(token, '\\p{{Nd}}+|[A-Z]?\\p{{Nd}}{{2,3}}[A-Z]?') THEN 'EQUIP_ID'
  WHEN regexp_full_match(token, '[Bb][Ll][Dd][Gg]\\p{{Nd}}+') THEN 'BLDG' ELSE 'MISC' END AS label FROM tokens),
tagged AS (SELECT *, CASE WHEN label = 'MISC' THEN 'O' WHEN label = lag(label) OVER (PARTITION BY id ORDER BY pos) THEN 'I-' || label
  ELSE 'B-' || label END AS bio FROM labelled)"""


def _labels_sql(source: str, v: Vocabulary = TERMS) -> str:
    return _tokens_sql(source) + _labelled_sql(_lookups_sql(v))


_VIEW = """
view AS (SELECT id,
  arg_min(token, pos) FILTER (label = 'BLDG') AS bldg, arg_min(token, pos) FILTER (label = 'FLOOR') AS floor,
  string_agg(token, ' ' ORDER BY pos) FILTER (label = 'ZONE') AS zone,
  arg_min(token, pos) FILTER (label = 'EQUIP') AS equip, arg_min(token, pos) FILTER (label = 'EQUIP_ID') AS equip_id,
  arg_max(token, pos) FILTER (label = 'SUBCOMP') AS subcomp, arg_max(token, pos) FILTER (label = 'POINT_FUNC') AS point_func,
  arg_max(token, pos) FILTER (label = 'IO_TYPE') AS io_type, arg_max(token, pos) FILTER (label = 'VENDOR_TAG') AS vendor,
  string_agg(token, '|' ORDER BY pos) AS tokens, string_agg(label, '|' ORDER BY pos) AS token_labels, string_agg(bio, '|' ORDER BY pos) AS bio_tags
  FROM tagged GROUP BY id)"""


def _like_sql(column: str) -> str:
    s = f"regexp_replace({column}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
    letters, capitals = f"length(regexp_replace({s}, '[^\\p{{L}}]', '', 'g'))", f"length(regexp_replace({s}, '[^\\p{{Lu}}]', '', 'g'))"
    digit, upper = f"regexp_matches({s}, '[\\p{{Nd}}²³¹]')", f"regexp_matches({s}, '\\p{{Lu}}')"
    return f"""coalesce(length({s}) >= 3 AND (coalesce({capitals} / nullif(CAST({letters} AS DOUBLE), 0) >= 0.7, false)
  OR (regexp_matches({s}, '[_.\\-]') AND ({digit} OR {upper})) OR ({digit} AND {upper})), false)"""


# --- queries -----------------------------------------------------------------------------------------------------------

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _stats_columns() -> list[Column]:
    return [F.col(c) for c in ("token", "freq", "buildings", "numid_bigrams")]


def _first() -> Column:
    """A first occurrence as one number that Spark and SQL both have: 2**20 for each point."""
    return F.expr("cast(first_ord div 2147483648 as bigint) * 1048576 + cast(first_ord % 2147483648 as bigint)").alias("first_ord")


def _scored(frame: DataFrame) -> DataFrame:
    return frame.select(*_stats_columns(), "category", "score")


def _classified(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return classify(token_stats(points(spark, sf_dir, source)), CONFIG)


for _s in ("urls", "brands", "customers", "priorities", "nations"):
    _add(
        f"tokenize_{_s}",
        lambda spark, d, s=_s: points(spark, d, s).select(F.col("point_ord").alias("id"), F.posexplode(tokenize(F.col("point_label"))).alias("pos", "token")),
        _tokens_sql(_s) + " SELECT id, CAST(pos AS INTEGER) AS pos, token FROM tokens",
    )
for _s in ("urls", "documents", "parts"):
    _add(
        f"token_frequency_{_s}",
        lambda spark, d, s=_s: explode_tokens(points(spark, d, s)).groupBy("token").agg(F.count("*").alias("freq")),
        _tokens_sql(_s) + " SELECT up AS token, count(*) AS freq FROM tokens GROUP BY up",
    )
    _add(
        f"token_stats_{_s}",
        lambda spark, d, s=_s: token_stats(points(spark, d, s)).select(*_stats_columns(), _first()),
        _stats_sql(_s) + f" SELECT {_STATS_OUT}, first_ord FROM stats",
    )
_add(
    "token_building_support",
    lambda spark, d: token_stats(points(spark, d, "brands")).select("token", "buildings"),
    _stats_sql("brands") + " SELECT token, CAST(buildings AS BIGINT) AS buildings FROM stats",
)
_add(
    "numeric_bigrams",
    lambda spark, d: token_stats(points(spark, d, "customers")).where("numid_bigrams > 0").select("token", "numid_bigrams"),
    _stats_sql("customers") + " SELECT token, CAST(numid_bigrams AS BIGINT) AS numid_bigrams FROM stats WHERE numid_bigrams > 0",
)
_add(
    "token_counts_by_building",
    lambda spark, d: token_counts_by_building(points(spark, d, "urls")).select("token", "building_id", "freq", "numid_bigrams"),
    _tokens_sql("urls")
    + " SELECT up AS token, building AS building_id, count(*) AS freq, count(*) FILTER (regexp_full_match(nxt, '\\p{Nd}+')) AS numid_bigrams FROM tokens GROUP BY ALL",
)
_add(
    "corpus_stats",
    lambda spark, d: corpus_stats(points(spark, d, "documents")),
    _tokens_sql("documents") + " SELECT count(DISTINCT up) AS num_tokens, count(DISTINCT coalesce(building, chr(1))) AS num_buildings FROM tokens",
)
for _s in ("urls", "parts", "documents"):
    _add(
        f"point_like_{_s}",
        lambda spark, d, s=_s: points(spark, d, s).select(F.col("point_ord").alias("id"), is_point_like(F.col("point_label")).alias("point_like")),
        f"SELECT id, {_like_sql('label')} AS point_like FROM ({_points_sql(_s)})",
    )
_add(
    "io_vendor_flags",
    lambda spark, d: token_stats(points(spark, d, "documents")).select(
        "token", is_io_type(F.col("token"), CONFIG).alias("is_io"), is_vendor(F.col("token"), CONFIG).alias("is_vendor"),
        passes_thresholds(F.col("freq"), F.col("buildings"), CONFIG).alias("passes"),
    ),
    _stats_sql("documents")
    + f" SELECT token, {_in('token', CONFIG.io_types)} AS is_io, ({_in('token', CONFIG.vendor_hints)} OR (token LIKE '%NET' AND length(token) <= 8)) AS is_vendor,"
    + f" (freq >= {CONFIG.min_freq} AND buildings >= {CONFIG.min_buildings}) AS passes FROM stats",
)
for _s in ("urls", "documents"):
    _end = "" if _s == "urls" else f"_{_s}"
    _add(
        f"classify_tokens{_end}",
        lambda spark, d, s=_s: _classified(spark, d, s).select("token", "category"),
        _classified_sql(_s) + " SELECT token, category FROM classified",
    )
    _add(f"score_tokens{_end}", lambda spark, d, s=_s: _scored(_classified(spark, d, s)), _classified_sql(_s) + f" SELECT {_SCORED_OUT} FROM classified")
    _add(f"trim_vocab{_end}", lambda spark, d, s=_s: _scored(trim(_classified(spark, d, s), CONFIG)), _trimmed_sql(_s) + f" SELECT {_SCORED_OUT} FROM kept")
_add(
    "topk_equipment",
    lambda spark, d: _scored(top_equipment(_classified(spark, d, "documents"), CONFIG)),
    _classified_sql("documents") + f" SELECT {_SCORED_OUT} FROM classified WHERE category = 'EQUIP' ORDER BY score DESC, first_ord, token LIMIT {CONFIG.max_equip}",
)
_add(
    "bottom_equipment",
    lambda spark, d: _scored(bottom_equipment(_classified(spark, d, "documents"), CONFIG)),
    _classified_sql("documents") + f" SELECT {_SCORED_OUT} FROM classified WHERE category = 'EQUIP' ORDER BY score, first_ord DESC, token DESC LIMIT {CONFIG.bottom}",
)
_add(
    "vocab_lists",
    lambda spark, d: vocabulary_rows(trim(_classified(spark, d, "documents"), CONFIG)),
    _trimmed_sql("documents") + " SELECT category, token FROM kept",
)


def _annotated(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    rows = points(spark, sf_dir, source)
    return rows.select(F.col("point_ord").alias("id"), "point_label", "building_id").transform(
        lambda r: annotate(r.withColumn("source_file", F.col("id").cast("string")), TERMS)
    )


def _token_rows(annotated: DataFrame, column: str, name: str) -> DataFrame:
    zipped = F.arrays_zip(F.col("tokens").alias("t"), F.col(column).alias("v"))
    rows = annotated.select(F.col("source_file").cast("long").alias("id"), F.posexplode(zipped).alias("pos", "x"))
    return rows.select("id", "pos", F.col("x.t").alias("token"), F.col("x.v").alias(name))


def _label_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(c, t) for c, ts in TERMS.in_lookup_order() for t in sorted(ts)], "category string, token string")
    rows = points(spark, sf_dir, "brands").select(F.col("point_ord").alias("id"), F.posexplode(tokenize(F.col("point_label"))).alias("pos", "token"))
    return label_by_lookup(rows, lookup_table(terms)).select("id", "pos", "token", "label")


def _flat_annotation(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    rows = _annotated(spark, sf_dir, source)
    joined = [F.array_join(c, "|").alias(c) for c in ("tokens", "token_labels", "bio_tags")]
    return rows.select(F.col("source_file").cast("long").alias("id"), "point_label", "building_id", "label_source", *joined, *(F.col(f"structured.{f}").alias(f) for f in FIELDS))


for _s in ("urls", "customers", "priorities", "sites"):
    _add(
        f"label_tokens_{_s}",
        lambda spark, d, s=_s: _token_rows(_annotated(spark, d, s), "token_labels", "label"),
        _labels_sql(_s) + " SELECT id, CAST(pos AS INTEGER) AS pos, token, label FROM labelled",
    )


def _annotated_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with every part name and country of customers as a term: a vocabulary that grows with the tables."""
    names = table(spark, sf_dir, "part").select(F.lit("EQUIP").alias("category"), F.explode(F.split(F.upper("p_name"), " ")).alias("token"))
    numbers = table(spark, sf_dir, "customer").select(F.lit("VENDOR_TAG").alias("category"), F.substring("c_name", 10, 9).alias("token"))
    rows = annotate_by_lookup(points(spark, sf_dir, "job_files"), lookup_table(names.unionByName(numbers)), frequent_rows=20)
    joined = [F.array_join(c, "|").alias(c) for c in ("tokens", "token_labels", "bio_tags")]
    return rows.select(F.col("point_ord").alias("id"), "point_label", *joined, "structured.*")


_add(
    "annotate_by_lookup",
    _annotated_by_lookup,
    _tokens_sql("job_files")
    + ", terms AS (SELECT 'EQUIP' AS category, unnest(string_split(upper(p_name), ' ')) AS term FROM part UNION SELECT 'VENDOR_TAG', substring(c_name, 10, 9) FROM customer)"
    + _labelled_sql(" ".join(f"WHEN up IN (SELECT term FROM terms WHERE category = '{c}') THEN '{c}'" for c in ("VENDOR_TAG", "EQUIP")))
    + "," + _VIEW + f" SELECT p.id, p.label AS point_label, tokens, token_labels, bio_tags, {', '.join(FIELDS)} FROM points p JOIN view v ON p.id = v.id",
)
_add("label_by_lookup", _label_by_join, _labels_sql("brands") + " SELECT id, CAST(pos AS INTEGER) AS pos, token, label FROM labelled")
_add(
    "label_histogram",
    lambda spark, d: label_counts(points(spark, d, "documents"), TERMS),
    _labels_sql("documents") + " SELECT label, count(*) AS n FROM labelled GROUP BY label",
)
_add(
    "bio_tags",
    lambda spark, d: _token_rows(_annotated(spark, d, "urls"), "bio_tags", "bio"),
    _labels_sql("urls") + " SELECT id, CAST(pos AS INTEGER) AS pos, token, bio FROM tagged",
)
_add(
    "structured_view",
    lambda spark, d: _annotated(spark, d, "priorities").select(F.col("source_file").cast("long").alias("id"), "structured.*"),
    _labels_sql("priorities") + "," + _VIEW + f" SELECT id, {', '.join(FIELDS)} FROM view",
)
_FLAT = (
    f" SELECT p.id, p.label AS point_label, p.building AS building_id, 'rule' AS label_source, coalesce(tokens, '') AS tokens, "
    f"coalesce(token_labels, '') AS token_labels, coalesce(bio_tags, '') AS bio_tags, {', '.join(FIELDS)} FROM points p LEFT JOIN view v ON p.id = v.id"
)
for _s in ("urls", "sites"):
    _end = "" if _s == "urls" else f"_{_s}"
    _add(f"annotate{_end}", lambda spark, d, s=_s: _flat_annotation(spark, d, s), _labels_sql(_s) + "," + _VIEW + _FLAT)
#: Tokens that no label is split into: floors, zones, buildings and equipment in one token each.
_GIVEN = (
    "concat('FL', n_regionkey)", "concat('f', n_nationkey)", "concat('BLDG', n_nationkey)", "concat('bldg', n_nationkey + 1)", "concat('RM', n_nationkey, 'e')", "concat(n_nationkey + 99, 'K')",
    "concat('2SE', n_nationkey)", "concat('A', n_nationkey + 90, 'B')", "concat('a', n_nationkey + 10)", "cast(n_nationkey as varchar(9))", "'Floor'", "'brand'", "n_name",
)


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(*map(F.expr, _GIVEN)).alias("tokens"))
    rows = rows.withColumn("labels", label_tokens(F.col("tokens"), TERMS))
    return rows.select("id", "tokens", "labels", bio_tags(F.col("labels")).alias("bio"), structured(F.col("tokens"), F.col("labels")).alias("structured"))


_GIVEN_SQL = f"""WITH lists AS (SELECT CAST(n_nationkey AS BIGINT) AS id, [{", ".join(_GIVEN)}] AS toks FROM nation),
tokens AS (SELECT *, upper(token) AS up FROM (SELECT id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM lists))""" + _labelled_sql(_lookups_sql())
_add(
    "label_given_tokens",
    lambda spark, d: _given(spark, d).select("id", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("labels").alias("label"), "bio"))).select("id", "pos", "col.*"),
    _GIVEN_SQL + " SELECT id, CAST(pos AS INTEGER) AS pos, token, label, bio FROM tagged",
)
_add("structured_given_tokens", lambda spark, d: _given(spark, d).select("id", "structured.*"), _GIVEN_SQL + "," + _VIEW + f" SELECT id, {', '.join(FIELDS)} FROM view")
_add(
    "token_stats_null_buildings",
    lambda spark, d: token_stats(points(spark, d, "sites")).select(*_stats_columns(), _first()),
    _stats_sql("sites") + f" SELECT {_STATS_OUT}, first_ord FROM stats",
)
_add(
    "corpus_stats_null_buildings",
    lambda spark, d: corpus_stats(points(spark, d, "sites")),
    _tokens_sql("sites") + " SELECT count(DISTINCT up) AS num_tokens, count(DISTINCT coalesce(building, chr(1))) AS num_buildings FROM tokens",
)


# --- vocabulary bundles and files --------------------------------------------------------------------------------------


def _flat_bundle(one: DataFrame) -> DataFrame:
    lists = ("equip_vocab", "subcomp_vocab", "point_func_vocab", "io_type_vocab", "vendor_vocab")
    entries = F.array_sort(F.transform(F.map_entries("frequency"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return one.select(F.array_join(entries, "|").alias("frequency"), *(F.array_join(c, "|").alias(c) for c in lists), "stats.num_tokens", "stats.num_buildings")


def _counted(spark: SparkSession, sf_dir: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Classified tokens and the corpus's counts, written once as in the vocabulary job: labels are tokenized once, whatever reads them."""
    counts = staged(token_supports(points(spark, sf_dir, source)), "counts")
    return staged(classify(stats_of_supports(counts), CONFIG), "classified"), corpus_of_supports(counts)


def _bundle(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return bundle(*_counted(spark, sf_dir, source), CONFIG)


def _bundle_sql(source: str) -> str:
    kinds = {"EQUIP": "equip_vocab", "SUBCOMP": "subcomp_vocab", "POINT_FUNC": "point_func_vocab", "IO_TYPE": "io_type_vocab", "VENDOR_TAG": "vendor_vocab"}
    lists = ", ".join(f"coalesce((SELECT string_agg(token, '|' ORDER BY token) FROM kept WHERE category = '{k}'), '') AS {v}" for k, v in kinds.items())
    return (
        _trimmed_sql(source)
        + f" SELECT (SELECT string_agg(token || '=' || freq, '|' ORDER BY token || '=' || freq) FROM stats) AS frequency, {lists},"
        + " (SELECT count(*) FROM stats) AS num_tokens, (SELECT count(DISTINCT coalesce(building, chr(1))) FROM tokens) AS num_buildings"
    )


def _records(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Point records in a folder, as text files of many parts, read back."""
    path = scratch(spark, f"points-{source}")
    rows = points(spark, sf_dir, source).select("building_id", F.col("building_id").alias("source_file"), "point_label", F.lit("col_0").alias("point_label_col"))
    write_json(rows.repartition(3), path)
    return read_points(spark, path)


def _vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "vocabulary")
    write_vocabulary(_bundle(spark, sf_dir, "urls"), path)
    found = read_vocabulary(spark, path)
    return spark.createDataFrame([(c, t) for c, ts in found.in_lookup_order() for t in ts], "category string, token string")


def _document(spark: SparkSession, sf_dir: str, source: str) -> str:
    """The vocabulary as a document of many parts."""
    path = scratch(spark, "document")
    write_document(document_lines(*_counted(spark, sf_dir, source), CONFIG), path)
    return path


def _document_sql(source: str) -> str:
    parts = [
        "SELECT 0 AS section, NULL AS place, NULL AS token, '{\"frequency\": {' AS line",
        "SELECT 1, first_ord, token, CASE WHEN row_number() OVER (ORDER BY first_ord, token) > 1 THEN ', ' ELSE '' END || CAST(to_json(token) AS VARCHAR) || ': ' || freq FROM stats",
    ]
    for i, (category, name) in enumerate(CATEGORY_LISTS):
        parts.append(f"SELECT {2 + 2 * i}, NULL, NULL, '{']' if i else '}'}, \"{name}\": ['")
        parts.append(f"SELECT {3 + 2 * i}, NULL, token, CASE WHEN row_number() OVER (ORDER BY token) > 1 THEN ', ' ELSE '' END || CAST(to_json(token) AS VARCHAR) FROM kept WHERE category = '{category}'")
    stats = "'], \"stats\": {\"num_tokens\": ' || (SELECT count(*) FROM stats) || ', \"num_buildings\": ' || (SELECT count(DISTINCT coalesce(building, chr(1))) FROM tokens) || '}}'"
    parts.append(f"SELECT {2 + 2 * len(CATEGORY_LISTS)}, NULL, NULL, {stats}")
    return _trimmed_sql(source) + f" SELECT row_number() OVER (ORDER BY section, place, token) AS line, line AS value FROM ({' UNION ALL '.join(parts)})"


for _s in ("documents", "sites"):
    _add(f"vocabulary_document_{_s}", lambda spark, d, s=_s: numbered_lines(spark, _document(spark, d, s)), _document_sql(_s))
_add("vocabulary_terms", lambda spark, d: vocabulary_terms(spark, _document(spark, d, "documents")), _trimmed_sql("documents") + " SELECT category, token FROM kept")
for _s in ("urls", "documents", "sites"):
    _add(f"vocab_bundle_{_s}", lambda spark, d, s=_s: _flat_bundle(_bundle(spark, d, s)), _bundle_sql(_s))
_add(
    "jsonl_round_trip",
    lambda spark, d: _records(spark, d, "sites"),
    f"SELECT building AS building_id, building AS source_file, label AS point_label, 'col_0' AS point_label_col FROM ({_points_sql('sites')})",
)
_add("vocabulary_file", _vocabulary_file, _trimmed_sql("urls") + " SELECT category, token FROM kept")
_add(
    "job_summary",
    lambda spark, d: job_summary(_records(spark, d, "urls")),
    f"SELECT count(*) AS points, count(DISTINCT building) AS files, count(DISTINCT building) AS buildings FROM ({_points_sql('urls')})",
)

# Cell tables from columns of given tables: table, key, cells of a row as expressions, and the cells of the header if there is one.
# Customers headed by their column names, parts without a header; preferred names over better columns and in order of rank, the
# rule for two rows, null cells and headers, a score of just the least, names that stand twice, words alone, ties.
_CELLS = {
    "01_customer.csv": ("customer", "c_custkey", ("c_name", "c_mktsegment"), ("c_name", "c_mktsegment")),
    "2-part.csv": ("part", "p_partkey", ("p_name", "case when p_size > 20 then p_brand else lower(p_brand) end", "p_type"), None),
    "3_region.csv": ("region", "r_regionkey", ("r_name", "nullif(concat('heat pump ', r_regionkey), 'heat pump 3')"), ("Zone", "Bas_Raw")),
    "4-nation.csv": ("nation", "n_nationkey", ("n_name", "concat('plain ', lower(n_name))", "concat('C', n_nationkey, '_PO')"), ("one", "LABEL", "johnson controls name")),
    "fallback.csv": ("region", "r_regionkey", ("case when r_regionkey in (1, 2) then lower(r_name) else concat('KW_', r_regionkey, '.HI') end",), ("points",)),
    "null_header.csv": ("region", "r_regionkey", ("concat('kind ', r_regionkey)", "concat('VFD', r_regionkey, '.SPD')"), ("kind", None)),
    "gaps.csv": ("nation", "n_nationkey", ("nullif(lower(n_name), 'nation_3')", "nullif(concat('G', n_nationkey, '.X'), 'G3.X')"), None),
    "least.csv": ("region", "r_regionkey", ("case when r_regionkey = 4 then 'KW_1' else lower(r_name) end",), None),
    "twice.csv": ("nation", "n_nationkey", ("concat('Q', n_nationkey)", "n_name"), ("label", "label")),
    "words.csv": ("region", "r_regionkey", ("lower(r_name)",), None),
    "tie.csv": ("nation", "n_nationkey", ("concat('T_', n_nationkey)", "concat('U_', n_nationkey)"), None),
}
_FULL = ExtractConfig(exact_sample=False)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of each table, whatever the files made of it, and the headers."""
    schema = "source_file string, row_no long, col_no int, cell string"
    out = spark.createDataFrame([(f, 0, i, c) for f, (*_, header) in _CELLS.items() for i, c in enumerate(header or ())], schema)
    for name, key in sorted({(name, key) for name, key, *_ in _CELLS.values()}):
        rows = table(spark, sf_dir, name)
        least = rows.agg(F.min(key)).first()[0]
        parts = [
            F.struct(F.lit(file).alias("source_file"), (F.col(key) - least + int(header is not None)).cast("long").alias("row_no"), F.lit(i).alias("col_no"), F.expr(c).cast("string").alias("cell"))
            for file, (own, _, columns, header) in _CELLS.items() if own == name for i, c in enumerate(columns)
        ]
        out = out.unionByName(rows.select(F.inline(F.array(*parts))))
    return out


def _table_cells_sql() -> str:
    parts = []
    for file, (name, key, columns, header) in _CELLS.items():
        for i, c in enumerate(columns):
            parts.append(f"SELECT '{file}' AS source_file, {key} - (SELECT min({key}) FROM {name}) + {int(header is not None)} AS row_no, {i} AS col_no, {c} AS cell FROM {name}")
            if header:
                parts.append(f"SELECT '{file}', 0, {i}, {_quoted(header[i])}")
    return " UNION ALL ".join(parts)


def _sampled_sql(sizes: tuple[int, ...]) -> str:
    """Positions that the seeded sample takes, for columns of these sizes; of others all cells count."""
    return ", ".join(f"({n}, {at})" for n in sizes for at in sample_positions(n, ExtractConfig().sample))


def _cells_sql(sizes: tuple[int, ...] = ()) -> str:
    sampled = "true"
    if sizes:
        sampled = f"n_filled <= {ExtractConfig().sample} OR (n_filled, place) IN (SELECT (a, b) FROM (VALUES {_sampled_sql(sizes)}) AS v(a, b))"
    return f"""WITH cells AS ({_table_cells_sql()}),
likes AS (SELECT *, {_like_sql("cell")} AS lk FROM cells),
cols AS (SELECT source_file, col_no, bool_or(row_no = 0 AND lk) AS b0, bool_or(row_no = 1 AND lk) AS b1, bool_or(row_no = 2 AND lk) AS b2,
  max(row_no) + 1 AS n FROM likes GROUP BY ALL),
heads AS (SELECT source_file, (max(n) >= 3 AND bool_or(NOT b0 AND b1 AND b2)) OR (max(n) >= 2 AND count(*) FILTER (b0) = 0 AND count(*) FILTER (b1) > 0)
  AS has_header FROM cols GROUP BY source_file),
named AS (SELECT l.source_file, l.row_no, l.col_no, l.cell, l.lk, CASE WHEN has_header THEN coalesce(t.cell, 'nan') ELSE 'col_' || l.col_no END AS col_name
  FROM likes l JOIN heads h USING (source_file) LEFT JOIN cells t ON t.source_file = l.source_file AND t.col_no = l.col_no AND t.row_no = 0
  WHERE l.row_no >= CAST(has_header AS INTEGER)),
columns AS (SELECT source_file, col_no, min(col_name) AS col_name FROM named GROUP BY source_file, col_no),
names AS (SELECT *, count(*) OVER (PARTITION BY source_file, col_name) AS same FROM columns),
filled AS (SELECT named.*, count(*) OVER (PARTITION BY source_file, col_no) AS n_filled, row_number() OVER (PARTITION BY source_file, col_no ORDER BY row_no) - 1 AS place
  FROM named JOIN names USING (source_file, col_no, col_name) WHERE cell IS NOT NULL AND same = 1),
scores AS (SELECT source_file, col_no, min(col_name) AS col_name, avg(CAST(lk AS DOUBLE)) AS score FROM filled WHERE {sampled} GROUP BY source_file, col_no),
preferred AS (SELECT *, list_position({list(ExtractConfig().preferred)}, lower(col_name)) AS rank FROM names WHERE rank > 0
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY rank, col_no DESC) = 1),
chosen AS (SELECT source_file, col_no, col_name FROM preferred WHERE same = 1 UNION ALL
  (SELECT source_file, col_no, col_name FROM scores WHERE score > 0.2 AND source_file NOT IN (SELECT source_file FROM preferred)
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY score DESC, col_no) = 1))"""


_POINTS_OUT = """ SELECT regexp_replace(regexp_replace(source_file, '\\.[^.]+$', ''), '^[0-9]+[_\\-]*', '') AS building_id, source_file,
  coalesce(cell, 'nan') AS point_label, col_name AS point_label_col FROM named JOIN chosen USING (source_file, col_no, col_name)"""
_SCORES_OUT = " SELECT source_file, col_no, col_name, round(score, 9) AS score FROM scores"


def _scores(frame: DataFrame) -> DataFrame:
    return frame.select("source_file", "col_no", "col_name", F.round("score", 9).alias("score"))


#: Sizes of columns, at small scales, for which the oracles of sampled scores hold positions.
_COLUMN_SIZES = (200, 1500, 2000, 150, 20, 15_000, 20_000)
_add("header_detect", lambda spark, d: detect_headers(cells(spark, d)), _cells_sql() + " SELECT source_file, has_header FROM heads")
for _config, _sizes, _name in ((_FULL, (), "{}_all_cells"), (ExtractConfig(), _COLUMN_SIZES, "{}")):
    _sql = _cells_sql(_sizes)
    _add("sampled_column_scores" if _sizes else "column_scores", lambda spark, d, c=_config: _scores(column_scores(cells(spark, d), c)), _sql + _SCORES_OUT)
    _add(_name.format("choose_column"), lambda spark, d, c=_config: choose_columns(cells(spark, d), c), _sql + " SELECT source_file, col_no, col_name FROM chosen")
    _add(_name.format("extract_points"), lambda spark, d, c=_config: points_from_cells(cells(spark, d), c).drop("row_no"), _sql + _POINTS_OUT)


# --- jobs over written folders -----------------------------------------------------------------------------------------


def _text(rows: DataFrame, line: str, path: str) -> None:
    """One file of lines, in the order of ``rows``, added to the folder."""
    rows.select(F.expr(line).alias("value")).coalesce(1).write.mode("append").text(path, lineSep="\n")


_PATTERN = "*.{csv,txt}"


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """Name, brand and key of the parts, all quoted; customers whose quoted names go over two lines; nations in rows of one and two cells."""
    folder = scratch(spark, "csv")
    table(spark, sf_dir, "part").select("p_name", "p_brand", F.col("p_partkey").cast("string")).coalesce(1).write.csv(folder, quoteAll=True)
    _text(table(spark, sf_dir, "customer"), "concat('\"', c_name, chr(10), '\"\"', c_mktsegment, '\"\"\",x')", folder)
    _text(table(spark, sf_dir, "nation").sort("n_nationkey"), """case when n_nationkey = 0 then concat(n_name, ',"a, b"') when n_nationkey = 1 then 'NA' else n_name end""", folder)
    return folder


def _bad_folder(spark: SparkSession, sf_dir: str) -> str:
    """Files that are rejected, each for its reason: a wider row, an open quote, nothing but blanks, no column of points."""
    folder, rows = scratch(spark, "rejects"), table(spark, sf_dir, "region").sort("r_regionkey")
    for line in ("case when r_regionkey = 3 then concat(r_name, ',', r_name) else r_name end", "concat(case when r_regionkey = 4 then '\"' else '' end, r_name)", "repeat(' ', r_regionkey)", "lower(r_name)"):
        _text(rows, line, folder)
    return folder


def _csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_points(spark, _csv_folder(spark, sf_dir), pattern=_PATTERN).points.select("point_label", "point_label_col")


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_points(spark, _bad_folder(spark, sf_dir), pattern=_PATTERN).rejects.select("reason")


def _job_folders(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, JobReport]]:
    """The three jobs as the command line runs them, chained through folders, over a file of parts and one of customers."""
    base = scratch(spark, "jobs")
    for name, _, label, _ in JOB_FILES.values():
        _text(table(spark, sf_dir, name), label, f"{base}/raw")
    points, vocabulary = ["--points", f"{base}/points"], ["--vocabulary", f"{base}/vocabulary"]
    commands = {
        "extract": ["--input", f"{base}/raw", "--pattern", _PATTERN, "--sample", f"{base}/sample", *points],
        "vocab": [*points, *vocabulary],
        "label": [*points, *vocabulary, "--labelled", f"{base}/labelled"],
    }
    return base, {job: run_job(spark, [job, *arguments]) for job, arguments in commands.items()}


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each job and what it counted."""
    _, reports = _job_folders(spark, sf_dir)
    rows = [(job, "rows", r.rows) for job, r in reports.items()]
    rows += [(job, name, n) for job, r in reports.items() for name, n in r.counts.items()]
    return spark.createDataFrame(rows, "job string, name string, n long")


_WRITTEN = "point_label string, tokens array<string>, token_labels array<string>, bio_tags array<string>, label_source string, structured struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">"


def _jobs_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated records that the jobs have written."""
    rows = spark.read.schema(_WRITTEN).json(f"{_job_folders(spark, sf_dir)[0]}/labelled")
    joined = [F.array_join(c, "|").alias(c) for c in ("tokens", "token_labels", "bio_tags")]
    return rows.select("point_label", "label_source", *joined, "structured.*")


def _job_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops a job: columns that are not there, and a folder without points, which leaves what was written before."""
    rows = []
    try:
        sample_one_per_building(table(spark, sf_dir, "nation"))
    except ValueError as e:
        rows.append(("columns", str(e), table(spark, sf_dir, "nation").count()))
    out = scratch(spark, "kept")
    write_json(table(spark, sf_dir, "region"), out)
    try:
        run_extract(spark, _bad_folder(spark, sf_dir), out, pattern=_PATTERN)
    except RuntimeError as e:
        rows.append(("points", str(e), spark.read.text(out).count()))
    return spark.createDataFrame(rows, "guard string, message string, n long")


_add(
    "csv_points",
    _csv_points,
    """SELECT p_brand AS point_label, 'col_1' AS point_label_col FROM part UNION ALL SELECT c_name || chr(10) || '"' || c_mktsegment || '"', 'col_0' FROM customer
UNION ALL SELECT CASE WHEN n_nationkey = 1 THEN 'nan' ELSE n_name END, 'col_0' FROM nation""",
)
_add(
    "csv_rejects",
    _csv_rejects,
    """SELECT 'a row wider than the first' AS reason FROM region WHERE r_regionkey = 3 UNION ALL SELECT 'open quote' FROM region WHERE r_regionkey = 4
UNION ALL SELECT 'empty' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'no label column' FROM region WHERE r_regionkey = 0""",
)
_JOB_LOOKUPS = " ".join(f"WHEN up IN (SELECT token FROM kept WHERE category = '{c}') THEN '{c}'" for c, _ in Vocabulary().in_lookup_order())
_JOB_SQL = _trimmed_sql("job_files", VocabConfig()) + _labelled_sql(_JOB_LOOKUPS)
_add(
    "jobs_chain",
    _jobs,
    _JOB_SQL
    + """, n AS (SELECT (SELECT count(*) FROM points) AS points, (SELECT count(*) FROM tokens) AS tokens, (SELECT count(*) FROM stats) AS distinct_)
SELECT job, name, CAST(n AS BIGINT) AS n FROM (SELECT 'extract' AS job, 'rows' AS name, points AS n FROM n
UNION ALL SELECT 'extract', 'files', (SELECT count(DISTINCT building) FROM points) UNION ALL SELECT 'extract', 'buildings', (SELECT count(DISTINCT building) FROM points)
UNION ALL SELECT 'extract', 'rejected files', 0 UNION ALL SELECT 'vocab', 'rows', distinct_ FROM n UNION ALL SELECT 'vocab', 'tokens', distinct_ FROM n
UNION ALL SELECT 'vocab', 'buildings', (SELECT count(DISTINCT building) FROM tokens) UNION ALL SELECT 'label', 'rows', points FROM n
UNION ALL SELECT 'label', 'tokens', tokens FROM n UNION ALL SELECT 'label', 'without tokens', 0)""",
)
_add(
    "jobs_annotated",
    _jobs_annotated,
    _JOB_SQL + "," + _VIEW + f" SELECT p.label AS point_label, 'rule' AS label_source, tokens, token_labels, bio_tags, {', '.join(FIELDS)} FROM points p JOIN view v ON p.id = v.id",
)
_add(
    "job_guards",
    _job_guards,
    """SELECT 'columns' AS guard, 'missing columns: building_id, point_label, point_ord' AS message, count(*) AS n FROM nation
UNION ALL SELECT 'points', 'no file with point labels', count(*) FROM region""",
)
_add(
    "corpus_order",
    lambda spark, d: _ordered_records(spark, d).select("point_ord", "point_label"),
    "SELECT row_number() OVER (ORDER BY p_partkey) AS point_ord, p_name AS point_label FROM part",
)


def _ordered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ordered")
    rows = table(spark, sf_dir, "part").repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey")
    write_json(rows.select(F.lit("b").alias("building_id"), F.lit("f.csv").alias("source_file"), F.col("p_name").alias("point_label"), F.lit("col_0").alias("point_label_col")), path)
    return in_corpus_order(spark, path)


_add(
    "building_ids",
    lambda spark, d: table(spark, d, "part").select("p_partkey", building_id(F.concat(F.col("p_partkey").cast("string"), F.lit("_-"), "p_brand", F.lit(".csv"))).alias("building_id")),
    "SELECT p_partkey, regexp_replace(regexp_replace(p_partkey || '_-' || p_brand || '.csv', '\\.[^.]+$', ''), '^[0-9]+[_\\-]*', '') AS building_id FROM part",
)
#: Groups of up to so many rows have their positions in the oracles of the samples.
_MOST_GROUP = 400


def _one_each_sql() -> str:
    places = ", ".join(f"({n}, {sample_positions(n, 1)[0]})" for n in range(1, _MOST_GROUP + 1))
    return f"""WITH points AS ({_points_sql("customers")}), places AS (SELECT * FROM (VALUES {places}) AS v(n, place)),
numbered AS (SELECT building, label, row_number() OVER (PARTITION BY building ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY building) AS n
  FROM points WHERE building IS NOT NULL),
picked AS (SELECT building AS building_id, label AS point_label FROM numbered JOIN places USING (n, place))"""


_add("sample_one_per_building", lambda spark, d: sample_one_per_building(points(spark, d, "customers")), _one_each_sql() + " SELECT building_id, point_label FROM picked")


def _joined_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the written sample, numbered in the order of the folder's files."""
    path = scratch(spark, "sample")
    write_lines(ordered_samples(sample_one_per_building(points(spark, sf_dir, "customers"))), path)
    return numbered_lines(spark, path).select("line", F.col("value").alias("text"))


_add(
    "joined_sample",
    _joined_sample,
    _one_each_sql() + " SELECT row_number() OVER (ORDER BY building_id) AS line, point_label AS text FROM picked",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
