"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import langid, licenses, quality, toxicity
from tagloom.llm.alignment import align_documents
from tagloom.llm.html_layout import extract_pages
from tagloom.llm.lattice import near_duplicates
from tagloom.llm.lexical import search
from tagloom.llm.minhash import fingerprint_documents
from tagloom.llm.mixing import mix_sources
from tagloom.llm.ngram_join import jaccard_components
from tagloom.llm.packing import pack_documents
from tagloom.llm.secrets import find_secrets
from tagloom.llm.textlinear import fold, labels_without

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, held: int) -> Column:
    """Whether the id's fold is the one that nothing is learnt from; a row without an id is in none."""
    return F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels_without(labels, "toxic", 4, 2)))
    return scored.withColumn("held_out", held_out(4, 2))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.where(~held_out(3, 1) & F.col("doc_id").isNotNull())))
    return found.withColumn("held_out", held_out(3, 1))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot", F.col("passes.slot").alias("slots"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = quality.rate(docs, quality.train(docs, labels_without(labels, "quality", 4, 2)))
    return rated.withColumn("held_out", held_out(4, 2))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), *ALIGNED)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprints, op2_secrets, op3_ngram_join, op4_toxicity, op5_language, op6_lattice, op7_packing, op8_mixing, op9_html, op10_quality, op11_licenses, op12_alignment, op13_lexical]
    return {f.__name__: f for f in found}


_REACHED = """reached(k, c) AS (SELECT k, k FROM nodes UNION SELECT r.k, l.b FROM reached r JOIN links l ON r.c = l.a),
component AS (SELECT k, min(c) AS component_id FROM reached GROUP BY k)"""

#: The exact operators; the others hash, learn or tokenize, and are held against brute force in tests.
ORACLES = {
    "op3_ngram_join": f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
nodes AS (SELECT doc_id AS k, len(s) AS n FROM sets),
shingles AS (SELECT doc_id AS k, unnest(s) AS t FROM sets),
shared AS (SELECT x.k AS a, y.k AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.t = y.t AND x.k <> y.k GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN nodes x ON x.k = a JOIN nodes y ON y.k = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
{_REACHED}
SELECT k AS doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM nodes JOIN component USING (k)""",
    "op6_lattice": f"""WITH RECURSIVE vectors AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nodes AS (SELECT k FROM vectors),
sized AS (SELECT k, e, sqrt(list_dot_product(e, e)) AS size FROM vectors),
links AS (SELECT x.k AS a, y.k AS b FROM sized x JOIN sized y ON x.k <> y.k AND x.size > 0 AND y.size > 0
  WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.9),
{_REACHED}
SELECT k AS vec_id, CAST((SELECT count(*) FROM links WHERE a = k) AS BIGINT) AS n_links, component_id, k = component_id AS kept
FROM nodes JOIN component USING (k)""",
    "op11_licenses": licenses.oracle(),
    "op13_lexical": """WITH items AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
own AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM rows),
counts AS (SELECT r, t, count(*) AS tf FROM own GROUP BY ALL),
sized AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY t, docs),
wanted AS (SELECT DISTINCT q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM items),
impacts AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS impact
  FROM counts JOIN weights USING (t) JOIN sized USING (r), corpus),
scores AS (SELECT q, r, CAST(sum(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (t) GROUP BY ALL HAVING sum(impact) > 0),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN rows USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 50""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
