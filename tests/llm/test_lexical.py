import math
import re
from collections import Counter

import pytest

from tagloom.llm import lexical
from tagloom.llm.lexical import search, terms_of

DOCS = [
    (1, "The cat sat on the mat."), (2, "the cat, the CAT; the Cat"), (3, None), (4, ""), (5, "?! --"), (6, "É é ñandú the"), (7, "dog-cat dog"),
    (8, "the cat sat on the mat."), (8, "the cat sat on the mat."), (None, "the cat sat on the mat."), (9, "word " * 3000 + "cat"), (10, "a1 b2 the_cat"),
]
ITEMS = [(0, "the cat"), (1, "É cat"), (2, "nothing here"), (3, None), (4, "mat sat on THE cat cat"), (0, "dog"), (None, "word b2")]


def brute(docs, items, top):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(key, pattern.findall((text or "").translate(lowered))) for key, text in docs]
    terms = [(key, Counter(t), len(t)) for key, t in terms if t]
    total, length = len(terms), sum(n for *_, n in terms)
    out = []
    for item, text in items:
        scores = []
        for key, tf, n in terms:
            m, s = 50 + (50 * n * total) // length, 0
            for t in set(pattern.findall((text or "").translate(lowered))):
                if t in tf:
                    df = sum(t in x for _, x, _ in terms)
                    s += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores)[:top])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] or 0))


@pytest.mark.parametrize(("top", "query_bytes"), [(50, 1 << 24), (3, 1 << 24), (3, 12), (1, 1 << 24)])
def test_against_brute_force(spark, top, query_bytes):
    docs = spark.createDataFrame([(k, t, 1, 1) for k, t in DOCS], "doc_id long, text string, score int, rank int").repartition(3)
    items = spark.createDataFrame([(k, t, 1) for k, t in ITEMS], "item_id long, text string, doc_id int")
    found = search(docs, items, top=top, query_bytes=query_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(map(tuple, found.collect())) == ordered(brute(DOCS, ITEMS, top))


def test_many_ties_and_small_shards(spark, monkeypatch):
    docs = [(i * 7 % 1009, "alpha beta" if i % 3 else "alpha gamma gamma") for i in range(1009)]
    items = [(1, "alpha beta"), (2, "gamma")]
    monkeypatch.setattr(lexical, "_PIECE", 8)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = search(frame, spark.createDataFrame(items, "item_id long, text string"), top=20)
    assert ordered(map(tuple, found.collect())) == ordered(brute(docs, items, 20))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert search(docs.where("text is null"), items).count() == 0


def test_terms():
    assert terms_of("Aé_B\x7f1 ½") == ["aé".encode(), b"b", b"1", "½".encode()]
