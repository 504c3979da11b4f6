import random
import re

import duckdb
import pytest

from tagloom.llm.licenses import BASE, NOTICES, TEMPLATES, Template, license_spans, oracle, scan_licenses

MIT = next(t.text for t in NOTICES if t.text.startswith("Permission is hereby"))
APACHE = next(t.text for t in NOTICES if t.text.startswith("Licensed under the [Apache] License, Version [2].0 (")).replace("[", "").replace("]", "")
TEXTS = [
    None, "", "...", "no notice", "All rights reserved. all RIGHTS\nreserved", "CC-BY 4.0", "cc by", "xcc by", "cc byé", "the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License, version 2",
    MIT, MIT.replace("free of charge", "free of any kind of charge").replace("without restriction", "with no restriction"), MIT[:150], APACHE, "x " + APACHE + " y " + APACHE,
    "Kelvin aİ cc by cc_by", "all rights reserved " * 300, "Licensed under CC BY-NC 4.0.", "licensed under cc by nc 3 0", "Released under the MIT License.",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, label string, score double")


def by_sql(docs):
    con = duckdb.connect()
    con.register("given", docs.select("doc_id", "text").toArrow())
    con.execute("CREATE TABLE documents AS SELECT doc_id, text FROM given")
    return con.sql(oracle())


def same(docs):
    found, want = scan_licenses(docs), by_sql(docs)
    assert found.columns == want.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], r[5:])
    rows = sorted(map(tuple, found.collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)
    return rows


def test_cases(spark):
    rows = {r[0]: r for r in same(frame(spark, TEXTS).repartition(3))}
    labels = [rows[i][6] for i in range(len(TEXTS))]
    assert labels == [
        "", "", "", "", "reserved", "cc-by", "cc-by", "", "", "gpl,gpl-3.0", "gpl,gpl-3.0", "gpl,gpl-2.0", "mit", "mit", "", "apache-2.0", "apache-2.0", "cc-by", "reserved",
        "cc-by,cc-by-nc-4.0", "cc-by", "mit",
    ]
    assert rows[0] == rows[0][:1] + (0, 0, None, None, "", "", 0.0) and rows[4][2:5] == (2, 0, 3) and rows[18][1:5] == (900, 300, 0, 897)
    assert rows[12][7] == 1 and 0.7 <= rows[13][7] < 1


def test_base_places_against_search(spark):
    draw = random.Random(5)
    words = ["cc", "by", "General", "public", "license", "ALL", "rights", "reserved", "x", "ü"]
    texts = [draw.choice(["", " "]) + draw.choice([" ", "-", "\n"]).join(draw.choices(words, k=draw.randrange(60))) for _ in range(300)]
    rows = {r[0]: r for r in same(frame(spark, texts))}
    for i, text in enumerate(texts):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(p, t.label) for t in BASE for p in range(len(own)) if own[p : p + len(t.words)] == t.words]
        at = [p for p, _ in places]
        want = (len(own), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert rows[i][1:6] == want


def test_spans_of_neighbouring_diagonals(spark):
    own = (Template("long", " ".join(f"w{i}" for i in range(60))),)
    body = [f"w{i}" for i in range(60)]
    broken = ["a", "b", *body[:20], "new", "words", *body[20:40], *body[43:], "z"]
    docs = frame(spark, [" ".join(broken), " ".join([*body[:20], *(["gap"] * 30), *body[20:]]), " ".join(body[:30]), " ".join(body + body)])
    found = {(r.doc_id, r.start, r.end): r.score for r in license_spans(docs, templates=own).collect()}
    assert found == {(0, 2, 61): 57 / 60, (3, 0, 60): 1.0, (3, 60, 120): 1.0}
    assert {r.doc_id for r in license_spans(docs, templates=own, covered=0.5).collect()} == {0, 1, 2, 3}


def test_repeated_rows_shared_ids_and_empty_tables(spark):
    rows = [(1, "cc by"), (1, "cc by"), (1, "all rights reserved"), (1, None), (None, "cc by"), (None, ""), (2, "cc by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[5] for r in same(docs)].count("cc-by") == 4
    assert same(docs.limit(0)) == []
    assert license_spans(docs.limit(0)).count() == 0


def test_no_python_worker(spark):
    plan = scan_licenses(frame(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("t", TEMPLATES, ids=range(len(TEMPLATES)))
def test_marked_words(t):
    assert [t.words[i] for i in t.marked] == [w.lower() for w in re.findall(r"\[(\w+)\]", t.text)]
