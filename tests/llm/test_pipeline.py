"""Each stage of the pipeline against brute force over the small tables, and the subpackage's queries against their SQL."""

import re
from array import array
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tagloom.llm import queries as llm
from tagloom.llm.secrets import find_secrets
from tagloom.llm.textlinear import labels_without
from tagloom.llm.toxicity import train
from tagloom.llm.words import words_of

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given, and what it returned."""
    at, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    planted = [f"Dokument {i} sagt password = hunter{i}{i}x und mehr, token:abc{i}defg! AKIAABCDEFGHIJKLMNO{i}" for i in range(5)]
    more = spark.createDataFrame([(10**6 + i, t, "de", "web", len(t)) for i, t in enumerate(planted)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.select(*(more[f.name].cast(f.dataType) for f in docs.schema)))
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, DIR).write.parquet(f"{at}/{i}")
        after = spark.read.parquet(f"{at}/{i}")
        out[name] = docs, after
        docs = after
    return out


def test_columns_stay(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near copies", "secrets", "mixing", "packing"]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scorer = train(before, labels_without(llm.table(spark, DIR, "labels"), "toxic", 4, 2)).scorer()
    want = Counter(r for r in before.collect() if scorer.score(r.text) < 0.3)
    assert Counter(after.collect()) == want and 0 < sum(want.values()) < before.count()


def test_near_copies(stages):
    before, after = stages["near copies"]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        w = words_of(r.text)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    near, gone = defaultdict(list), set()
    for i, x in enumerate(sets):
        for j in range(i):
            k = len(x & sets[j])
            if k and 100 * k >= 80 * (len(x) + len(sets[j]) - k):
                near[i].append(j)
                near[j].append(i)
    for i in range(len(rows)):
        waiting, met = [i], {i}
        while waiting:
            for j in near[waiting.pop()]:
                if j not in met:
                    met.add(j)
                    waiting.append(j)
        if min(met) < i:
            gone.add(rows[i].doc_id)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rows} - gone and gone


def test_secrets(stages):
    before, after = stages["secrets"]
    spans = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in find_secrets(before).collect()}
    want = {}
    for r in before.collect():
        text, at, out = r.text or "", 0, ""
        for s, e in spans[r.doc_id]:
            if s >= at:
                out += text[at:s] + "[secret]"
            at = max(at, e)
        want[r.doc_id] = out + text[at:]
    assert {r.doc_id: r.text or "" for r in after.collect()} == want and any("[secret]" in t for t in want.values())


def test_mixing(stages):
    before, after = stages["mixing"]
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    own, sources = {r.doc_id: r for r in before.collect()}, Counter()
    for r in own.values():
        sources[r.source] += size(r.text)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, (s or "").encode())))}
    rest, open_, want = 1.5 * sum(sources.values()), set(sources), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sources[s]}
        want |= {s: 2 * sources[s] if over else level * weight[s] for s in over or open_}
        if not over:
            break
        rest -= sum(want[s] for s in over)
        open_ -= over
    got, copies = Counter(), Counter()
    for r in after.collect():
        got[r.source] += size(r.text)
        copies[r.doc_id] += 1
        assert re.findall("[^\x20\x09-\x0d]+", own[r.doc_id].text)[: size(r.text)] == re.findall("[^\x20\x09-\x0d]+", r.text)
        assert r.n_chars == len(r.text) and r.lang == own[r.doc_id].lang
    assert max(copies.values()) <= 2 and all(abs(got[s] - want[s]) <= 1 for s in sources)


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    t = Tokenizer.from_file(llm.TOKENIZER)
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before.collect())
    rows, tokens = after.collect(), Counter()
    for r in rows:
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert tokens == Counter({k: n * k[1] for k, n in want.items()})
    rooms = defaultdict(list)
    for r in rows:
        rooms[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for pieces in rooms.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == pieces[0][2] <= 4096
    assert array("I", [2]).itemsize == 4


def test_run_gives_what_the_stages_give(spark, stages):
    got, want = corpus_pipeline.run(spark, DIR), stages["packing"][1]
    assert got.columns == want.columns
    ids = lambda df: {r.doc_id for r in df.collect() if r.doc_id < 10**6}
    assert ids(got) == ids(want)
    assert Counter(got.collect()) == Counter(corpus_pipeline.run(spark, DIR).collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, name):
    """Nulls in all columns, empty and blank texts, ties, repeated rows, clashing names, an empty table."""
    rows = [(1, "tie tie tie tie tie x", None, "s", 1), (1, "tie tie tie tie tie x", None, "s", 1), (2, None, "en", None, None), (3, "", None, "s", 0), (4, " \n ", None, "s", 3)]
    rows += [(None, "no id at all here", None, "s", 17), (5, "word " * 20_000, "en", "t", 100_000), (6, "token=abcdef1", "en", "t", 13)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for extra in ("score", "taken", "h", "row", "k", "t"):
        docs = docs.withColumn(extra, docs.doc_id * 2)
    out = STAGES[name](spark, docs, DIR)
    if name != "packing":
        assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in out.collect())
    want = {"toxicity": Counter({1: 2, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 6: 1}), "near copies": Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 6: 1})}
    want["secrets"] = want["toxicity"]
    if name in want:
        assert kept == want[name]
    assert STAGES[name](spark, docs.limit(0), DIR).count() == 0


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_queries(spark, name):
    df = llm.queries()[name](spark, DIR)
    found = df.collect()
    assert found and len(set(df.columns)) == len(df.columns)
    if name in llm.oracle_sql():
        con = duckdb.connect()
        for f in Path(DIR).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        result = con.execute(llm.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert Counter(tuple(r[c] for c in sorted(columns)) for r in found) == Counter(tuple(v for _, v in sorted(zip(columns, row, strict=True))) for row in result.fetchall())
