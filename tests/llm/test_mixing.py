import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm.mixing import mix_sources, mixed_documents, word_count

SCHEMA = "doc_id long, text string, source string, n_chars long, target int, h int"


def corpus(seed=0, sources=("b", "a", None, "É", "z", "Z")):
    draw = np.random.default_rng(seed)
    rows = []
    for s in sources:
        for _ in range(int(draw.integers(1, 60))):
            rows.append((len(rows), " ".join(f"w{x}" for x in draw.integers(0, 99, int(draw.integers(0, 80)))), s))
    hot = sources[0]
    rows += [(len(rows) + i, f"hot text number {i} " * 5, hot) for i in range(300)]
    rows += [(9001, None, "a"), (9002, "", None), (9003, "long " * 30_000, "z"), (9004, "same", "a"), (9004, "same", "a"), (None, "no id", "b"), (9005, "lonely", "tiny")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, s, len(t or ""), 1, 2) for k, t, s in rows], SCHEMA).repartition(4)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else level * weight[s]
        if not over:
            break
        rest -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_word_count(spark):
    texts = [None, "", " a  b\tc\x0bd\n", "x\xa0y z", "\x1c q"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", word_count(F.col("t")).alias("n")).orderBy("i")
    assert [r.n for r in got.collect()] == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = frame(spark, rows)
    mix = mix_sources(df)
    taken = mix.taken.collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    assert Counter((r.doc_id, r.size) for r in taken) == Counter((k, size(t)) for k, t, _ in rows)
    got = defaultdict(int)
    for r in taken:
        s = None if r.source_key == "b" else r.source_key[1:]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: (str(r.doc_id), r.h, r.taken)
    assert sorted(map(key, taken)) == sorted(map(key, mix_sources(df.repartition(7)).taken.collect()))


def test_schedule_is_even(spark):
    mix = mix_sources(frame(spark, corpus()))
    slots = sorted((r.slot, r.source_key) for r in mix.schedule.collect())
    shares = Counter(s for _, s in slots)
    half = Counter(s for k, s in slots if k < 512)
    assert all(abs(half[s] - n / 2) <= 2 for s, n in shares.items())  # any stretch holds the sources near their weights
    ranks = defaultdict(list)
    for r in sorted(mix.schedule.collect(), key=lambda r: r.slot):
        ranks[r.source_key].append(r.r)
    assert all(v == list(range(len(v))) for v in ranks.values())
    pieces = mix.pieces.groupBy("slot", "source_key").agg(F.sum("words").alias("n")).collect()
    by_source = defaultdict(list)
    for p in pieces:
        by_source[p.source_key].append(p.n)
    assert all(max(v) - sorted(v)[min(1, len(v) - 1)] <= 1 for v in by_source.values())  # equal blocks but for the last


def schedule_of(sources, block_words=1024):
    """Slots in order of rank by source, and the words of a block: ``sources`` maps a source to its size."""
    want = targets(sources)
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    bits = max(10, int(np.ceil(np.log2(max(1.0, 1.5 * sum(sources.values()) / block_words)))))
    ends = np.cumsum([want[s] for s in order])
    edges = np.ceil(ends / ends[-1] * 2**bits)
    slots = defaultdict(list)
    for k in range(2**bits):
        point = int(bin(k)[2:].zfill(bits)[::-1], 2)
        slots[order[int(np.searchsorted(edges, point, side="right"))]].append(k)
    return slots, {s: -(-round(want[s]) // len(slots[s])) for s in order if slots[s]}


def test_results_follow_the_schedule(spark):
    rows = [r for r in corpus(2, ("a", "b", "c", "d")) if r[2] in list("abcd") and r[0] is not None and r[0] != 9004]
    mix = mix_sources(frame(spark, rows))
    taken = mix.taken.collect()
    sizes = Counter()
    for r in taken:
        sizes[r.source_key[1:]] += r.size
    slots, block = schedule_of(sizes)
    for s in sizes:
        at = 0
        for r in sorted((r for r in taken if r.source_key[1:] == s), key=lambda r: (r.h, r.doc_id, r.size)):
            for p in r.passes:
                assert p.slot == slots[s][(p.turn * sizes[s] + at) // block[s]]
            assert r.first_slot == min((p.slot for p in r.passes), default=None) and r.taken == sum(p.words for p in r.passes)
            at += r.size
    # documents come out in the order of their slots
    kept = {(r.doc_id, p.turn): p.slot for r in taken for p in r.passes}
    for part in mixed_documents(frame(spark, rows)).select("doc_id").rdd.glom().collect():
        seen, last = Counter(), -1
        for (key,) in part:
            slot = kept[key, seen[key]]
            assert slot >= last
            seen[key] += 1
            last = slot


def test_mixed_documents(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    taken = Counter()
    for r in mix_sources(df).taken.collect():
        taken[None if r.source_key == "b" else r.source_key[1:]] += r.taken
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_empty(spark):
    df = frame(spark, corpus()).limit(0)
    assert mix_sources(df).taken.count() == 0 and mixed_documents(df).count() == 0
    nothing = frame(spark, [(1, None, None), (2, "", "a")])
    assert [r.taken for r in mix_sources(nothing).taken.collect()] == [0, 0]


def test_no_python_in_the_plan(spark):
    plan = mix_sources(frame(spark, corpus())).taken._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("most", [1, 3])
def test_as_many_passes_as_most_allows(spark, most):
    rows = [(i, f"a b c d {i}", "large") for i in range(200)] + [(1000 + i, f"x y z {i}", "small") for i in range(10)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    weights, share = (1, 4), 0.75 if most == 1 else 1.0
    want = targets(sizes, weights * 2, share, most)
    taken = mix_sources(frame(spark, rows), weights=weights, share=share, most=most).taken.collect()
    got = Counter()
    for r in taken:
        assert 0 <= r.taken <= most * r.size
        got[r.source_key[1:]] += r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes) and got["small"] == most * sizes["small"]
