from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tagloom.llm import ngram_join
from tagloom.llm.components import components
from tagloom.llm.ngram_join import CountTree, counts_of, jaccard_components, linked, tree_pairs, without_near_copies
from tagloom.llm.words import shingle_hashes, words_of


def shingles(text):
    w = words_of(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    parent = {k: k for k, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        i = len(x & y)
        if i and 100 * i >= 80 * (len(x) + len(y) - i):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return sorted((k, len(s), root(k)) for k, s in sets)


def corpus(seed=0, groups=12):
    draw = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in draw.integers(0, 3000, n)]
    passage = word(60)
    rows = []
    for g in range(groups):
        base = word(int(draw.integers(6, 200)))
        for c in range(int(draw.integers(1, 14))):
            copy = list(base)
            for _ in range(c % 6):
                copy[int(draw.integers(len(copy)))] = f"e{draw.integers(10**6)}"
            rows.append(" ".join(copy))
    rows += [" ".join(word(int(draw.integers(5, 150))) + passage) for _ in range(60)]  # a shared passage, not near copies
    chain = word(50)
    for i in range(30):  # each near the one before, the ends far apart
        rows.append(" ".join(chain[i:] + chain[:i]) + f" t{i}")
    rows += ["", None, "   ", "one two", "One  TWO", "one two three four five", "a b c d e", "a b c d e f"] + [rows[3]] * 40
    order = draw.permutation(len(rows))
    return [(int(k), rows[i]) for k, i in enumerate(order)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, token string, n int").repartition(6)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())


@pytest.mark.parametrize("common", [False, True])
def test_against_brute_force(spark, monkeypatch, common):
    if common:  # shingles that several documents have count as common, and blocks are cut into cells
        monkeypatch.setattr(ngram_join, "COMMON_LEAST", 3)
        monkeypatch.setattr(ngram_join, "CELL_ROWS", 7)
    rows = corpus()
    assert result(frame(spark, rows)) == brute(rows)


def test_by_shuffle_where_broadcast_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = corpus(3, 6)
    assert result(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("bound", [0, 1000])
def test_an_id_with_a_copy_and_another_text(spark, monkeypatch, bound):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", bound)
    near = [f"w{i}" for i in range(60)]
    rows = [(7, "a b c d e f g"), (7, " ".join(near)), (2, "a b c d e f g"), (9, " ".join(near[:-1]))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {(7, 3, 2), (7, 56, 7), (2, 3, 2), (9, 55, 7)}


def test_hub_whose_id_is_not_the_least(spark):
    base = [f"w{i}" for i in range(100)]
    copies = []
    for i in range(12):
        c = list(base)
        c[5 + 7 * i] = f"x{i}"
        c[50 - 3 * i] = f"y{i}"
        copies.append(" ".join(c))
    rows = list(enumerate([*copies, " ".join(base)]))
    assert result(frame(spark, rows)) == brute(rows)


def test_edges_of_the_threshold(spark):
    base = [f"w{i}" for i in range(84)]  # 80 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"z{i}" for i in range(20)])), (3, " ".join(base + [f"q{i}" for i in range(21)]))]
    assert [c for _, _, c in result(frame(spark, rows))] == [1, 1, 3]


def test_defined_cases(spark):
    assert result(frame(spark, [(1, "a b")]).limit(0)) == []
    rows = [(7, "a b c d e f g"), (7, "x y z"), (2, "x y z"), (None, "x y z"), (9, None)]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {(7, 7), (7, 2), (2, 2), (None, None), (9, 9)}
    assert sorted(str(r.doc_id) for r in without_near_copies(frame(spark, rows)).collect()) == ['2', '7', '9', 'None']
    kept = without_near_copies(frame(spark, corpus(4, 5)))
    want = {k for k, _, c in brute(corpus(4, 5)) if k == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == ["doc_id", "text", "token", "n"]


def tree_of(sets):
    points = [counts_of(s) for s in sets]
    return CountTree(np.stack([c for c, _ in points]), np.array([e for _, e in points]), np.array([len(s) for s in sets]), np.arange(len(sets)))


def test_tree_of_very_large_sets():
    """Counts beyond a byte rule no linked pair out."""
    draw = np.random.default_rng(5)
    base = [draw.integers(0, 1 << 63, 200_000, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([b[: 200_000 - cut], draw.integers(0, 1 << 63, cut, dtype=np.uint64)])) for b in base for cut in (0, 9000)]
    tree = tree_of(sets)
    assert (tree.excess > 0).all()
    found = {tuple(sorted(p)) for x, y in tree_pairs(tree, tree) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert {(0, 1), (2, 3), (4, 5)} <= found


def test_spanning_pairs_connect_near_copies():
    draw = np.random.default_rng(6)
    sets = []
    for _ in range(4):
        base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[draw.permutation(300)[:290]], draw.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(100)]
    x, y = tree_of(sets).spanning()
    assert len(x) < len(sets)
    assert sum(i // 100 == j // 100 for i, j in zip(x.tolist(), y.tolist(), strict=True)) > 300


def test_tree_leaves_no_linked_pair_out():
    draw = np.random.default_rng(2)
    base = [draw.integers(0, 1 << 63, 80, dtype=np.uint64) for _ in range(12)]
    sets = [np.unique(np.concatenate([draw.choice(b, int(draw.integers(60, 81)), replace=False), draw.integers(0, 1 << 63, 5, dtype=np.uint64)])) for b in base for _ in range(20)]
    tree = tree_of(sets)
    found = Counter()
    for x, y in tree_pairs(tree, tree):
        found.update(tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True))
    assert max(found.values()) == 1
    for i, j in combinations(range(len(sets)), 2):
        if linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
            assert (i, j) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 4


def test_components(spark):
    draw = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 260)] + [(int(a), int(b)) for a, b in draw.integers(300, 400, (70, 2))]
    links += links[:5] + [(7, 7)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        if start in want:
            continue
        waiting = [start]
        while waiting:
            x = waiting.pop()
            if x not in want:
                want[x] = start
                waiting += near[x]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in want.items() if k != 7} == {k: v for k, v in got.items() if k != 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_that_repeat_an_id_are_documents_of_their_own(spark):
    far, copy = "a b c d e f g", " ".join(f"w{i}" for i in range(100))
    near = copy + " z"
    rows = [(3, near), (7, far), (7, copy), (7, far), (8, "h i j k l m"), (8, "n o p q r s"), (9, "n o p q r s"), (10, None), (10, "t u v w x y"), (None, far), (None, far)]
    kept = without_near_copies(frame(spark, rows))
    want = [(3, near), (7, far), (8, "h i j k l m"), (8, "n o p q r s"), (10, None), (10, "t u v w x y"), (None, far), (None, far)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want) and kept.columns == ["doc_id", "text", "token", "n"]
    both = [(5, near), (5, copy), (6, copy)]  # near copies under one id: one of them stays
    first = {tuple(r) for r in without_near_copies(frame(spark, both)).collect()}
    assert len(first) == 1 and first == {tuple(r) for r in without_near_copies(frame(spark, both[::-1])).collect()}


def test_components_of_texts_that_share_an_id(spark):
    """Each text has the least id of its own component, whichever of its ids is less."""
    words = [f"w{i}" for i in range(100)]
    a, near_a, b = " ".join(words), " ".join([*words, "z"]), "m n o p q r s"
    for x, y in ((7, 9), (9, 7)):
        rows = [(3, near_a), (x, a), (x, b), (y, b), (x, a), (5, None), (5, "h i j k l"), (None, b), (11, "one two")]
        found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect())
        want = [(3, 97, 3), (x, 96, 3), (x, 3, 7), (y, 3, 7), (x, 96, 3), (5, 0, 5), (5, 1, 5), (None, 3, None), (11, 1, 11)]
        assert found == Counter(want), (x, y)


def test_pairs_beside_a_large_cluster_grow_with_its_size(spark, monkeypatch):
    """What did not meet the cluster's middle meets its nearest point, in one of the blocks that both share."""
    made = []
    real = ngram_join._tree_pairs

    def counted(*args):
        found = real(*args)
        if args[-1] not in (True, "spanning"):
            made.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_tree_pairs", counted)
    draw = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(300):
        copy = list(base)
        for at in draw.choice(300, int(draw.integers(1, 4)) if k % 10 else 5, replace=False):
            copy[at] = f"e{draw.integers(10**9)}"
        rows.append((k, " ".join(copy)))
    assert result(frame(spark, rows)) == brute(rows)
    assert sum(made) <= 2 * len(rows)
