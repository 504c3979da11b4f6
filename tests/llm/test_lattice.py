import numpy as np
import pytest

from tagloom.llm.lattice import NEIGHBOURS, Tables, balls_of, cells_for, decode, near_duplicates, tables_for

DRAW = np.random.default_rng(11)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def at_cosine(u, cosine):
    z = DRAW.standard_normal(u.shape)
    z = unit(z - (z * u).sum(axis=1, keepdims=True) * u)
    return cosine * u + np.sqrt(1 - cosine**2) * z


def test_decode_gives_the_nearest_point():
    y = DRAW.standard_normal((500, 8)) * 3
    p = decode(y)
    own = ((y - p) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9  # the covering radius
    assert (own <= ((y[:, None] - p[:, None] - NEIGHBOURS) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()
    assert len(NEIGHBOURS) == 240 and np.allclose((NEIGHBOURS**2).sum(axis=1), 2)
    assert np.allclose(decode(decode(y)), decode(y))


@pytest.mark.parametrize("vectors", [10, 500, 10_000, 50_000, 10_000_000])
@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_recall(vectors, cosine):
    u = unit(DRAW.standard_normal((1500, 64)))
    v = at_cosine(u, cosine)
    met = np.zeros(len(u), bool)
    blocks, scale = cells_for(vectors)
    tables = Tables(64, blocks, scale, tables_for(blocks, scale))
    for (own_u, asked_u), (own_v, asked_v) in zip(tables.cells(u), tables.cells(v), strict=True):
        met |= (asked_u == own_v[:, None]).any(axis=1) | (asked_v == own_u[:, None]).any(axis=1)
    assert met.mean() >= 0.99


def test_cells_shrink_with_the_number_of_vectors():
    for vectors in (100, 3000, 10**5, 10**8, 10**12):
        for more in (vectors, 5 * vectors):
            blocks, scale = cells_for(more)
            assert abs(blocks * (3.7 * scale - 12.9) + np.log(more / 10)) < 1e-6


def test_balls_hold_linked_vectors_only():
    base = unit(DRAW.standard_normal((30, 16)))
    u = np.concatenate([base, *(at_cosine(base[:12], c) for c in (0.99, 0.97, 0.93, 0.999, 0.98, 0.98)), base[:1]])
    ball, centre, angle = balls_of(u, 0.9)
    assert np.allclose(np.cos(angle), (u * centre).sum(axis=1)) and len(set(ball)) < len(u)
    for b in set(ball):
        rows = u[ball == b]
        assert (rows @ rows.T >= 0.9).all()
    assert (ball[ball] == ball).all()


def brute(vectors):
    ok = [i for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    near = {i: [] for i in range(len(vectors))}
    for i in ok:
        for j in ok:
            if i != j and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    near[i].append(j)
    comp = {}
    for start in range(len(vectors)):
        waiting = [start]
        while waiting:
            x = waiting.pop()
            if x not in comp:
                comp[x] = start
                waiting += near[x]
    return [(i, len(near[i]), comp[i], comp[i] == i) for i in range(len(vectors))]


def test_against_brute_force(spark):
    base = unit(DRAW.standard_normal((40, 24)))
    rows = [*base.tolist(), *at_cosine(base[:20], 0.96).tolist(), *at_cosine(base[:10], 0.93).tolist(), *at_cosine(base[:10], 0.8).tolist()]
    rows += [rows[0]] * 15 + [[2 * c for c in rows[1]], [-c for c in rows[2]]]
    rows += [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 0.0], [1.0, 0.1], [1e-30] * 24, [1e30] * 24]
    rows = [rows[i] for i in DRAW.permutation(len(rows))]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_groups_of_near_copies(spark):
    """Groups whose copies stray so far that some of their pairs are linked and some are not."""
    base = unit(DRAW.standard_normal((6, 32)))
    rows = np.concatenate([base, *(at_cosine(np.repeat(base[i : i + 1], 60, axis=0), c) for i, c in enumerate((0.999, 0.98, 0.96, 0.95, 0.94, 0.92)))])
    rows = [*rows.tolist(), *rows[6:40].tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
    want = brute(rows)
    assert [(k, *rest) for k, _, *rest in got] == [(k, *rest) for k, _, *rest in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.01], 5), (3, [0.01, 1.0], 5), (None, [1.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 0, None)], key=str)
