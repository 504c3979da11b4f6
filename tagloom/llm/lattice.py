"""Near-duplicate embeddings by lattice hashing: E8 cells of random projections in several tables.

A table projects a unit vector at random to ``blocks`` times eight dimensions and takes the E8 lattice point nearest to
each eight as its cell. Blocks and the size of cells follow the number of vectors without a step or an end, so that about
``MATES`` vectors that are not alike share a cell at any size; the number of tables follows from that by simulation. Every
vector is stored in its own cell and asks, besides that, the ``PROBES`` neighbouring cells whose points are next nearest.

Vectors close to one another become balls first: of one cell of a coarser table, cut by hash where it is crowded, those
within half the linking angle of their mean. Any two vectors of a ball are linked, so its links are counted, never
written out. Cells hold balls, each once. Two balls that meet are compared by their centres: if the angle and both radii
stay within the linking angle, all their vectors are linked; if the angle less the radii exceeds it, none is; else their
vectors are compared, by cosine in double precision. Equal vectors are one node with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.storage import dropped, staged
from tagloom.llm.words import mixed

LEAST_COSINE = 0.9
PROBES = 8
#: Vectors at random that share a cell, about.
MATES = 10
#: The share of pairs at the least cosine that may meet in no table.
MISSED = 0.002
#: A cell of the grouping table is cut into parts of so many vectors, as a ball is made in one piece of memory.
PART_ROWS = 1500
NODES_A_TASK = 100_000
#: log P(two vectors at random share a cell of one block) = ``_SLOPE`` * scale + ``_OFFSET``, as measured for scales from 1.2 to 3.
_SLOPE, _OFFSET = 3.7, -12.9
_FINEST = 2.0
#: The grouping table's cells are so much wider.
_COARSER = 1.2
_SKETCH_BITS = 128
_MARGIN = 1e-9


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            rows.append(v)
    rows += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(rows)


NEIGHBOURS = _shortest()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(y)
    rest = y - near
    at = np.abs(rest).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    near[rows, at[rows]] += np.where(rest[rows, at[rows]] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The E8 points nearest to rows of eight numbers."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def cells_for(vectors: int) -> tuple[int, float]:
    """Blocks and scale at which a cell holds about ``MATES`` of so many vectors."""
    bits = math.log(max(1.0, vectors / MATES))
    blocks = max(1, math.ceil(bits / -(_SLOPE * _FINEST + _OFFSET)))
    return blocks, (-bits / blocks - _OFFSET) / _SLOPE


@lru_cache(maxsize=32)
def tables_for(blocks: int, scale: float, least: float = LEAST_COSINE, probes: int = PROBES, missed: float = MISSED) -> int:
    """Tables of which at least one finds a pair at the least cosine, but for the share ``missed``; by simulated pairs."""
    draw, hits, tried = np.random.default_rng(9), 0, 0
    while hits < 400 and tried < 400_000:
        u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in draw.standard_normal((2, 2000, 64)))
        z = v - (v * u).sum(axis=1)[:, None] * u
        v = least * u + math.sqrt(1 - least * least) * z / np.linalg.norm(z, axis=1)[:, None]
        table = Tables(64, blocks, scale, 1, probes, seed=int(draw.integers(1 << 31)))
        (own_u, asked_u), (own_v, asked_v) = next(table.cells(u)), next(table.cells(v))
        hits += int(((asked_u == own_v[:, None]).any(axis=1) | (asked_v == own_u[:, None]).any(axis=1)).sum())
        tried += len(u)
    found = min(max(hits, 1) / tried, 1 - 1e-9)
    return max(1, math.ceil(math.log(missed) / math.log1p(-found)))


class Tables:
    """Cells of unit vectors of one dimension."""

    def __init__(self, dimension: int, blocks: int, scale: float, tables: int, probes: int = PROBES, seed: int = 8_240) -> None:
        draw = np.random.default_rng(seed + dimension)
        self.keys = draw.integers(1 << 63, size=(tables, blocks * 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seeds = draw.integers(1 << 62, size=tables)
        self.dimension, self.blocks, self.scale, self.probes = dimension, blocks, scale, probes

    def cells(self, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table the own cells, and the cells asked (own first), as hashes."""
        n = len(unit)
        step = np.rint(2 * NEIGHBOURS).astype(np.int64).view(np.uint64)
        for t, keys in enumerate(self.keys):
            turn = np.random.default_rng(self.seeds[t]).standard_normal((self.dimension, self.blocks * 8)) / self.scale
            y = (unit @ turn).reshape(-1, 8)
            point = decode(y)
            rest = (y - point).reshape(n, self.blocks, 8)
            twice = np.rint(2 * point).astype(np.int64).view(np.uint64).reshape(n, -1)
            own = (twice * keys).sum(axis=1, dtype=np.uint64) + np.uint64(t)
            if not self.probes:
                yield mixed(own), mixed(own[:, None])
                continue
            gain = (rest @ NEIGHBOURS.T).reshape(n, -1)
            best = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
            moves = np.concatenate([(step * k).sum(axis=1, dtype=np.uint64) for k in keys.reshape(self.blocks, 8)])
            yield mixed(own), mixed(np.concatenate([own[:, None], own[:, None] + moves[best]], axis=1))


def balls_of(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the number of its ball (that of its first row), the ball's centre and the angle to it."""
    n, most = len(unit), math.acos(least) / 2 - _MARGIN
    ball, centre, angle = np.arange(n), unit.copy(), np.zeros(n)
    if n == 1:
        return ball, centre, angle
    near = unit @ unit.T >= least
    left = near.sum(axis=1) > 1
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        rows = np.flatnonzero(near[i] & left)
        for _ in range(2):  # the mean of those near, then of those near the mean
            mean = unit[rows].sum(axis=0)
            mean /= np.linalg.norm(mean)
            theta = np.arctan2(np.linalg.norm(unit[rows] - (unit[rows] @ mean)[:, None] * mean, axis=1), unit[rows] @ mean)
            rows, theta = rows[theta <= most], theta[theta <= most]
            if not len(rows):
                break
        left[i] = False
        if len(rows) > 1:
            mean = unit[rows].sum(axis=0)
            mean /= np.linalg.norm(mean)
            theta = np.arctan2(np.linalg.norm(unit[rows] - (unit[rows] @ mean)[:, None] * mean, axis=1), unit[rows] @ mean)
            rows, theta = rows[theta <= most], theta[theta <= most]
        if len(rows) > 1:
            ball[rows], centre[rows], angle[rows], left[rows] = rows[0], mean, theta, False
    return ball, centre, angle


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of rows of unit vectors, exact for small ones too."""
    return 2 * np.arctan2(np.linalg.norm(a - b, axis=1), np.linalg.norm(a + b, axis=1))


def _matrix(units: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(-1, size)


def _sketch(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signs of ``_SKETCH_BITS`` random projections, in two longs."""
    planes = np.random.default_rng(7_919 + unit.shape[1]).standard_normal((unit.shape[1], _SKETCH_BITS))
    words = np.packbits(unit @ planes > 0, axis=1).view(np.int64)
    return words[:, 0].copy(), words[:, 1].copy()


def _units(vectors: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what has no direction."""
    out = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        if x is not None:
            size = np.abs(x).max(initial=0.0)
            x = x / size / np.linalg.norm(x / size) if size and np.isfinite(size) and np.isfinite(x).all() else None
        out.append(x)
    return out


def _table(names: str, kinds: str) -> tuple[str, pa.Schema]:
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    pairs = list(zip(names.split(), kinds.split(), strict=True))
    return ", ".join(f"{n} {k}" for n, k in pairs), pa.schema([(n, arrow[k]) for n, k in pairs])


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A task's rows together; None without any."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _nodes(rows: DataFrame) -> DataFrame:
    """Digest, length and unit vector of each row; no unit for a row that links with nothing."""
    schema, arrow = _table("vec_id d1 d2 size unit", "long long long int binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            out = []
            for key, v, u in zip(batch.column(0).to_pylist(), raw, _units(raw), strict=True):
                if u is None or key is None:
                    out.append((key, 0 if key is None else key, -1, None, None))
                else:
                    data = (np.asarray(v, np.float64) + 0.0).tobytes()
                    out.append((key, *(xxhash.xxh3_64_intdigest(data, s) - (1 << 63) for s in (1, 2)), len(v), u.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return rows.mapInArrow(task, schema)


def _slices(batch: pa.RecordBatch, column: int, rows: int = 2000) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one vector length, few at a time."""
    sizes = batch.column(column).to_numpy()
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for at in range(0, len(own), rows):
            yield int(size), batch.take(pa.array(own[at : at + rows]))


def _grouped(nodes: DataFrame, blocks: int, scale: float) -> DataFrame:
    """``nodes`` with the cell of the grouping table."""
    schema, arrow = _table("node copies size unit home", "long long int binary long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _slices(batch, 2):
                own, _ = next(Tables(size, blocks, scale * _COARSER, 1, 0, seed=77).cells(_matrix(part.column(3), size)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.view(np.int64))], schema=arrow)

    return nodes.select("node", "copies", "size", "unit").mapInArrow(task, schema)


def _members(grouped: DataFrame, least: float, tasks: int) -> DataFrame:
    """Each node with its ball (the least node in it), the angle to the ball's centre, and that centre."""
    schema, arrow = _table("node copies size unit ball angle centre", "long long int binary long double binary")
    crowded = grouped.groupBy("home", "size").agg(F.count("*").alias("k")).where(F.col("k") > PART_ROWS)
    parts = F.coalesce(F.ceil(F.col("k") / PART_ROWS), F.lit(1))
    dealt = grouped.join(crowded, ["home", "size"], "left").withColumn("part", F.pmod(F.xxhash64("node"), parts))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (rows := _whole(batches)) is None:
            return
        home, part, size, node = (rows.column(c).to_numpy() for c in ("home", "part", "size", "node"))
        order = np.lexsort((node, part, size, home))
        starts = _starts(home[order], part[order], size[order])
        for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
            for at in range(s, e, 2 * PART_ROWS):  # parts are by hash, so one may be a little larger
                own = rows.take(pa.array(order[at : min(e, at + 2 * PART_ROWS)])).combine_chunks()
                unit = _matrix(own.column("unit"), int(size[order[s]]))
                ball, centre, angle = balls_of(unit, least)
                key = own.column("node").to_numpy()
                columns = [own.column(c).combine_chunks() for c in ("node", "copies", "size", "unit")]
                columns += [pa.array(key[ball]), pa.array(angle), pa.array([c.tobytes() for c in centre], pa.binary())]
                yield from pa.Table.from_arrays(columns, schema=arrow).sort_by("ball").to_batches()

    wanted = dealt.select("node", "copies", "size", "unit", "home", "part")
    return wanted.repartition(tasks, "home", "part").mapInArrow(task, schema)


def _met(members: DataFrame, blocks: int, scale: float, tables: int, least: float) -> DataFrame:
    """Pairs ``a < b`` of balls of which some vectors meet in a cell and whose sketches do not rule a link out."""
    schema, arrow = _table("cell size ball s1 s2 radius stored", "long int long long long double boolean")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Tables] = {}
        for batch in batches:
            for size, part in _slices(batch, 0):
                if size not in kept:
                    kept.clear()
                    kept[size] = Tables(size, blocks, scale, tables)
                ball, radius = part.column(1).to_numpy(), part.column(3).to_numpy()
                s1, s2 = _sketch(_matrix(part.column(4), size))
                for own, asked in kept[size].cells(_matrix(part.column(2), size)):
                    for cells, stored in ((own[:, None], True), (asked, False)):
                        cell, row = cells.ravel().view(np.int64), np.repeat(np.arange(len(ball)), cells.shape[1])
                        order = np.lexsort((cell, ball[row]))
                        once = order[_starts(cell[order], ball[row][order])]
                        r = row[once]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell[once]), pa.array(np.full(len(r), size, np.int32)), pa.array(ball[r]), pa.array(s1[r]), pa.array(s2[r]),
                             pa.array(radius[r]), pa.array(np.full(len(r), stored))], schema=arrow
                        )

    cells = members.select("size", "ball", "unit", "radius", "centre").mapInArrow(task, schema)
    x, y = (
        cells.where(which).select("cell", "size", *(F.col(c).alias(f"{c}_{s}") for c in ("ball", "s1", "s2", "radius")))
        for s, which in (("x", "stored"), ("y", "not stored"))
    )
    turn = f"least(1D, ({math.acos(least)} + radius_x + radius_y) / {math.pi})"
    apart = "bit_count(s1_x ^ s1_y) + bit_count(s2_x ^ s2_y)"
    possible = F.expr(f"ball_x <> ball_y and {apart} <= {_SKETCH_BITS} * {turn} + 5 * sqrt({_SKETCH_BITS} * {turn} * (1 - {turn})) + 1")
    pairs = x.join(y, ["cell", "size"]).where(possible)
    return pairs.select(F.least("ball_x", "ball_y").alias("a"), F.greatest("ball_x", "ball_y").alias("b")).distinct()


def _compared(met: DataFrame, balls: DataFrame, least: float) -> DataFrame:
    """``a``, ``b`` and ``sure``: all their vectors are linked; or, if not sure, some may be."""
    schema, arrow = _table("a b sure", "long long boolean")
    limit = math.acos(least)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _slices(batch, 2):
                x, y = (_matrix(part.column(c), size) for c in (3, 4))
                radius = part.column(5).to_numpy() + part.column(6).to_numpy()
                single = (part.column(7).to_numpy() == 1) & (part.column(8).to_numpy() == 1)
                theta = _angle(x, y)
                linked = np.where(single, (x * y).sum(axis=1) >= least, theta + radius <= limit - _MARGIN)
                some = ~single & ~linked & (theta - radius <= limit + _MARGIN)
                kept = np.flatnonzero(linked | some)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), part.column(1).take(pa.array(kept)), pa.array(linked[kept])], schema=arrow)

    x, y = (balls.select(F.col("ball").alias(s), F.col("size").alias(f"size_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("centre", "radius", "vectors"))) for s in "ab")
    rows = met.join(x, "a").join(y, "b").select("a", "b", "size_a", "centre_a", "centre_b", "radius_a", "radius_b", "vectors_a", "vectors_b")
    return rows.mapInArrow(task, schema)


def _checked(pairs: DataFrame, members: DataFrame, least: float, tasks: int) -> DataFrame:
    """Vectors of unsure pairs of balls, compared: ``node`` and ``others`` it links to; per pair one row with ``a`` and ``b`` if any do."""
    schema, arrow = _table("node others a b", "long long long long")
    side = members.select("ball", "node", "copies", "size", "unit")
    rows = None
    for own, right in (("a", False), ("b", True)):
        one = pairs.join(side, pairs[own] == side["ball"]).select("a", "b", F.lit(right).alias("right"), "node", "copies", "size", "unit")
        rows = one if rows is None else rows.union(one)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _whole(batches)) is None:
            return
        a, b, right = (got.column(c).to_numpy() for c in ("a", "b", "right"))
        order = np.lexsort((right, b, a))
        starts = _starts(a[order], b[order])
        for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
            own = got.take(pa.array(order[s:e])).combine_chunks()
            unit = _matrix(own.column("unit"), own.column("size")[0].as_py())
            cut = int((~own.column("right").to_numpy()).sum())
            copies, node = own.column("copies").to_numpy(), own.column("node").to_numpy()
            linked = unit[:cut] @ unit[cut:].T >= least
            if linked.any():
                others = np.r_[linked @ copies[cut:], copies[:cut] @ linked]
                keep = np.flatnonzero(others)
                none = pa.nulls(len(keep), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(others[keep].astype(np.int64)), none, none], schema=arrow)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([a[order[s]]]), pa.array([b[order[s]]])], schema=arrow)

    return rows.repartition(tasks, "a", "b").mapInArrow(task, schema)


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Null, empty and zero vectors and vectors with a null or non-finite part link with nothing. Vectors of different
    length do not link. Rows of equal vectors are linked with one another. Rows that repeat an id are vectors of their
    own. A cosine of exactly ``least`` is a link. Extra columns are ignored. An empty table gives no rows.

    Nodes are known by a 64-bit digest of their vector, which two of a billion share with a chance of three in a hundred.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    found = staged(_nodes(rows), "vectors")
    some = found.where("unit is not null")
    nodes = some.groupBy(F.col("d1").alias("node")).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("size").alias("size"), F.first("unit").alias("unit")
    )
    nodes = staged(nodes, "vector-nodes")
    n = nodes.count()
    blocks, scale = cells_for(n)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / NODES_A_TASK))

    homes = staged(_grouped(nodes, blocks, scale), "vector-homes")
    members = staged(_members(homes, least, tasks), "vector-members")
    balls = members.groupBy("ball").agg(
        F.first("size").alias("size"), F.first("centre").alias("centre"), F.max("angle").alias("radius"), F.count("*").alias("vectors"), F.sum("copies").alias("weight")
    )
    balls = staged(balls, "vector-balls")
    large = balls.where("vectors > 1").select("ball", F.col("radius").alias("_radius"))
    placed = members.join(large, "ball", "left").select("size", "ball", "unit", F.coalesce("_radius", F.lit(0.0)).alias("radius"), "centre")
    met = staged(_met(placed, blocks, scale, tables_for(blocks, scale, least), least), "ball-pairs")
    pairs = staged(_compared(met, balls, least), "ball-links")
    checked = staged(_checked(pairs.where("not sure").drop("sure"), members, least, tasks), "ball-checked")

    links = pairs.where("sure").select("a", "b")
    weight = balls.select("ball", "weight")
    by_ball = [links.join(weight, links[x] == weight["ball"]).select(F.col(y).alias("ball"), "weight") for x, y in (("a", "b"), ("b", "a"))]
    by_ball = by_ball[0].union(by_ball[1]).groupBy("ball").agg(F.sum("weight").alias("beside"))
    by_node = checked.where("node is not null").groupBy("node").agg(F.sum("others").alias("others"))
    reach = components(links.union(checked.where("a is not null").select("a", "b"))).select(F.col("node").alias("ball"), "component")

    # A ball's vectors are linked with one another; rows of one vector are linked too.
    own = (
        members.select("node", "ball").join(nodes.select("node", "least_id"), "node").join(weight, "ball").join(by_ball, "ball", "left")
        .join(by_node, "node", "left").join(reach, "ball", "left")
        .select("node", "least_id", F.expr("weight - 1 + coalesce(beside, 0) + coalesce(others, 0)").alias("n_links"), F.coalesce("component", "ball").alias("c"))
    )
    own = staged(own, "vector-result")
    dropped(nodes, homes, members, balls, met, pairs, checked)
    least_of = own.groupBy("c").agg(F.min("least_id").alias("component_id"))
    own = own.join(least_of, "c").select("node", "n_links", "component_id")
    out = found.withColumn("node", F.when(F.col("unit").isNotNull(), F.col("d1"))).select("vec_id", "node").join(own, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
