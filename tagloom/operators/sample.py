"""Seeded samples at the positions that numpy's legacy generator gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many positions are permuted whole; beyond, the wanted ones are traced.
WHOLE = 1 << 18
_DRAWS, _TAIL = 1 << 19, 1 << 12
_STRETCH = 1 << 16


def _partners(state: np.random.RandomState, last: int) -> np.ndarray:
    """What positions ``last``, ``last - 1``, ... are swapped with, for as many as the draws of one chunk give.

    A draw is cut to the bits of its position and counts if it is not above it; which position a draw is for depends on
    the draws before it that count, and is found by repeating until nothing changes.
    """
    raw = state.randint(0, 1 << 32, size=min(_DRAWS, last // 4), dtype=np.uint32).astype(np.int64)
    at = last - np.arange(len(raw)) * (last + 1) // (1 << last.bit_length())  # about as many as count on average
    while True:
        mask = at.copy()
        for shift in (1, 2, 4, 8, 16):
            mask |= mask >> shift
        value = raw & mask
        counts = value <= at
        now = last - (np.cumsum(counts) - counts)
        if (now == at).all():
            return value[counts]
        at = now


def _traced(n: int, k: int, seed: int) -> list[int]:
    """The same by going back through the shuffle's swaps; memory is that of one chunk, the tracked places and a state per chunk.

    The shuffle draws for the last position first, so its states are kept at intervals and their draws made again in
    reverse. A place below the next position can only move to that position.
    """
    state, last, kept = np.random.RandomState(seed), n - 1, []
    while last > _TAIL:
        kept.append((state.get_state(), last))
        last -= len(_partners(state, last))
    swaps = []
    for i in range(last, 0, -1):
        mask = (1 << i.bit_length()) - 1
        while (j := int(state.randint(0, 1 << 32, dtype=np.uint32)) & mask) > i:
            pass
        swaps.append((i, j))
    held = {p: p for p in range(k)}  # where the value that ends at a place stands before the swaps gone through
    for i, j in reversed(swaps):
        a, b = held.pop(i, None), held.pop(j, None)
        if a is not None:
            held[j] = a
        if b is not None:
            held[i] = b
    for start, top in reversed(kept):
        state.set_state(start)
        partners = _partners(state, top)[::-1]
        first = top - len(partners) + 1
        for x in np.flatnonzero(np.isin(partners, np.fromiter(held, np.int64)) | (partners >= first)).tolist():
            i, j = first + x, int(partners[x])
            a, b = held.pop(i, None), held.pop(j, None)
            if a is not None:
                held[j] = a
            if b is not None:
                held[i] = b
    return sorted(held, key=held.__getitem__)


def sample_positions(n: int, k: int, seed: int = 42) -> list[int]:
    """The first ``k`` of a seeded permutation of ``n`` positions, at most 2**32."""
    if n > 1 << 32:
        raise ValueError("too many positions")
    k = min(n, k)
    return np.random.RandomState(seed).permutation(n)[:k].tolist() if n <= max(WHOLE, 4 * k) else _traced(n, k, seed)


def positions_column(n, k: int, seed: int = 42):
    """``sample_positions`` as an Arrow function of a column; meant for distinct values of ``n``.

    It is marked so that Spark does not copy it into conditions below the ``distinct``, where it would run for every row.
    """

    @F.pandas_udf("array<bigint>")
    def positions(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda size: sample_positions(int(size), k, seed))

    return positions.asNondeterministic()(n)


def sample_one_per_building(points: DataFrame, seed: int = 42) -> DataFrame:
    """``building_id`` and one ``point_label`` each: that at the seeded position in corpus order (``point_ord``).

    Null buildings are dropped. Rows are counted by building and stretch of the corpus, and only the stretch that holds the
    position is put in order, so a building of a third of all rows costs no more than others.
    """
    missing = {"building_id", "point_label", "point_ord"} - set(points.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    rows = points.where("building_id is not null").select("building_id", "point_label", "point_ord", F.floor(F.col("point_ord") / _STRETCH).alias("stretch"))
    counts = rows.groupBy("building_id", "stretch").agg(F.count("*").alias("n"))
    own = Window.partitionBy("building_id")
    counts = counts.withColumn("of", F.sum("n").over(own)).withColumn("start", F.sum("n").over(own.orderBy("stretch")) - F.col("n"))
    picks = counts.select("of").distinct().withColumn("pick", F.element_at(positions_column(F.col("of"), 1, seed), 1))
    wanted = counts.join(picks, "of").where("pick >= start and pick < start + n").select("building_id", "stretch", (F.col("pick") - F.col("start")).alias("pick"))
    place = Window.partitionBy("building_id", "stretch").orderBy("point_ord")
    numbered = rows.join(wanted, ["building_id", "stretch"]).withColumn("at", F.row_number().over(place) - 1)
    return numbered.where("at = pick").select("building_id", "point_label")


def ordered_samples(samples: DataFrame) -> DataFrame:
    """``point_label`` in order of building, by ranges of buildings; written line by line it is the joined sample."""
    return samples.sort("building_id", "point_label").select("point_label")
