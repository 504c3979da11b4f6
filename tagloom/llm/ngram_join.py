"""Exact join of documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more, as components.

Points: shingles are hashed into ``GROUPS`` groups, and a document is the vector of its counts by group. Two documents
share at most the sum over groups of the smaller count; where that is below the overlap they would need, no set is
looked at. Points that share a block are held in an R-tree (boxes: greatest counts, range of sizes, cluster if one), and
every pair whose sets are compared comes from such a tree.

Blocks make the join distributed and lose nothing: under one fixed order of all shingles, linked sets share one of their
first ``n - ceil(0.8 n) + 1`` shingles. The order is by hash, but shingles that very many documents share come last, so
a passage that is common does not make a block. Those are counted over all documents. A block is cut where its sizes
leave a gap that no linked pair spans, and blocks of the same documents are one block.

Work does not grow with the square of a group of copies. Equal sets are one node. In rounds, every node takes part in the
tree of one of its blocks, and the tree proposes as many pairs as it has points: in each leaf the point nearest to the
leaf's mean with the others, in each inner node the two of its halves. What is linked becomes a cluster, and rounds go on,
over blocks that hold several clusters, while they find much. Then the trees of all blocks that still hold several
clusters are joined with themselves by the bound, but for nodes of one cluster: first for the nearest pair of each two
clusters, so that what stands beside a large cluster meets one of its points and not all of them, then for all that
still could connect two clusters, so the components are exact. A pair that shares many blocks is proposed by one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.storage import dropped, staged
from tagloom.llm.words import mixed, shingle_hashes

GROUPS = 512
#: A shingle is common if so many documents have it, counted over stretches that it is in at least three times; of more
#: than ``COMMON_MOST`` the most frequent (8 bytes each). Which are does not change the result, only the work.
COMMON_LEAST, COMMON_MOST = 32, 1_000_000
_CHUNK = 3_000_000
#: Up to so many ids (8 bytes each) are broadcast; above, tables are joined by shuffle.
BROADCAST_IDS = 1_000_000
ROWS_A_TASK = 2_000_000
CELL_ROWS = 50_000
SALTS = 64
LEAF = 32
#: Rounds go on while the links that one finds are at least such a share of the documents that took part.
FRUITFUL = 0.05
_PARTNERS = 1000
#: Orders of blocks, each by the name's bits turned by a constant; a document knows its first open block in each.
_HOMES = np.array([i * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(1, 9)], np.uint64).view(np.int64)


def linked(overlap: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """100 * intersection >= 80 * union."""
    return 180 * overlap >= 80 * (a + b)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def counts_of(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The point: shingles by group (bits that do not order the hashes), in a byte each, and the sum of what goes beyond.

    Smaller counts and the smaller excess together bound the overlap for documents of any size.
    """
    counts = np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8), int(np.maximum(counts - 255, 0).sum())


def digest(hashes: np.ndarray) -> tuple[int, int]:
    raw = hashes.tobytes()
    return tuple(xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63) for seed in (1, 2))


class CountTree:
    """Points bulk-loaded into a binary R-tree by halving along the widest coordinate."""

    def __init__(self, counts: np.ndarray, excess: np.ndarray, sizes: np.ndarray, clusters: np.ndarray, homes: np.ndarray | None = None, block: int = 0) -> None:
        self.counts, self.excess, self.sizes, self.clusters = counts, excess, sizes, clusters
        self.homes, self.here = homes, block ^ _HOMES
        self.nodes: list[tuple] = []
        self._build(np.arange(len(sizes)))

    def _build(self, ids: np.ndarray) -> None:
        waiting = [(ids, None)]
        while waiting:
            ids, parent = waiting.pop()
            own = len(self.nodes)
            if parent is not None:
                self.nodes[parent][5].append(own)
            c, k = self.counts[ids], self.clusters[ids]
            same = k[0] if (k == k[0]).all() else None
            top = c.max(axis=0)
            self.nodes.append((top, int(self.excess[ids].max()), int(self.sizes[ids].min()), int(self.sizes[ids].max()), same, [], ids))
            if len(ids) > LEAF:
                spread = np.append((top - c.min(axis=0)).astype(np.int64), np.ptp(self.sizes[ids]))
                by = int(spread.argmax())
                order = np.argsort(self.sizes[ids] if by == GROUPS else c[:, by], kind="stable")
                half = len(ids) // 2
                waiting += [(ids[order[half:]], own), (ids[order[:half]], own)]

    def may_link(self, x: int | np.ndarray, other: CountTree, y: np.ndarray) -> np.ndarray:
        """Whether the bound leaves the pairs of points."""
        return linked(self.bound(x, other, y), self.sizes[x], other.sizes[y])

    def bound(self, x: int | np.ndarray, other: CountTree, y: np.ndarray) -> np.ndarray:
        """What the pairs of points share at most."""
        return np.minimum(self.counts[x], other.counts[y]).sum(axis=-1, dtype=np.int64) + np.minimum(self.excess[x], other.excess[y])

    def nearest(self, other: CountTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the pairs that :func:`tree_pairs` finds, for each two clusters the one of the highest bound."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for x, y in tree_pairs(self, other):
            own, theirs = int(self.clusters[x[0]]), other.clusters[y]
            share = self.bound(x[0], other, y) / (self.sizes[x[0]] + other.sizes[y])
            order = np.lexsort((share, theirs))
            for k in order[np.append(theirs[order][1:] != theirs[order][:-1], True)].tolist():
                both = min(own, int(theirs[k])), max(own, int(theirs[k]))
                if both not in best or share[k] > best[both][0]:
                    best[both] = float(share[k]), int(x[0]), int(y[k])
            if len(best) >= 200_000:
                yield tuple(np.array([p[i] for p in best.values()]) for i in (1, 2))
                best.clear()
        if best:
            yield tuple(np.array([p[i] for p in best.values()]) for i in (1, 2))

    def is_home(self, x: int, other: CountTree, y: np.ndarray) -> np.ndarray:
        """Whether this block is the one of the blocks of both points that proposes them; several may if they agree in no order.

        Two documents with the same first block in an order are both in it, so all their other blocks can leave them out.
        """
        same = other.homes[y] == self.homes[x]
        first = same.argmax(axis=1)
        return ~same.any(axis=1) | (self.homes[x][first] == self.here[first])

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, fewer than points, that would connect all points: those of different clusters that the bound leaves."""
        middle: dict[int, int] = {}
        x, y = [], []
        for own in range(len(self.nodes) - 1, -1, -1):  # children come after their parents
            *_, kids, ids = self.nodes[own]
            among = np.array([middle[k] for k in kids]) if kids else ids
            mean = self.counts[ids].mean(axis=0)
            best = int(among[np.abs(self.counts[among] - mean).sum(axis=1).argmin()])
            middle[own] = best
            others = among[among != best]
            x.append(np.full(len(others), best))
            y.append(others)
        x, y = np.concatenate(x), np.concatenate(y)
        keep = self.clusters[x] != self.clusters[y]
        x, y = x[keep], y[keep]
        left = [self.may_link(x[i : i + 4096], self, y[i : i + 4096]) for i in range(0, len(x), 4096)]
        left = np.concatenate(left) if left else np.zeros(0, bool)
        return x[left], y[left]


def tree_pairs(left: CountTree, right: CountTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points, of different clusters, that the bound cannot rule out; each once if the trees are one."""
    one = left is right
    waiting = [(0, 0)]
    while waiting:
        i, j = waiting.pop()
        top_i, more_i, low_i, high_i, same_i, kids_i, ids_i = left.nodes[i]
        top_j, more_j, low_j, high_j, same_j, kids_j, ids_j = right.nodes[j]
        if same_i is not None and same_i == same_j or 5 * high_i < 4 * low_j or 5 * high_j < 4 * low_i:
            continue
        own = one and i == j
        if not own and not linked(int(np.minimum(top_i, top_j).sum(dtype=np.int64)) + min(more_i, more_j), low_i, low_j):
            continue
        if own and kids_i:
            waiting += [(kids_i[0], kids_i[0]), (kids_i[0], kids_i[1]), (kids_i[1], kids_i[1])]
        elif kids_i and (len(ids_i) >= len(ids_j) or not kids_j):
            waiting += [(k, j) for k in kids_i]
        elif kids_j:
            waiting += [(i, k) for k in kids_j]
        else:
            for n, x in enumerate(ids_i):
                y = ids_j[n + 1 :] if own else ids_j
                y = y[right.clusters[y] != left.clusters[x]]
                if len(y) and left.homes is not None:
                    y = y[left.is_home(x, right, y)]
                if len(y):
                    y = y[left.may_link(x, right, y)]
                    if len(y):
                        yield np.full(len(y), x), y


def _profiles(rows: DataFrame) -> DataFrame:
    """Documents with size, digest and point; and, with a null size, shingles that a stretch of documents often has."""
    schema = "doc_id long, n long, d1 long, d2 long, counts binary, excess long, token long, seen long"
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[np.ndarray] = []
        held = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            tokens, seen = np.unique(np.concatenate(chunk), return_counts=True)
            keep = seen >= 3
            k = int(keep.sum())
            if k:
                none = [pa.nulls(k, t) for t in arrow.types[:6]]
                yield pa.RecordBatch.from_arrays([*none, pa.array(tokens[keep].view(np.int64)), pa.array(seen[keep])], schema=arrow)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 500):
                out = []
                for key, text in zip(ids[at : at + 500], batch.column(1).slice(at, 500), strict=True):
                    h = shingle_hashes(text.as_py())
                    if len(h):
                        counts, excess = counts_of(h)
                        out.append((key, len(h), *digest(h), counts.tobytes(), excess, None, None))
                        chunk.append(h)
                        held += len(h)
                    else:
                        out.append((key, 0, 0 if key is None else key, -1, None, None, None, None))
                    if held >= _CHUNK:
                        yield from frequent()
                        chunk.clear()
                        held = 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
        if chunk:
            yield from frequent()

    return rows.mapInArrow(task, schema)


def _mark(doc_id: np.ndarray, d1: np.ndarray) -> np.ndarray:
    return mixed(doc_id.astype(np.int64).view(np.uint64) * np.uint64(3) ^ d1.astype(np.int64).view(np.uint64))


def _blocks(rows: DataFrame, common: np.ndarray, skipped: np.ndarray | None) -> DataFrame:
    """The first shingles of each document, common ones last. ``skipped``: marks of copies, which have no rows.

    ``salt`` is -1, or for a common shingle one of ``SALTS`` by id. Without ``skipped`` rows have the text's digest as well.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((common, skipped))
    kinds = {"token": "long", "salt": "int", "n": "int", "rank": "int", "doc_id": "long"} | ({"d1": "long"} if skipped is None else {})
    arrow = pa.schema([(name, pa.int64() if kind == "long" else pa.int32()) for name, kind in kinds.items()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, copies = shared.value
        tokens: list[np.ndarray] = []
        owners: list[tuple[int, int, int, int]] = []
        held = 0

        def flat() -> pa.RecordBatch:
            key, n, rows, text = np.array(owners, np.int64).T
            ids, size = np.repeat(key, rows), np.repeat(n, rows).astype(np.int32)
            token = np.concatenate(tokens)
            salt = np.where(among(late, token), ids % SALTS, -1) if len(late) else np.full(len(token), -1)
            rank = np.arange(len(token), dtype=np.int32) - np.repeat((np.cumsum(rows) - rows).astype(np.int32), rows)
            columns = [token.view(np.int64), salt.astype(np.int32), size, rank, ids] + ([np.repeat(text, rows)] if copies is None else [])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

        def among(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
            return sorted_[at] == values

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_hashes(text.as_py())
                if key is None or not len(h):
                    continue
                d1 = digest(h)[0]
                if copies is not None and len(copies) and among(copies, _mark(np.array([key]), np.array([d1])))[0]:
                    continue
                n = len(h)
                k = prefix_length(n)
                if len(late):
                    is_late = among(late, h)
                    h = h[~is_late][:k] if (~is_late).sum() >= k else np.concatenate([h[~is_late], h[is_late]])[:k]
                else:
                    h = h[:k]
                tokens.append(h)
                owners.append((key, n, len(h), d1))
                held += len(h)
                if held >= 100_000:
                    yield flat()
                    tokens.clear()
                    owners.clear()
                    held = 0
        if owners:
            yield flat()

    return rows.mapInArrow(task, ", ".join(map(" ".join, kinds.items())))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _shared(blocks: DataFrame, tasks: int) -> DataFrame:
    """``block``, ``doc_id`` and ``rank`` (of the shingle in the document) for blocks with two documents or more.

    A shingle's documents are cut by size. A block is named by its documents, so blocks of the same ones fall together; one
    of a common shingle, whose rows are spread, by the shingle.
    """
    arrow = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("rank", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if not sum(len(x[0]) for x in got):
            return
        token, salt, n, rank, doc = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.lexsort((n, salt, token))
        token, salt, n, rank, doc = token[order], salt[order], n[order].astype(np.int64), rank[order], doc[order]
        starts = _starts(token, salt, np.append(0, np.cumsum((5 * n[:-1] < 4 * n[1:]) & (salt[1:] < 0))))
        size, late = np.diff(starts, append=len(token)), salt[starts] >= 0
        members = np.add.reduceat(mixed(doc.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)), starts)
        name = mixed(np.where(late, token[starts].view(np.uint64), members)).view(np.int64)
        first = np.zeros(len(starts), bool)
        first[np.unique(name, return_index=True)[1]] = True
        rows = np.flatnonzero(np.repeat((size > 1) & first | late, size))
        name = np.repeat(name, size)
        for i in range(0, len(rows), 100_000):
            r = rows[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(name[r]), pa.array(doc[r]), pa.array(rank[r])], schema=arrow)

    found = blocks.repartition(tasks, "token", "salt").mapInArrow(task, "block long, doc_id long, rank int")
    return found.groupBy("block", "doc_id").agg(F.min("rank").alias("rank"))


def _open_blocks(shared: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows (``block``, ``doc_id``, ``rank``, ``cluster``), and ``block`` and ``rows`` of blocks with more than one cluster."""
    if links is None:
        placed = shared.withColumn("cluster", F.col("doc_id"))
    else:
        cluster = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
        placed = shared.select("block", "doc_id", "rank").join(staged(cluster, "clusters"), "doc_id", "left")
        placed = staged(placed.select("block", "doc_id", "rank", F.coalesce("cluster", "doc_id").alias("cluster")), "placed")
    several = placed.groupBy("block").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("rows"))
    return placed, staged(several.where("low <> high").select("block", "rows"), "open-blocks")


def _one_block(placed: DataFrame, several: DataFrame, turn: int) -> DataFrame:
    """Each document in one of its open blocks: by the order of shingles first, then by a hash that all agree on.

    ``i`` numbers the parts of a block of over ``CELL_ROWS`` documents; each turn deals them anew.
    """
    order = F.col("rank").cast("long") if turn == 0 else F.xxhash64("block", F.lit(turn))
    rows = placed.join(several.select("block"), "block", "left_semi")
    chosen = rows.groupBy("doc_id").agg(F.min(F.struct(order.alias("o"), "block", "cluster")).alias("x")).select("doc_id", "x.block", "x.cluster")
    parts = several.where(F.col("rows") > CELL_ROWS).select("block", F.ceil(F.col("rows") / CELL_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.coalesce("parts", F.lit(1))).cast("int")
    return chosen.join(parts, "block", "left").select("block", part.alias("i"), part.alias("j"), part.alias("part"), "doc_id", "cluster")


def _cells(placed: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of open blocks by block and cell. A block of over ``CELL_ROWS`` rows is cut into parts, and each two meet in a cell."""
    parts = F.ceil(F.col("rows") / CELL_ROWS).cast("int")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    return (
        placed.join(several.select("block", parts.alias("parts")), "block")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "cluster")
    )


def _homes(placed: DataFrame, several: DataFrame) -> DataFrame:
    """``doc_id`` and its first open block in each order."""
    least = [F.min(F.col("block").bitwiseXOR(F.lit(h))).alias(f"home{k}") for k, h in enumerate(_HOMES.tolist())]
    return placed.join(several.select("block"), "block", "left_semi").groupBy("doc_id").agg(*least)


def _tree_pairs(cells: DataFrame, points: DataFrame, tasks: int, which: str) -> DataFrame:
    """Pairs ``a < b`` of different clusters in one block that the bound leaves: ``spanning`` its tree, ``nearest`` ones of each two clusters, or ``all``.

    Of the blocks that two documents share one proposes the pair, but for ``spanning``; ``points`` then have their homes.
    """
    spanning = which == "spanning"
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    known = [] if spanning else [f"home{k}" for k in range(len(_HOMES))]
    wanted = cells.join(points, "doc_id").select("block", "i", "j", "part", "doc_id", "n", "cluster", "excess", "counts", *known)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [
            [*(c.to_numpy() for c in b.columns[:8]), np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint8).reshape(-1, GROUPS), *(c.to_numpy() for c in b.columns[9:])]
            for b in batches
            if b.num_rows
        ]
        if not got:
            return
        whole = [np.concatenate(x) for x in zip(*got, strict=True)]
        columns, counts, homes = whole[:8], whole[8], None if spanning else np.stack(whole[9:], axis=1)
        got.clear()
        order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
        block, i, j, part, doc, n, cluster, excess = (x[order] for x in columns)
        found: set[tuple[int, int]] = set()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=arrow)

        def tree(s: int, e: int) -> CountTree:
            return CountTree(counts[order[s:e]], excess[s:e], n[s:e], cluster[s:e], None if spanning else homes[order[s:e]], block[s])

        starts = _starts(block, i, j)
        for s, e in zip(starts, np.append(starts[1:], len(block)), strict=True):
            if e - s < 2 or (cluster[s:e] == cluster[s]).all():
                continue
            cut = s + int(np.searchsorted(part[s:e], j[s])) if i[s] != j[s] else s
            if cut == e or i[s] != j[s] and cut == s:
                continue
            right = tree(cut, e)
            left = right if cut == s else tree(s, cut)
            base = cut if left is right else s
            for x, y in [right.spanning()] if spanning else left.nearest(right) if which == "nearest" else tree_pairs(left, right):
                found.update((min(p, q), max(p, q)) for p, q in zip(doc[base + x].tolist(), doc[cut + y].tolist(), strict=True) if p != q)
                if len(found) >= 200_000:
                    yield batch()
                    found.clear()
        if found:
            yield batch()

    return wanted.repartition(tasks, "block", "i", "j").mapInArrow(task, "a long, b long")


def _links(rows: DataFrame, pairs: DataFrame, tasks: int) -> DataFrame:
    """The pairs whose sets are linked, by the texts: the partners of a document come to it, many in parts."""
    several = pairs.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > _PARTNERS).select("a", F.ceil(F.col("k") / _PARTNERS).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(several, "a", "left").select("a", "b", part.alias("part"))
    wanted = dealt.select("a", "part", F.lit(True).alias("partner"), F.col("b").alias("k")).union(
        dealt.select("a", "part", F.lit(False), F.col("a")).distinct()
    )
    wanted = staged(wanted, "wanted-texts")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = (None, None), []
        for batch in batches:
            out = []
            for a, part, partner, k, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if (a, part) != group:
                    group, own = (a, part), []
                h = shingle_hashes(text.as_py())
                if not partner:
                    own.append(h)
                elif any(linked(len(np.intersect1d(x, h, assume_unique=True)), len(x), len(h)) for x in own):
                    out.append((a, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=arrow)

    met = rows.join(few, F.col("k") == F.col("doc_id")).select("a", "part", "partner", "k", "t").repartition(tasks, "a", "part")
    return met.sortWithinPartitions("a", "part", "partner").mapInArrow(task, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    A text with fewer than five words has one shingle, all of it; one without words (null, empty) has none and is linked
    with nothing. Rows of equal text are linked if they have a word. Texts that share an id are documents of their own, each
    with the least id of its own component. A row with a null id gets a null component and links nothing. Extra columns
    are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    profiles = staged(_profiles(rows), "profiles")
    by_id = profiles.where("n is not null and doc_id is not null").groupBy("doc_id")
    shared = staged(by_id.agg(F.min("d1").alias("least"), F.max("d1").alias("most")).where("least <> most").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        dropped(shared)
        return _components(rows, profiles)
    dropped(profiles)
    # A text under a shared id goes by a hash of both.
    named = rows.join(shared.select("doc_id", F.lit(True).alias("several")), "doc_id", "left")
    node = F.when(F.col("several"), F.xxhash64("doc_id", F.md5(F.coalesce("t", F.lit(""))))).otherwise(F.col("doc_id"))
    named = named.withColumn("node", node)
    names = staged(named.where("several").select(F.col("node").alias("doc_id"), F.col("doc_id").alias("own")).distinct(), "names")
    apart = named.select(F.col("node").alias("doc_id"), "t")
    found = staged(_components(apart, staged(_profiles(apart), "profiles")).join(names, "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id")), "found")
    least = found.groupBy("component_id").agg(F.min("own").alias("least"))
    return found.join(least, "component_id", "left").select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _components(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` where rows of one id have one set."""
    spark = rows.sparkSession
    own = profiles.where("n is not null").select("doc_id", "n", "d1", "d2", "counts", "excess")
    seen = own.agg(F.sum(F.expr("n - ceil(0.8 * n) + 1")).alias("tokens")).first()
    often = profiles.where("n is null").groupBy("token").agg(F.sum("seen").alias("seen"))
    often = often.where(F.col("seen") >= COMMON_LEAST).orderBy(F.desc("seen"), "token").limit(COMMON_MOST)
    common = np.sort(often.select("token").toArrow().column(0).to_numpy().view(np.uint64))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((seen.tokens or 0) / ROWS_A_TASK))

    classes = staged(
        own.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1"),
        "classes",
    )
    nodes = own.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").withColumn("node", F.coalesce("node", "doc_id")).drop("copies")
    doubles = staged(nodes.where("node <> doc_id").select("doc_id", "d1").distinct(), "doubles")
    skipped = None
    if doubles.count() <= BROADCAST_IDS:
        marks = doubles.toArrow()
        skipped = np.sort(_mark(marks.column(0).to_numpy(), marks.column(1).to_numpy()))
    blocks = _blocks(rows, common, skipped)
    if skipped is None:
        blocks = blocks.join(doubles, ["doc_id", "d1"], "left_anti").select("token", "salt", "n", "rank", "doc_id")

    shared = staged(_shared(blocks, tasks), "blocks")
    points = own.where("n > 0 and doc_id is not null").select("doc_id", "n", "counts", "excess")
    links = tried = None
    turn = 0
    while True:
        placed, several = _open_blocks(shared, links)
        chosen = staged(_one_block(placed, several, turn), "one-block")
        pairs = _tree_pairs(chosen, points, tasks, "spanning").distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "spanning-pairs")
        more = staged(_links(rows, pairs, tasks), "spanning-links")
        tried = pairs if tried is None else tried.union(pairs)
        links = more if links is None else links.union(more)
        turn += 1
        if more.count() <= FRUITFUL * chosen.count():
            break
    for which in ("nearest", "all"):
        placed, several = _open_blocks(shared, links)
        homes = staged(_homes(placed, several), "homes")
        pairs = _tree_pairs(_cells(placed, several), points.join(homes, "doc_id"), tasks, which).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "tree-pairs")
        more = staged(_links(rows, pairs, tasks), "tree-links")
        tried, links = tried.union(pairs), links.union(more)
    found = staged(components(links), "components")
    dropped(shared, doubles, placed, several, homes, pairs, more)
    return (
        nodes.join(found.select("node", "component"), "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` without documents that are in the component of a lesser one, by id, then text.

    Texts that differ under one id are documents of their own; of rows that repeat id and text one stays. Rows with a
    null id and without words stay.
    """
    text = F.coalesce(F.md5(F.col("text").cast("string")), F.lit(""))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("own_id"), text.alias("digest"))
    repeated = rows.groupBy("own_id").agg(F.count("*").alias("rows"), F.min("digest").alias("first"), F.max("digest").alias("last"))
    repeated = staged(repeated.where("rows > 1"), "repeated-ids")
    if repeated.isEmpty():
        found = jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
        return docs.join(staged(found, "gone-ids"), F.col("doc_id") == F.col("gone_id"), "left_anti")

    # further texts of an id get ids of their own for the join, by hash
    several = F.col("first").isNotNull() & (F.col("digest") != F.col("first"))
    node = F.when(several, F.xxhash64("own_id", "digest")).otherwise(F.col("own_id"))
    further = staged(rows.join(repeated, "own_id").where(several).select(node.alias("node"), "own_id", "digest").distinct(), "further-texts")
    wide = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), text.alias("digest"), F.col("text").alias("t"))
    nodes = wide.join(repeated, "own_id", "left").withColumn("node", node)
    found = jaccard_components(nodes.select("node", "t"), doc_id="node", text="t").where("doc_id is not null").distinct()
    named = found.select(F.col("doc_id").alias("node"), "component_id").join(further, "node", "left")
    order = F.struct(F.coalesce("own_id", "node").alias("id"), F.coalesce("digest", F.lit("")).alias("digest"), "node")
    least = named.groupBy("component_id").agg(F.min(order)["node"].alias("least"))
    gone = staged(named.join(least, "component_id").where("node <> least").select(F.col("node").alias("gone_id")), "gone-ids")
    left = nodes.join(gone, F.col("node") == F.col("gone_id"), "left_anti").select("row", "rows", "own_id", "digest")
    twins = Window.partitionBy("own_id", "digest").orderBy(F.xxhash64("row"))
    once = left.where("rows > 1").withColumn("twin", F.row_number().over(twins)).where("twin = 1")
    return left.where("rows is null").select("row.*").unionByName(once.select("row.*"))
