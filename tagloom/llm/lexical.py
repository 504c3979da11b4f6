"""Ranked lexical search: a stated set of queries against all documents, with integer scores that no order of work changes.

Each task turns its own documents into a shard: postings in compressed rows, by term, of the terms that the queries use, with
integer impacts worked out once for all queries. A query adds its terms' postings one by one to a dense accumulator over
the shard's documents, and its best are cut out by partition, equal scores by id, so that no tie is lost. Tasks keep the best
of each query; a merge in two steps keeps the best of all.

Texts are read once: terms are counted first and the counts written to the shared folder, as impacts need the corpus's
numbers. What the driver and the tasks hold of the queries is bounded by ``QUERY_BYTES``; more queries go in several blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.storage import staged

TOP = 50
QUERY_BYTES = 1 << 24
SHARD_DOCUMENTS = 1 << 16
SHARD_POSTINGS = 1 << 22
_MERGERS = 64
_PIECE = 1 << 20
#: Letters and digits stay, A-Z lowered, and so does every byte of other characters; all else separates.
_TERMS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "q int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Queries:
    """A block of queries: ids, and each one's distinct terms as numbers."""

    ids: tuple[int | None, ...]
    terms: tuple[tuple[int, ...], ...]
    place: dict[bytes, int]


def queries_of(rows: list[tuple[int | None, str | None]]) -> Queries:
    place: dict[bytes, int] = {}
    terms = [tuple(sorted({place.setdefault(t, len(place)) for t in terms_of(text)})) for _, text in rows]
    return Queries(tuple(key for key, _ in rows), tuple(terms), place)


def count_terms(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """Each row's ``doc_id``, number of terms, and how often it holds which of the terms in ``place``."""
    shared = docs.sparkSession.sparkContext.broadcast(place)  # terms of QUERY_BYTES of queries
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def counted(text: str | None, wanted) -> tuple[int, Counter]:
        if not text or len(text) <= _PIECE:
            words = terms_of(text)
            return len(words), Counter(map(wanted, words))
        n, found, at = 0, Counter(), 0
        while at < len(text):  # pieces end at a blank, so that a very long text takes little memory
            end = text.find(" ", at + _PIECE)
            words = terms_of(text[at : end if end > 0 else len(text)])
            n, at = n + len(words), end if end > 0 else len(text)
            found.update(map(wanted, words))
        return n, found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.get
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                sizes, terms, tfs = [], [], []
                for text in part.column(1):
                    n, found = counted(text.as_py(), wanted)
                    found.pop(None, None)
                    sizes.append(n)
                    terms.append(list(found.keys()))
                    tfs.append(list(found.values()))
                columns = [pa.array(x, f.type) for x, f in zip((sizes, terms, tfs), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return docs.mapInArrow(task, _COUNTED)


def _best(docs: np.ndarray, missing: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` greatest scores, equal ones by id, missing ids last."""
    if len(scores) > top:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((docs[among], missing[among], -scores[among]))[:top]]


class Shard:
    """Postings of some documents by term, with impacts."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: int, length: int) -> None:
        most = int(n.max(initial=0))
        wide = n.astype(object) if 50 * most * total >= 1 << 63 else n  # only then beyond 64 bits
        m = (50 + (50 * wide * total) // max(1, length)).astype(np.int64)
        rows = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        order = np.argsort(terms, kind="stable")
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.rows, tf = rows[order], tfs[order]
        self.impacts = weights[terms[order]] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.rows]))
        self.size = len(n)

    def scores(self, terms: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        for t in terms:
            a, b = self.start[t], self.start[t + 1]
            out[self.rows[a:b]] += self.impacts[a:b]  # a document stands once in a term's postings
        return out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy().astype(np.int64)


def search_shards(counted: DataFrame, queries: Queries, weights: np.ndarray, total: int, length: int, top: int) -> DataFrame:
    """Each task's best documents of each query; a task holds one shard and ``top`` documents for each query."""
    shared = counted.sparkSession.sparkContext.broadcast((queries.terms, weights))
    schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, w = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def searched() -> None:
            ids, missing, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            shard = Shard(n, sizes, terms, tfs, w, total, length)
            for q, own in enumerate(wanted):
                scores = shard.scores(own)
                hit = np.flatnonzero(scores > 0)
                if not len(hit):
                    continue
                found = (ids[hit], missing[hit], scores[hit])
                if q in kept:
                    found = tuple(map(np.concatenate, zip(kept[q], found, strict=True)))
                best = _best(*found, top)
                kept[q] = tuple(x[best] for x in found)

        documents = postings = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 4096)
                at += 4096
                key = part.column(0)
                sizes, terms = _flat(part.column(2))
                held.append((key.fill_null(0).to_numpy(), key.is_null().to_numpy(False), part.column(1).to_numpy(), sizes, terms, _flat(part.column(3))[1]))
                documents, postings = documents + part.num_rows, postings + len(terms)
                if documents >= SHARD_DOCUMENTS or postings >= SHARD_POSTINGS:
                    searched()
                    documents = postings = 0
        if held:
            searched()
        for q, (ids, missing, scores) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids, mask=missing), pa.array(scores)], schema=schema)

    return counted.mapInArrow(task, _FOUND)


def _ranked(found: DataFrame, top: int, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(rows: DataFrame, queries: Queries, top: int) -> DataFrame:
    spark = rows.sparkSession
    counted = staged(count_terms(rows, queries.place), "term-counts")
    total, length = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.t: r.n for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    weights = np.array([weight(total, df.get(t, 0)) for t in range(len(queries.place))], np.int64)
    found = search_shards(counted, queries, weights, total, length, top)
    merged = _ranked(_ranked(found.withColumn("merger", F.spark_partition_id() % _MERGERS), top, "q", "merger"), top, "q")
    named = spark.createDataFrame(list(enumerate(queries.ids)), "q int, item_id long")
    return merged.join(F.broadcast(named), "q").select("item_id", "rank", "doc_id", "score")  # at most QUERY_BYTES of queries


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """For each row of ``items`` the ``top`` documents of greatest score above 0, ranked from 1: equal scores by id, null last.

    Null and empty texts have no terms: as documents they count nowhere, as items they find nothing. Every row of ``docs`` is a
    document, so rows that repeat an id rank one after the other; every row of ``items`` is a query of its own. Extra
    columns are ignored. Empty tables give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // query_bytes) or 1
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        block = [(r.item_id, r.text) for r in asked.where(own == b).collect()]
        block.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        found.append(_search_block(rows, queries_of(block), top))
    return reduce(DataFrame.union, found)
