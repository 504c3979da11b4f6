"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

The distinct five-word shingles of a text are hashed once. The low bits of a hash choose its bin, the rest compete
there for the minimum. An empty bin takes the value of the first filled bin in a random order of its own, the same for
all texts. Of each bin ``BITS`` low-order bits are packed. Two bins agree by chance with probability ``2**-BITS``; the
likeness takes that bias away.

The likeness to the following document needs neighbours in the order of ids. Documents are dealt by ranges of ids whose
bounds are ids of the table; the top of each range also goes to the range before it, so one shuffle of the texts
suffices, each range is read as a stream, and no task depends on another.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.words import shingle_hashes

BINS = 512
BITS = 4
RESULT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_FAST_TRIES = 8
_ORDERS: dict[int, np.ndarray] = {}


def _orders(bins: int) -> np.ndarray:
    """Row i: the bins in the order in which bin i looks for a value."""
    if bins not in _ORDERS:
        _ORDERS[bins] = np.argsort(np.random.default_rng(20_240_229).random((bins, bins)), axis=1).astype(np.int32)
    return _ORDERS[bins]


def sketch(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """The low bits of all bins (uint8), or None for a text without words. ``bins`` is a power of two."""
    if not len(hashes):
        return None
    place = (hashes & np.uint64(bins - 1)).astype(np.int64)
    value = hashes >> np.uint64(bins.bit_length() - 1)
    order = np.argsort(place, kind="stable")  # hashes ascend, so the first of a bin is its minimum
    place = place[order]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    low = np.zeros(bins, np.uint8)
    filled = np.zeros(bins, bool)
    low[place[first]] = (value[order[first]] & np.uint64((1 << bits) - 1)).astype(np.uint8)
    filled[place[first]] = True
    left = np.flatnonzero(~filled)
    if len(left):
        tries = _orders(bins)
        for k in range(_FAST_TRIES):
            source = tries[left, k]
            hit = filled[source]
            low[left[hit]] = low[source[hit]]
            left = left[~hit]
            if not len(left):
                break
        if len(left):
            wanted = tries[left]
            low[left] = low[wanted[np.arange(len(left)), filled[wanted].argmax(axis=1)]]
    return low


def packed(low: np.ndarray | None, bits: int = BITS) -> str:
    """Base64 of the packed bits; empty for a text without words."""
    if low is None:
        return ""
    spread = np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]
    return base64.b64encode(np.packbits(spread)).decode()


def unpacked(text: str, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    if not text:
        return None
    flat = np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8))[: bins * bits].reshape(bins, bits)
    return (flat @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of shingle sets. Two texts without words are alike, one without is like no other."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-bits
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, and how near it is to its edited text and to the next document.

    Next is descending ``doc_id``, and after the last the first; equal ids are in ascending order of text, null ids
    last. Null texts count as empty. Extra columns are ignored. A single row is its own next. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(lowest)).alias("k"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
        F.col(doc_id).cast("long").isNull().alias("none"),
    )
    seen = rows.agg(F.count("*").alias("n"), F.max("k").alias("top")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(seen.n / 20_000), 1)
    tops = [] if seen.n == 0 else [seen.top]
    if seen.n:
        shares = [i / ranges for i in range(1, ranges)]
        found = rows.agg(F.percentile_approx("k", shares, max(10_000, 20 * ranges)).alias("p")).first() if shares else None
        tops = sorted({*tops, *(found.p if found else [])})
    bounds = np.array(tops, np.int64)  # a range holds the ids over the bound before it, up to its own

    dealt_schema = "r int, ghost boolean, k long, t string, none boolean"
    dealt_arrow = pa.schema([("r", pa.int32()), ("ghost", pa.bool_()), ("k", pa.int64()), ("t", pa.string()), ("none", pa.bool_())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            r = np.searchsorted(bounds, k).astype(np.int32)
            t = batch.column(1).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r), pa.array(np.zeros(len(k), bool)), batch.column(0), t, batch.column(2)], schema=dealt_arrow
            )
            if len(top := np.flatnonzero(bounds[r] == k)):
                take = pa.array(top)
                after = ((r[top] + 1) % len(bounds)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(after), pa.array(np.ones(len(top), bool)), batch.column(0).take(take), t.take(take), batch.column(2).take(take)],
                    schema=dealt_arrow,
                )

    out_arrow = pa.schema(
        [(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t])
         for n, t in (x.split() for x in RESULT_SCHEMA.split(", "))]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before = None  # range, id, text, sketch of the row that waits for its next

        def result(own: tuple, following: str, other: np.ndarray | None) -> tuple:
            _, key, body, low, none = own
            edited = edited_text(body, following)
            changed = low if edited == body else sketch(shingle_hashes(edited))
            return (
                None if none else key, len(body), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                packed(low), packed(changed), likeness(low, changed), likeness(low, other),
            )

        for batch in batches:
            r, ghost, k, t, none = batch.columns
            for r_, ghost_, k_, t_, none_ in zip(r.to_pylist(), ghost.to_pylist(), k.to_pylist(), t, none.to_pylist(), strict=True):
                if ghost_ and (before is None or before[0] != r_):
                    continue  # rows of equal id after the one that was wanted
                body = t_.as_py()
                low = sketch(shingle_hashes(body))
                if before is not None and before[0] == r_:
                    out.append(result(before, body, low))
                before = None if ghost_ else (r_, k_, body, low, none_)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=out_arrow)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=out_arrow)

    if not len(bounds):
        return spark.createDataFrame([], RESULT_SCHEMA)
    return (
        rows.mapInArrow(deal, dealt_schema)
        .repartitionById(ranges, F.col("r"))  # a range is a partition, so none waits for another
        .sortWithinPartitions("r", "ghost", F.desc("k"), "none", "t")
        .mapInArrow(compare, RESULT_SCHEMA)
    )
