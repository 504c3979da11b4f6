"""Linear scores of whole texts: hashed character n-grams of each chunk between blanks, averaged over the chunks.

Models are fitted in the driver on a bounded sample of labelled rows. A fitted model scores a text as the mean of its
chunks' vectors. The n-grams of a text are hashed and counted all at once over its bytes, so new words cost as much as known ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a text that are hashed at once.
_PIECE = 1 << 18


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts).cast("int")


def bounded_sample(rows: DataFrame, label: str, most_per_label: int, seed: int = 7) -> DataFrame:
    """About ``most_per_label`` rows of each label by a hash of ``doc_id``; all rows where there are no more.

    The share is worked out from exact counts, so the sample's size is bounded whatever the table's. Adds ``share``.
    """
    counts = rows.groupBy(label).count().collect()
    if not counts:
        return rows.withColumn("share", F.lit(1.0))
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r[label], min(1.0, most_per_label / r["count"]))))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("share", F.try_element_at(shares, F.col(label))).where(place < F.col("share"))


def labels_without(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """``doc_id`` and ``y``, the greatest label of the id, of the ids outside the held-out fold."""
    rows = labels.where(fold(F.col("doc_id"), parts) != held)
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where("y is not null")


def labelled_sample(docs: DataFrame, known: DataFrame, most_per_label: int, seed: int = 7) -> list:
    """About ``most_per_label`` rows (``t``, ``y``, ``share``) of each label, in a fixed order.

    Ids are drawn first, so the join broadcasts a table whose size the parameter bounds, and no text is shuffled.
    """
    ids = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = bounded_sample(ids, "y", most_per_label, seed).select(F.col("doc_id").alias("drawn"), "y", "share")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("t")).join(F.broadcast(drawn), F.col("doc_id") == F.col("drawn"))
    return sorted(rows.select("doc_id", "t", "y", "share").collect(), key=lambda r: (r.doc_id, r.t or ""))


def grams(chunk: str, sizes: tuple[int, ...]) -> list[bytes]:
    body = b"\x02" + chunk.encode("utf-8", "replace") + b"\x03"
    return [body[i : i + n] for n in sizes for i in range(len(body) - n + 1)]


def features(chunk: str, sizes: tuple[int, ...], width: int) -> list[int]:
    """Hashed n-grams of a chunk; a very long chunk is read whole."""
    crc, mask = zlib.crc32, width - 1
    return [crc(g) & mask for g in grams(chunk, sizes)]


@cache
def _bytewise(size: int, width: int) -> tuple[np.ndarray, ...]:
    """The crc32 of ``size`` bytes, modulo ``width``, as tables for each byte's place: their exclusive or is the checksum.

    A checksum is linear in the bits of its bytes but for that of zeros. The blank, which stands between chunks and in none,
    sets a bit above ``width`` in every table.
    """
    zeros, mask = zlib.crc32(bytes(size)), width - 1
    at = lambda i, x: zlib.crc32(bytes(i) + bytes([x]) + bytes(size - 1 - i)) ^ (0 if i == 0 else zeros)
    tables = np.array([[at(i, x) & mask for x in range(256)] for i in range(size)], np.int64)
    tables[:, 0x20] = width
    return tuple(tables)


def counts(words: list[str], sizes: tuple[int, ...], width: int) -> np.ndarray:
    """How often each hash of :func:`features` occurs in chunks without blanks, of ``sizes`` below five; memory beside the text is bounded."""
    body = b"\x02" + "\x03 \x02".join(words).encode("utf-8", "replace") + b"\x03"
    total = np.zeros(width, np.int64)
    for start in range(0, len(body), _PIECE):
        part = np.frombuffer(body[start : start + _PIECE + max(sizes) - 1], np.uint8)
        for size in sizes:
            n = min(_PIECE, len(part) - size + 1)
            if n > 0:
                tables = _bytewise(size, width)
                hashed = tables[0][part[:n]]
                for i in range(1, size):
                    hashed ^= tables[i][part[i : i + n]]
                total += np.bincount(hashed, minlength=2 * width)[:width]
    return total


def matrix(texts: Iterable[str | None], sizes: tuple[int, ...], width: int, chunks: Callable[[str], list[str]]) -> np.ndarray:
    """Rows of mean feature counts (float32)."""
    out = []
    for text in texts:
        words = chunks(text or "")
        found = counts(words, sizes, width) if words else np.zeros(width)
        out.append((found / max(1, len(words))).astype(np.float32))
    return np.stack(out) if out else np.zeros((0, width), np.float32)


class Scorer:
    """Mean chunk vectors under weights ``width x k``."""

    def __init__(self, weights: np.ndarray, sizes: tuple[int, ...], chunks: Callable[[str], list[str]]) -> None:
        self.weights, self.sizes, self.chunks = weights, sizes, chunks

    def mean(self, text: str) -> np.ndarray:
        words = self.chunks(text)
        if not words:
            return np.zeros(self.weights.shape[1])
        found = counts(words, self.sizes, len(self.weights))
        at = np.flatnonzero(found)
        return (found[at, None] * self.weights[at].astype(np.float64)).sum(axis=0) / len(words)


def descend(
    gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float, least: np.ndarray | float = -np.inf
) -> np.ndarray:
    """Adam over the full sample, with falling steps; no entry goes below ``least``."""
    x, m, v = start.astype(np.float64), np.zeros(start.shape), np.zeros(start.shape)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = np.maximum(least, x - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
    return x


def mapped(rows: DataFrame, schema: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Each row through the function that ``start`` makes once in a task. Rows are read and written in small batches."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or start()
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = [f(*(c.as_py() for c in row)) for row in zip(*part.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow
                )

    return rows.mapInArrow(task, schema)
