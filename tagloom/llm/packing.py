"""Packing tokenised documents into training sequences of equal cost.

A document's cost is linear in its tokens plus quadratic for attention. Documents, in descending order of cost, go to
the sequence of lowest cost so far that still has room. Tokens are counted whole, and the sequences of a window have
exactly as much room as the window has tokens: full sequences, then a tail cut at powers of two, which need no padding.
What a window puts into its tail goes on to the next window, so a task has one tail.

Each task packs the documents of its own input split, window by window, so nothing is shuffled, no source or long
document makes a hot task, and a lost task is redone alone. Memory holds one window of token ids.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
WINDOW_TOKENS = 4_000_000
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)
_KEPT_CHUNKS, _KEPT_RUNS = 400_000, 800_000
#: Byte-level BPE spells printable Latin-1 characters as themselves and the other bytes, in order, from U+0100 on.
_SPELT = {
    b: 256 + i
    for i, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255))
}


class _Doubted(dict):
    """Whether a character's class or lower case may depend on the version of Unicode, or on its neighbours."""

    def __missing__(self, c: str) -> bool:
        old = unicodedata.ucd_3_2_0.category
        out = c in "Σİ" or any(old(x) == "Cn" or old(x) != unicodedata.category(x) for x in {c, *c.lower()})
        self[c] = out
        return out


class WordEncoder:
    """Ids of a word-wise BPE tokenizer: white space only separates, so each chunk between blanks is encoded alone.

    Chunks and their letter, digit and sign runs are remembered (bounded); the model itself sees each new run once.
    The ids are those of ``Tokenizer.encode`` without added special tokens: a text that spells a special token out is
    encoded by the tokenizer whole, and a chunk with a character that Unicode versions may read differently, alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

        def encode(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        def merged(run: str) -> bytes:
            """The ids of one run by the model alone, which wants bytes spelt as letters."""
            spelt = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(_SPELT)
            return array("I", [token.id for token in model.tokenize(spelt)]).tobytes()

        suffix = "'s|'t|'re|'ve|'m|'ll|'d"
        ascii_runs = re.compile(rf"{suffix}|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        runs = regex.compile(rf"{suffix}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+").findall

        class Runs(dict):
            def __missing__(self, run: str) -> bytes:
                out = merged(run)
                if len(self) < _KEPT_RUNS:
                    self[run] = out
                return out

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if chunk.isascii():
                    out = b"".join(map(known.__getitem__, ascii_runs(chunk.lower())))
                elif unicodedata.is_normalized("NFC", chunk) and not any(map(doubted.__getitem__, chunk)):
                    out = b"".join(map(known.__getitem__, runs(chunk.lower())))
                else:
                    out = encode(chunk)
                if len(chunk) <= 32 and len(self) < _KEPT_CHUNKS:
                    self[chunk] = out
                return out

        known, doubted, self._chunks, self._encode = Runs(), _Doubted(), Chunks(), encode

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(x in text for x in "\x1c\x1d\x1e\x1f"):  # blanks for str.split, signs for the tokenizer
            return self._encode(text)
        if any(x in text for x in self._special):
            return self._encode(text)
        return b"".join(map(self._chunks.__getitem__, text.split()))


def cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def pack_lengths(
    lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY
) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces ``(document, start, length, sequence, offset)`` and the sequences' lengths; every sequence is full.

    ``capacity`` is a power of two. Sequences that hold one full piece of a long document come first.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []
    rest = []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        for start in range(0, whole, capacity):
            pieces.append((d, start, capacity, len(rooms), 0))
            rooms.append(capacity)
        if n > whole:
            rest.append((n - whole, d, whole))
    total = sum(n for n, _, _ in rest)
    first = len(rooms)
    rooms += [capacity] * (total // capacity)
    tail = total % capacity
    rooms += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if tail >> b & 1]
    used = [0] * len(rooms)
    spent = [0.0] * len(rooms)
    # Pieces descend, so a sequence with room for one piece has room for the next: the heap holds those with room, by cost,
    # and the others wait, by room, until a piece is small enough.
    heap = [(0.0, s) for s in range(first, len(rooms)) if rooms[s] == capacity]
    waiting = [(-rooms[s], s) for s in range(first, len(rooms)) if rooms[s] < capacity]
    heapq.heapify(waiting)

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, s, used[s]))
        used[s] += n
        spent[s] += cost(n, linear, quadratic)

    homeless = []
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(heap, (spent[s], s))
        if not heap:
            homeless.append((n, d, start))
            continue
        s = heapq.heappop(heap)[1]
        put(d, start, n, s)
        room = rooms[s] - used[s]
        if room >= n:
            heapq.heappush(heap, (spent[s], s))
        elif room:
            heapq.heappush(waiting, (-room, s))
    heap = [(spent[s], s) for s in range(first, len(rooms)) if used[s] < rooms[s]]
    heapq.heapify(heap)
    for n, d, start in homeless:  # no sequence had room: cut over what is left
        while n:
            s = heapq.heappop(heap)[1]
            k = min(n, rooms[s] - used[s])
            put(d, start, k, s)
            n, start = n - k, start + k
            if used[s] < rooms[s]:
                heapq.heappush(heap, (spent[s], s))
    return pieces, rooms


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    doc_id: Column | str = "doc_id",
    text: Column | str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    window_tokens: int = WINDOW_TOKENS,
    linear: float = 1.0,
    quadratic: float | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens, a power of two.

    ``tokenizer`` is the path of a ``tokenizers`` file that every node has. Null and empty texts give the end id alone.
    Repeated rows are packed once each. Extra columns are ignored. An empty table gives no pieces. ``window_tokens``
    bounds a task's memory; a longer document makes a window of its own. Ties in cost go to the first sequence, in length
    to the first row.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    ends = array("I", [end_id]).tobytes()
    square = 1.0 / capacity if quadratic is None else quadratic
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = WordEncoder(tokenizer), TaskContext.get().partitionId() << 32
        window: list[tuple[int | None, bytes, int, int]] = []  # id, the document's ids, the first to pack and how many
        held = 0

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            pieces, rooms = pack_lengths([n for *_, n in window], capacity, linear, square)
            rows, rest = [], []
            for d, start, n, s, offset in pieces:
                key, ids, first, _ = window[d]
                start += first
                if last or rooms[s] == capacity:
                    rows.append((key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + s, offset, rooms[s]))
                else:
                    rest.append((key, ids, start, n))
            base += len(rooms)
            window[:] = rest
            held = sum(n for *_, n in rest)
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*rows[i : i + 50_000], strict=True)], schema=schema
                )

        for batch in batches:
            for key, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text_.as_py()) + ends
                window.append((key, ids, 0, len(ids) // 4))
                held += len(ids) // 4
                if held >= window_tokens:
                    yield from packed(False)
        if window:
            yield from packed(True)

    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    body = F.col(text) if isinstance(text, str) else text
    return docs.select(key.cast("long").alias("k"), body.cast("string").alias("t")).mapInArrow(task, PIECE_SCHEMA)
