"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, over a whole corpus.

Byte offsets where tokens of both end cut a text's tokens into groups. A task interns the distinct groups of a block of
documents in a dictionary, so a document is a row of group numbers and how often each occurs, and links are expanded once
for each distinct group: in the task to count, for each pair of ids, the documents that hold it linked (a document that
holds a pair through several groups counts once), and over the whole corpus to value each distinct group by the pairs'
counts. The values go back to the blocks' dictionaries by group key, and from there to documents, times frequencies.

Texts are tokenized once. Documents and dictionaries are written to the shared folder; nothing whole passes through the
driver, and a task holds one block. Both tokenizers are run on the pieces between blanks, which is where no token of either
crosses, and a worker remembers the pieces it has met (bounded).
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.packing import _SPELT
from tagloom.llm.storage import staged

BLOCK_PIECES = 2_000_000
_KEPT = 600_000
_LONG = 1 << 20
#: A blank between two characters that no one takes for blanks: there a token of either kind begins.
_CUT = re.compile(r"(?<=[^\s᠎​﻿]) (?=[^\s᠎​﻿])")
_EDGES = re.compile(r"[\s᠎​﻿]").match
_ODD, _LOST = -1, -2
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = (
    "kind int, block long, place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "groups array<int>, times array<int>, key string, a int, b int, n long"
)
_DOCUMENT, _GROUP, _PAIR = 0, 1, 2


class _Numbered(dict):
    """Numbers in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = out = len(self)
        return out


def _among(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among ``others``, both ascending and not empty."""
    return others[np.minimum(np.searchsorted(others, x), len(others) - 1)] == x


class PairEncoder:
    """Tokens of pieces by both tokenizers, cut into groups; a piece is a text after a blank that both put before it.

    Pieces that are new go through the tokenizers in one text, as no token crosses from one to the next.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {chr(c): b for b, c in ({x: x for x in range(256)} | _SPELT).items()}
        spelt = {i: bytes(map(byte.__getitem__, t)) for t, i in self._a.get_vocab(with_added_tokens=False).items()}
        pieces = [(i, self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]
        self._bytes_a = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self._sizes = [np.array([len(t) for t in x]) for x in (self._bytes_a, self._bytes_b)]
        written = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self._written_a = [written(len(self._bytes_a), x) for x in ",|"]
        self._written_b = [written(len(self._bytes_b), x) for x in ",;\n"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self._odd: dict[str, int] = {}
        self.written: list[str] = []
        self.keys = _Numbered()
        self.counts = [array("q") for _ in _COUNTS]
        self.start, self.members = array("q", [0]), array("q")

    def __len__(self) -> int:
        return max(len(self.written), len(self.keys))

    def _learn(self, pieces: list[str], into: dict[str, int]) -> None:
        """Number pieces; those whose tokens do not give their bytes back are ``_LOST``."""
        text = " ".join(pieces)
        ids_a = self._a.encode(f" {text}", add_special_tokens=False).ids
        ids_b = self._b.encode(text)
        if not b"".join(map(self._bytes_a.__getitem__, ids_a)) == b"".join(map(self._bytes_b.__getitem__, ids_b)) == f" {text}".encode():
            if len(pieces) == 1:
                into[text] = _LOST
                return
            self._learn(pieces[: len(pieces) // 2], into)
            self._learn(pieces[len(pieces) // 2 :], into)
            return
        ids_a, ids_b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = (np.cumsum(z[i]) for z, i in zip(self._sizes, (ids_a, ids_b), strict=True))
        cut_a, cut_b = _among(ends_a, ends_b), _among(ends_b, ends_a)
        cuts, ends = ends_a[cut_a], np.cumsum([len(p.encode()) + 1 for p in pieces])
        owner = np.searchsorted(ends, cuts)  # the piece of each group
        last = np.append(owner[1:] != owner[:-1], True)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        signs_a = np.where(cut_a, self._written_a[1][ids_a], self._written_a[0][ids_a])
        plain, end, final = (w[ids_b] for w in self._written_b)
        signs_b = np.where(cut_b, np.where(last[group_b], final, end), plain)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = "".join(np.concatenate([signs_a, signs_b])[order].tolist())
        into.update(zip(pieces, range(len(self.written), len(self.written) + len(pieces)), strict=True))
        self.written += written.split("\n")[:-1]
        self.members.extend(map(self.keys.__getitem__, written.replace("\n", ";").split(";")[:-1]))
        n, in_a, in_b = len(pieces), np.bincount(group_a), np.bincount(group_b)
        sums = [np.bincount(owner, w, n).astype(np.int64) for w in (in_a, in_b, np.ones(len(cuts)), in_a * in_b)]
        for c, x in zip(self.counts, sums, strict=True):
            c.frombytes(x.tobytes())
        self.start.frombytes((self.start[-1] + np.cumsum(sums[2])).tobytes())

    def learn(self, pieces: set[str]) -> None:
        """Number pieces without blanks; one with a blank at its edge gets ``_ODD``, as its neighbours matter."""
        plain, held = [], 0
        for p in sorted(pieces):
            if not p or _EDGES(p) or _EDGES(p[-1]):
                self.known[p] = _ODD
                continue
            plain.append(p)
            held += len(p)
            if held > _LONG:
                self._learn(plain, self.known)
                plain, held = [], 0
        if plain:
            self._learn(plain, self.known)

    def numbers(self, text: str, pieces: list[str]) -> np.ndarray:
        """The numbers of a text's pieces, all of which were learnt; empty if its tokens do not give its bytes back."""
        out = np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))
        if (out == _ODD).any():
            pieces = _CUT.split(text)
            for p in pieces:
                if self.known.get(p, _ODD) == _ODD and p not in self._odd:
                    self._learn([p], self._odd)
            out = np.array([n if (n := self.known.get(p, _ODD)) != _ODD else self._odd[p] for p in pieces], np.int32)
        return out[:0] if (out == _LOST).any() else out

    def line(self, numbers: np.ndarray) -> str:
        """The groups of the pieces as they are written."""
        return ";".join(map(self.written.__getitem__, numbers.tolist()))


def _stretches(text: str) -> Iterator[str]:
    """Parts of a very long text, cut where pieces are, so that it takes little memory."""
    at = 0
    while len(text) - at > _LONG and (cut := _CUT.search(text, at + _LONG)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _expanded(owners: np.ndarray, items: np.ndarray, start: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and the members of their items."""
    sizes = np.diff(start)[items]
    first = np.repeat(start[items] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    return np.repeat(owners, sizes), members[first + np.arange(len(first))]


def _distinct(owners: np.ndarray, members: np.ndarray, size: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct pairs of owner and member (below ``size``), ascending, and how often each occurs."""
    keys = owners * max(1, size) + members
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return np.divmod(keys[first], max(1, size)), np.diff(first, append=len(keys))


def _view(x: array) -> np.ndarray:
    return np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64)


class _Block:
    """Documents by piece numbers, until the block is full."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.pieces: list[np.ndarray] = []
        self.digests: list[str] = []
        self.size = 0

    def add(self, doc_id: int | None, pieces: np.ndarray, digest: str) -> None:
        self.ids.append(doc_id)
        self.pieces.append(pieces)
        self.digests.append(digest)
        self.size += len(pieces)

    def batches(self, block: int, words: PairEncoder, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows of the documents, of the block's distinct groups and of its pairs of ids with their documents."""

        def rows(kind: int, n: int, /, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
            for i in range(0, n, 2000 if kind == _DOCUMENT else 50_000):
                size = min(n - i, 2000 if kind == _DOCUMENT else 50_000)
                fixed = {"kind": pa.array(np.full(size, kind), pa.int32()), "block": pa.array(np.full(size, block), pa.int64())}
                own = fixed | {k: v.slice(i, size) for k, v in columns.items()}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(size, f.type) for f in schema], schema=schema)

        n = len(self.ids)
        pieces = np.concatenate(self.pieces)
        docs = np.repeat(np.arange(n), [len(x) for x in self.pieces])
        counts = {c: np.bincount(docs, _view(x)[pieces], n).astype(np.int64) for c, x in zip(_COUNTS, words.counts, strict=True)}
        held, times = _distinct(*_expanded(docs, pieces, _view(words.start), _view(words.members)), len(words.keys))
        owners, groups = held
        own = np.unique(groups)  # the block's dictionary
        groups = np.searchsorted(own, groups)
        names = list(words.keys)
        keys = [names[g] for g in own.tolist()]
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(owners, minlength=n))), pa.int32())
        lists = {k: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for k, v in (("groups", groups), ("times", times))}
        yield from rows(
            _DOCUMENT, n, place=pa.array(np.arange(n), pa.int64()), doc_id=pa.array(self.ids, pa.int64()),
            groups_sha256=pa.array(self.digests), **{c: pa.array(v) for c, v in counts.items()}, **lists,
        )
        yield from rows(_GROUP, len(keys), place=pa.array(np.arange(len(keys)), pa.int64()), key=pa.array(keys, pa.string()))
        # Links of each distinct group once, then the documents of each pair.
        pairs = _Numbered()
        linked = [[pairs[p] for p in _pairs(key)] for key in keys]
        start = np.append(0, np.cumsum([len(x) for x in linked], dtype=np.int64))
        (_, found), _ = _distinct(*_expanded(owners, groups, start, np.array([p for x in linked for p in x], np.int64)), len(pairs))
        ids = np.array(list(pairs), np.int32).reshape(-1, 2)
        yield from rows(_PAIR, len(pairs), a=pa.array(ids[:, 0]), b=pa.array(ids[:, 1]), n=pa.array(np.bincount(found, minlength=len(pairs)), pa.int64()))


def _pairs(key: str) -> set[tuple[int, int]]:
    a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
    return {(x, y) for x in set(a) for y in set(b)}


_WORKER: dict[tuple[str, str], PairEncoder] = {}


def align_blocks(docs: DataFrame, path_a: str, path_b: str, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Rows of three kinds: documents, the distinct groups of each block, and pairs of ids with their documents in a block."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _BLOCKS.split(", "))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _WORKER:
            _WORKER[path_a, path_b] = PairEncoder(path_a, path_b)
        words, number, block = _WORKER[path_a, path_b], TaskContext.get().partitionId() << 32, _Block()

        def read(texts: list[str]) -> list[np.ndarray]:
            pieces = [t.split(" ") for t in texts]
            words.learn(set().union(*pieces).difference(words.known))
            return [words.numbers(t, x) for t, x in zip(texts, pieces, strict=True)]

        def long(text: str) -> tuple[np.ndarray, str]:
            digest, out = hashlib.sha256(), []
            for i, part in enumerate(_stretches(text)):
                own = read([part])[0]
                if not len(own):
                    return own, ""
                digest.update((";" * (i > 0) + words.line(own)).encode())
                out.append(own)
            return np.concatenate(out), digest.hexdigest()

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                short = [t if len(t) <= _LONG else "" for t in texts]
                for key, text, own in zip(part.column(0).to_pylist(), texts, read(short), strict=True):
                    if len(text) > _LONG:
                        block.add(key, *long(text))
                    elif text and len(own):
                        block.add(key, own, hashlib.sha256(words.line(own).encode()).hexdigest())
                    else:
                        block.add(key, np.empty(0, np.int32), "")
                if block.size >= block_pieces or len(words) > _KEPT:
                    yield from block.batches(number, words, schema)
                    number, block = number + 1, _Block()
                    if len(words) > _KEPT:
                        words.forget()
        if block.ids:
            yield from block.batches(number, words, schema)

    return docs.mapInArrow(task, _BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Each linked pair of ids with the number of documents that hold it, and the greatest such number of its A id."""
    counts = blocks.where(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("most", F.max("n").over(Window.partitionBy("a")))  # a vocabulary of partners at most


def _valued(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """For each group of each block the sum of its links' counts and how many of them are their A id's best."""
    own = blocks.where(F.col("kind") == _GROUP).select("block", "place", "key")
    ids = lambda side: F.split(F.split_part("key", F.lit("|"), F.lit(side)), ",").cast("array<int>")
    links = own.select("key").distinct().select("key", F.explode(ids(1)).alias("a")).select("key", "a", F.explode(ids(2)).alias("b"))
    valued = links.join(counts, ["a", "b"]).groupBy("key").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") == F.col("most"), 1)).alias("best"))
    return own.join(valued, "key").select("block", "place", "total", "best")


def _summed(rows: DataFrame) -> DataFrame:
    """Documents with their groups' values; rows come by block, its groups first."""
    names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals, bests = None, [], []
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            block, is_doc = column["block"].to_numpy(), column["is_doc"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_doc.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                if block[a] != held:
                    held, totals, bests = block[a], [], []
                if not is_doc[a]:
                    totals.append(column["total"].slice(a, b - a).to_numpy())
                    bests.append(column["best"].slice(a, b - a).to_numpy())
                    continue
                total, best = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (totals, bests))
                totals, bests = [total], [best]
                groups, times = (column[c].slice(a, b - a) for c in ("groups", "times"))
                at, of = np.append(0, np.cumsum(np.diff(groups.offsets.to_numpy()))), groups.flatten().to_numpy()
                freq = times.flatten().to_numpy().astype(np.int64)
                sums = [np.append(0, np.cumsum(freq * v[of])) for v in (best, total)]
                own = {"n_best": pa.array(sums[0][at[1:]] - sums[0][at[:-1]]), "count_sum": pa.array(sums[1][at[1:]] - sums[1][at[:-1]])}
                yield pa.RecordBatch.from_arrays([own[n] if n in own else column[n].slice(a, b - a) for n in names], schema=schema)

    return rows.mapInArrow(task, ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names))


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per row of ``docs``: tokens, groups and links, the links that are best of their A id, and the sum of counts.

    ``path_a`` is a byte-level ``tokenizers`` file, ``path_b`` a ``sentencepiece`` model that puts a blank first, on every node.
    Texts that are null or empty, or that either tokenizer does not give back, have no tokens: zeros and ''. Every row is a
    document, so repeated rows count as often as they stand there. Extra columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = staged(align_blocks(rows, path_a, path_b, block_pieces), "aligned")
    values = _valued(blocks, pair_counts(blocks)).withColumn("is_doc", F.lit(False))
    own = blocks.where(F.col("kind") == _DOCUMENT).select("block", "place", "doc_id", *_COUNTS, "groups_sha256", "groups", "times").withColumn("is_doc", F.lit(True))
    both = values.unionByName(own, allowMissingColumns=True)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.where("place = 0").count())  # about a block each
    return _summed(both.repartition(tasks, "block").sortWithinPartitions("block", "is_doc", "place"))
