import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tagloom.llm.packing import WordEncoder, pack_documents, pack_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "Hello, World! it's 1234", "É é ñ ΣΑΣ İx ½ Ⅷ", "a\x1cb c\x85d\xa0e f\x0bg", "<|endoftext|> x", "word " * 9000, "x" * 30_000, "emoji 😀😀 !!?!",
    "don't they'll 're", *("some text %d " % i * (i % 40) for i in range(200)),
]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_against_the_tokenizer():
    e = WordEncoder(PATH)
    for text in TEXTS:
        want = array("I", tokenizer().encode(text or "", add_special_tokens=False).ids).tobytes()
        assert e.ids(text) == want == e.ids(text), text


def test_every_code_point():
    e, t = WordEncoder(PATH), tokenizer()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)} {chr(c)}1" for c in points[i : i + 1000]) for i in range(0, len(points), 1000)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        if e.ids(text) != array("I", want.ids).tobytes():
            wrong = [x for x in text.split(" ") if e.ids(x) != array("I", t.encode(x, add_special_tokens=False).ids).tobytes()]
            assert not wrong, [hex(ord(c)) for x in wrong[:9] for c in x]
            raise AssertionError(text[:9])
    for text in ("a\x01", "\x7f", "x<|startoftext|>y", "<|ENDOFTEXT|>"):
        assert e.ids(text) == array("I", t.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 1], [1] * 5000, [3000] * 50, list(np.random.default_rng(0).integers(1, 20_000, 400))])
def test_pack_lengths(lengths):
    pieces, rooms = pack_lengths([int(x) for x in lengths])
    assert sum(rooms) == sum(lengths) and all(r <= 4096 and (r == 4096 or r & (r - 1) == 0) for r in rooms)
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pieces:
        by_sequence[s].append((offset, n))
        by_document[d].append((start, n))
    for s, room in enumerate(rooms):
        at = 0
        for offset, n in sorted(by_sequence[s]):
            assert offset == at and n > 0
            at += n
        assert at == room
    for d, length in enumerate(lengths):
        at = 0
        for start, n in sorted(by_document[d]):
            assert start == at
            at += n
        assert at == length


def test_costs_are_balanced():
    lengths = [int(x) for x in np.random.default_rng(1).integers(10, 1500, 3000)]
    pieces, rooms = pack_lengths(lengths)
    costs = defaultdict(float)
    for _, _, n, s, _ in pieces:
        costs[s] += n + n * n / 4096
    full = [costs[s] for s, r in enumerate(rooms) if r == 4096]
    naive, at = defaultdict(float), 0
    for n in lengths:
        while n:
            k = min(n, 4096 - at % 4096)
            naive[at // 4096] += k + k * k / 4096
            n, at = n - k, at + k
    assert np.std(full) < 0.5 * np.std(list(naive.values()))


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int").repartition(3)
    rows = pack_documents(df, PATH, window_tokens=20_000).collect()
    for i, text in enumerate(TEXTS):
        ids = tokenizer().encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
    used = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert all(used[r.sequence_id] == r.sequence_length for r in rows)
    shorter = defaultdict(set)
    for r in rows:
        if r.sequence_length < 4096:
            shorter[r.sequence_id >> 32].add(r.sequence_id)
    assert all(len(x) <= 12 for x in shorter.values())  # one tail for each task, whatever its windows
    assert pack_documents(df.limit(0), PATH).count() == 0
    assert pack_documents(df.union(df), PATH).count() >= 2 * len(TEXTS)


def test_lowest_cost_of_all_sequences_with_room():
    lengths = [int(x) for x in np.random.default_rng(2).lognormal(4.5, 1.2, 3000)] + [3000] * 40
    pieces, rooms = pack_lengths(lengths)
    left, spent, whole = list(rooms), [0.0] * len(rooms), {}
    by_document = defaultdict(list)
    for d, start, n, s, _ in pieces:
        by_document[d].append((start, n, s))
        if n == 4096:
            left[s] = 0
    for d, p in by_document.items():
        rest = lengths[d] % 4096
        whole[d] = next((s for start, n, s in p if n == rest and start == lengths[d] - rest), None)
    for d in sorted(range(len(lengths)), key=lambda d: (-(lengths[d] % 4096), d)):
        n = lengths[d] % 4096
        open_ = [(spent[s], s) for s in range(len(rooms)) if left[s] >= n]
        assert (whole[d] is None) == (not open_) or not n
        if open_ and n:
            s = min(open_)[1]
            assert whole[d] == s
            left[s] -= n
            spent[s] += n + n * n / 4096
