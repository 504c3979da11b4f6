import base64
import hashlib

import numpy as np
import pytest

from tagloom.llm.minhash import edited_text, fingerprint_documents, likeness, packed, sketch, unpacked
from tagloom.llm.words import shingle_hashes, word_hashes, words_of

DOCS = "doc_id long, text string, fingerprint string"


def jaccard(a, b):
    a, b = set(shingle_hashes(a).tolist()), set(shingle_hashes(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def text(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10_000, n))


@pytest.mark.parametrize("value", ["", "  ", "a", "A b", "a b c d e", "a b c d e f a b c d e", "É é x\x0by\x85z", "x" * 70 + " " + "X" * 70, "w " * 300_000])
def test_words_and_shingles(value):
    words = words_of(value)
    h = word_hashes(value).tolist()
    assert len(h) == len(words) and len(set(h)) == len(set(words)) == len(set(zip(words, h, strict=True)))
    width = min(5, len(words))
    expected = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    assert len(shingle_hashes(value)) == len(expected)


def test_likeness_is_near_jaccard():
    errors = []
    for n in (8, 60, 300, 2000):
        for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
            a = text(n, n)
            k = int(n * share)
            b = " ".join(a.split()[:k]) + " " + text(n + 1, n - k)
            errors.append(likeness(sketch(shingle_hashes(a)), sketch(shingle_hashes(b))) - jaccard(a, b))
    assert np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("n", [1, 2, 7, 40, 300, 5000])
@pytest.mark.parametrize(("bins", "bits"), [(512, 4), (64, 2), (8, 1)])
def test_sketch_against_bin_by_bin(n, bins, bits):
    """Bins filled one hash at a time; an empty bin looks through its own fixed order of all bins, drawn as the module states."""
    hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
    least = {}
    for h in hashes.tolist():
        place, value = h % bins, h // bins
        least[place] = min(value, least.get(place, value))
    draws = np.random.default_rng(20_240_229).random((bins, bins)).tolist()
    want = []
    for i in range(bins):
        order = sorted(range(bins), key=lambda b: draws[i][b])
        assert sorted(order) == list(range(bins))
        source = i if i in least else next(b for b in order if b in least)
        want.append(least[source] % 2**bits)
    got = sketch(hashes, bins, bits)
    assert got.tolist() == want
    text_ = "".join(f"{x:0{bits}b}" for x in want)
    assert base64.b64decode(packed(got, bits)) == bytes(int(text_[k : k + 8], 2) for k in range(0, len(text_), 8))


def test_densified_bins_agree_as_often_as_the_sets_do():
    """Few shingles in many bins: agreement of the sketches, without the bias, is the sets' similarity on average."""
    draw, found, real = np.random.default_rng(12), [], []
    for _ in range(300):
        pool = draw.integers(0, 1 << 64, 60, dtype=np.uint64, endpoint=False)
        a, b = np.sort(pool[:50]), np.sort(pool[10:])
        found.append((np.mean(sketch(a) == sketch(b)) - 1 / 16) / (1 - 1 / 16))
        real.append(40 / 60)
    assert abs(np.mean(found) - np.mean(real)) < 0.02


def test_packing_round_trip():
    low = sketch(shingle_hashes(text(1, 100)))
    assert (unpacked(packed(low)) == low).all() and packed(None) == "" and unpacked("") is None
    assert likeness(None, None) == 1 and likeness(None, low) == 0


def expected(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = {}
    for i, r in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        own = r[1] or ""
        edited = edited_text(own, following)
        s = [sketch(shingle_hashes(x)) for x in (own, edited, following)]
        out.setdefault(r[0], []).append((len(own), hashlib.sha256(edited.encode()).hexdigest(), packed(s[0]), packed(s[1]), likeness(s[0], s[1]), likeness(s[0], s[2])))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_against_brute_force(spark, n):
    rows = [(i * 7 % 101, text(i // 2, 3 + i * 5 % 90) + "é😀", "clash") for i in range(n)]
    if n > 2:
        rows += [(5, None, ""), (5, "", ""), (None, "no id", ""), (3, text(3, 20_000), "")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {}
    for r in fingerprint_documents(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    want = expected(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_least_id_is_no_null_id(spark):
    least = -(1 << 63)
    rows = [(least, "a b c d e f", None), (None, "g h i j k l", None), (5, "m n o p q r", None)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    sha = lambda a, b: hashlib.sha256(edited_text(a, b).encode()).hexdigest()
    assert got == {5: sha(rows[2][1], rows[0][1]), least: sha(rows[0][1], rows[1][1]), None: sha(rows[1][1], rows[2][1])}
