import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tagloom.llm import alignment
from tagloom.llm.alignment import PairEncoder, align_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "word", "Hello, World! it's 1234", "a  b   c\n\n  d \n e\t f", " leading", "trailing ", "new\nline\r\nother", "É é ñ ΣΑΣ İx ½ Ⅷ",
    "▁ spelt", "x <0x0A> <s> </s> <|endoftext|> <unk>", "emoji 😀😀👩‍👩‍👧 !!?!", "日本語 のテキスト", "a b   c d  e", "\x00\x1c x\x1d \x1fy", "don't they'll 're 'S",
    "unbreakable" * 300, "the cat " * 50, "́ x ́", "​ ᠎ z", "=" * 777, "0123456789 000 1 22",
]


def brute(texts):
    """Whole texts through both tokenizers, all links of all documents."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    visible = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    hidden = [x for x in range(256) if x not in visible]
    byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}
    docs = []
    for text in texts:
        a = ta.encode(" " + (text or ""), add_special_tokens=False).ids
        b = tb.encode(text or "")
        ends, spelt = [], []
        for tokens in ([bytes(byte[c] for c in ta.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tb.id_to_piece(i)]]):
            at, own = 0, []
            for t in tokens:
                at += len(t)
                own.append(at)
            ends.append(own)
            spelt.append(b"".join(tokens))
        if not text or spelt[0] != spelt[1] or spelt[0] != (" " + text).encode():
            docs.append([])
            continue
        common = sorted(set(ends[0]) & set(ends[1]))
        docs.append([([i for i, e in zip(a, ends[0], strict=True) if low < e <= high], [i for i, e in zip(b, ends[1], strict=True) if low < e <= high]) for low, high in zip([0, *common], common, strict=False)])
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in docs]
    count = Counter(p for x in links for p in set(x))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, (groups, own) in enumerate(zip(docs, links, strict=True)):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        sizes = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own)
        out.append((i, *sizes, sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("block_pieces", [2_000_000, 5])
def test_against_brute_force(spark, block_pieces):
    draw = random.Random(3)
    words = [w for t in TEXTS if t for w in t[:60].split(" ")] + ["the", "of", "and", "Étude", "thereof"]
    texts = TEXTS + [draw.choice(["", " "]).join("x") + draw.choice([" ", "  ", "\n", " \n"]).join(draw.choices(words, k=draw.randrange(1, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int, n_a int").repartition(3)
    found = align_documents(docs, A, B, block_pieces=block_pieces)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect())) == brute(texts)


def test_very_long_texts_and_forgotten_pieces(monkeypatch):
    texts = ["some words  and \n more " * 40, "x" * 300 + " y" * 200, "▁ lost " + "z " * 100]
    want = brute(texts)
    monkeypatch.setattr(alignment, "_LONG", 64)
    words = PairEncoder(A, B)
    for text, row in zip(texts, want, strict=True):
        out = []
        for part in alignment._stretches(text):
            words.learn({p for p in part.split(" ") if p not in words.known})
            own = words.numbers(part, part.split(" "))
            out.append(words.line(own) if len(own) else None)
        if None in out:
            assert row[1] == 0
        else:
            assert hashlib.sha256(";".join(out).encode()).hexdigest() == row[-1]
    assert len(words)
    words.forget()
    assert not len(words)


def test_random_strings_by_pieces():
    draw = random.Random(11)
    signs = "aA eé \n\t'1,!ß日😀  　 \x1f́"
    texts = ["".join(draw.choices(signs, k=draw.randrange(1, 30))) for _ in range(3000)]
    words = PairEncoder(A, B)
    for text, row in zip(texts, brute(texts), strict=True):
        words.learn({p for p in text.split(" ") if p not in words.known})
        own = words.numbers(text, text.split(" "))
        written = hashlib.sha256(words.line(own).encode()).hexdigest() if len(own) else ""
        assert written == row[-1], repr(text)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None)], "doc_id long, text string")
    rows = align_documents(docs, A, B).collect()
    once = next(r for r in rows if r.doc_id is None)
    assert len(rows) == 4 and once.count_sum == 3 * once.n_links
    assert sum(r.doc_id == 1 for r in rows) == 2
    assert align_documents(docs.limit(0), A, B).count() == 0
    assert [r.count_sum for r in align_documents(docs.where("text is null"), A, B).collect()] == [0]
