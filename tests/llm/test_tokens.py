import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cases import corpus, frame, with_edges
from twinloom.llm.bpe_index import Vocabulary, encode_and_decode, encode_pieces
from twinloom.llm.vector_packing import Capacity, Tokenizer, best_fit, pack_documents, token_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))

HARD = [
    "  two  spaces   three ", "tab\tand\r\nline\n\n\nlines", "it's they'll 'S 's", "aaaaaaaaaaaaaaaaaaaa ananananan", "<|endoftext|> inside<|endoftext|>",
    "日本語のテキスト 한국어 🎉🎉", "é ́x", "nbsp here  wide  line", "12345 6 7,8.9 -- ... !!!", "\x1c\x1d control \x00 zero", " ", "\n",
    "<|startoftext|>X<|ENDOFTEXT|>", "İstanbul ΣΑΣ ǅ", " leading", "x \n y", "​﻿",
]


def rows():
    return with_edges(corpus(1, 12)) + [(7000 + k, t) for k, t in enumerate(HARD)]


def test_ids_and_text_like_the_library(spark):
    library = tokenizers.Tokenizer.from_file(BYTES)
    got = encode_and_decode(frame(spark, rows(), "ids IDS2 decoded"), BYTES).collect()
    assert len(got) == len(rows())
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want, r.text
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode_and_decode(frame(spark, []), BYTES).collect() == []


def test_index_on_random_pieces():
    library = tokenizers.Tokenizer.from_file(BYTES)
    vocabulary = Vocabulary(open(BYTES, "rb").read())
    rng = random.Random(0)
    pieces = ["".join(rng.choice("anetho") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    ids = encode_pieces(vocabulary, [p.encode() for p in pieces])
    for p, got in zip(pieces, ids):
        assert got.tolist() == library.encode(p, add_special_tokens=False).ids
    assert encode_pieces(vocabulary, []) == []


def test_ids_of_random_strings_like_the_library():
    """Letters whose lower case has marks, marks, joiners, scripts and punctuation, in any order."""
    library = tokenizers.Tokenizer.from_file(WORDS)
    rng = random.Random(7)
    letters = ["a", "B", "é", "İ", "I", "ı", "ß", "ẞ", "Σ", "ǅ", "ŉ", "ﬁ", "Ꭰ", "日", "ก", "ா", "\u0307", "\u0301", "\u200d", "\u00ad", "🎉", "٣", "7", "K", "Å"]
    signs = list(".,;:!?-_'\"()[]/@#&*+=~`$%^|<>\\") + ["…", "«", "—", " ", " ", "\n", "\u00a0"]
    texts = ["İ-", "İ_", "İ,", "İ?", "Das ist İ-Test İ."]
    texts += ["".join(rng.choice(letters if rng.random() < 0.6 else signs) for _ in range(rng.randint(1, 14))) for _ in range(12_000)]
    mine = Tokenizer(WORDS).ids(texts)
    differ = [t for t, got in zip(texts, mine) if np.frombuffer(got, "<u4").tolist() != library.encode(t, add_special_tokens=False).ids]
    assert differ == []


def test_plain_words_do_not_take_the_whole_library():
    """Words, digits and signs of characters of up to two bytes are cut here; only the merges are the library's."""
    tokenizer = Tokenizer(WORDS)
    library, tokenizer.library = tokenizer.library, None
    texts = ["", " ", "Größe: 12,50 kg", "¿Qué?\tÇa--va (naïve)...\r\nA1b2²½ ŸŒſŉ", "x<y | z", "«ÀÉÎ» 7--8", "Привет, Мир! Ελλάς; שלום"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("aBéÖñß7 \n.,-<ſµª²¼×") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text, got in zip(texts, tokenizer.ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_character_of_two_bytes_like_the_library():
    """Alone, in words, before marks and signs: classes and lower case are the library's."""
    library = tokenizers.Tokenizer.from_file(WORDS)
    texts = [f"{c} a{c}b {c}{c}1{c}- {c}, A{c}\u0301 {c}\u0331 ({c})" for c in map(chr, range(0x800))]
    mine = Tokenizer(WORDS).ids(texts)
    differ = [t for t, got in zip(texts, mine) if np.frombuffer(got, "<u4").tolist() != library.encode(t, add_special_tokens=False).ids]
    assert differ == []


def test_forgotten_parts_of_texts_are_encoded_again(monkeypatch):
    """Chunks that are cut and chunks that are not, in any order, with room for few of them."""
    from twinloom.llm import vector_packing

    monkeypatch.setattr(vector_packing, "KNOWN_CHUNKS", 60)
    library, tokenizer = tokenizers.Tokenizer.from_file(WORDS), Tokenizer(WORDS)
    rng = random.Random(5)
    letters = [*"abAB  \t\n\x1c\x85\u00a0\u00ad\x0b'stre 1.<|\u0130\u0331\u2003\u0117\u0180", "<|endoftext|>", "<|ENDOFTEXT|>", " don't", "\u65e5"]
    for _ in range(200):
        texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(10))]
        for text, got in zip(texts, tokenizer.ids(texts)):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert tokenizer.ids([]) == []


def test_pieces_like_the_library(spark):
    library = tokenizers.Tokenizer.from_file(WORDS)
    texts = defaultdict(set)
    for i, t in rows():
        texts[i].add(t)
    found = defaultdict(list)
    for r in token_pieces(frame(spark, rows()), WORDS, most=64, with_ids=True).collect():
        found[r.doc_id].append(r)
    for i, options in texts.items():
        want = set()
        for t in options:
            ids = library.encode(t or "", add_special_tokens=False).ids + [0]
            for k, at in enumerate(range(0, len(ids), 64)):
                part = ids[at : at + 64]
                want.add((k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), tuple(part)))
        assert {(r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found[i]} == want


def test_packing_is_gapless_and_tight(spark):
    got = pack_documents(frame(spark, rows()), WORDS, Capacity(256, 256, 256 * 256)).collect()
    assert len({(r.doc_id, r.piece) for r in got if r.doc_id}) <= len(got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 256) + 2
    assert pack_documents(frame(spark, []), WORDS).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    for capacity in (Capacity(128, 4, 128 * 128), Capacity(128, 500, 6000 + 99 * 99), Capacity(100, 100, 10_000)):
        bins, offsets = best_fit(lengths, capacity, (1.0, 0.1, 0.1), rule)
        for b in np.unique(bins):
            mine = lengths[bins == b]
            assert mine.sum() <= capacity.tokens and len(mine) <= capacity.documents and (mine**2).sum() <= capacity.attention
            assert sorted(offsets[bins == b].tolist()) == (np.cumsum(mine[np.argsort(offsets[bins == b])]) - mine[np.argsort(offsets[bins == b])]).tolist()
    with pytest.raises(ValueError):
        best_fit(np.array([200]), Capacity(128))
    assert len(best_fit(np.array([], dtype=np.int64), Capacity())[0]) == 0


def test_forgotten_chunks_are_encoded_again(monkeypatch):
    """With room for few chunks the ids and texts stay those of the library."""
    from twinloom.llm import bpe_index

    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = tokenizers.Tokenizer.from_file(file)
    monkeypatch.setattr(bpe_index, "KNOWN_PIECES", 50)
    with open(file, "rb") as content:
        encoder = bpe_index.Encoder(content.read())
    rng = random.Random(4)
    letters = [*"ab  \t\n\x1c\x85'stre 1\u0130\u2003", "<|endoftext|>", " don't", "\u65e5"]
    for _ in range(40):
        texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(20))]
        ids, offsets = encoder.encode(texts)
        for text, begin, end in zip(texts, offsets[:-1], offsets[1:]):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[begin:end].tolist() == want
            assert encoder.decode(ids[begin:end]) == tokenizer.decode(want, skip_special_tokens=False)
        assert len(encoder.numbers) <= 50
