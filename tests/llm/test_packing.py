import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from shelfwise.llm import packing


def plain_ids(text):
    return Tokenizer.from_file(packing.vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, pieces):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text, _ in rows:
        ids, at = plain_ids(text), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            part = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    for of in by_sequence.values():
        at = 0
        for p in sorted(of, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0  # full or a power of two: nothing is padded
    return by_sequence


def test_pieces_hold_every_id_once(docs_of, odd_rows):
    rows = [r for i, r in enumerate(odd_rows) if r[0] not in (None, 6)]
    rows += [
        (30, "It's <|endoftext|> here", "a"), (31, "ŒUVRE ²½ don't 'LL ''s !'s ½x 123 Straße x́ ﬁn", "a"),
        (32, "İstanbul Ωmega 東京 ok_ok A'S \x85 ª º µ", "b"), (33, "x" * 5000, "b"), (34, "a b " * 9000, "c"),
    ]
    check(rows, packing.pack(docs_of(rows, extra=True).repartition(3)).collect())


def test_one_sequence_is_full_when_there_is_enough(docs_of):
    rows = [(i, "word " * (137 * i % 3000), "s") for i in range(60)]
    sequences = check(rows, packing.pack(docs_of(rows).coalesce(1)).collect())
    lengths = sorted(sum(p.length for p in s) for s in sequences.values())
    assert sum(n == 4096 for n in lengths) >= sum(lengths) // 4096 - 12


def test_a_class_fills_its_sequences_with_whole_documents_and_one_cut(docs_of):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(n), "s") for i, n in enumerate(rng.integers(5, 3000, 400))]
    pieces = packing.pack(docs_of(rows).coalesce(1)).collect()
    sequences = check(rows, pieces)
    full = [s for s in sequences.values() if sum(p.length for p in s) == 4096]
    fixed = 0
    for s in full:
        whole = [p for p in s if p.length + p.start == p.doc_tokens]
        last = max(s, key=lambda p: p.offset)
        classes = {4096 // p.length for p in s if p is not last or p in whole}
        fixed += len(classes) == 1 and len(s) - 1 <= classes.pop() <= len(s)
    assert fixed >= 0.8 * len(full)
    # One cut per sequence, and few crumbs.
    assert len(pieces) <= len(rows) + len(sequences)
    assert sum(p.length <= 16 for p in pieces) <= 0.05 * len(pieces)


def test_every_low_character_in_every_surrounding():
    encoder = packing.Encoder(packing.vocabulary_path())
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    around = [("", ""), ("a", "b"), ("A", " "), ("東", "京"), ("東 ", "b"), ("'", "s"), ("é", "1"), ("x'", "ll"), ("\u2003", "ﬁ")]
    texts = [a + chr(c) * n + b for c in range(0x101) for n in (1, 2) for a, b in around]
    texts += [chr(c) for c in (0x1680, 0x2000, 0x2028, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF)] + [f"a{chr(c)}b" for c in (0x1680, 0x2000, 0x2028, 0x3000, 0xFEFF)]
    for text, got in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_forgetting_words_changes_nothing(monkeypatch):
    small, large = packing.Encoder(packing.vocabulary_path(), 3), packing.Encoder(packing.vocabulary_path())
    text = "some words come back and some words do not come back at all " * 3
    for _ in range(2):
        assert small.ids([text, "more"])[0] == large.ids([text])[0] == np.array(plain_ids(text)[:-1], "<u4").tobytes()


def test_repeated_rows_nulls_and_ids(docs_of):
    out = packing.pack(docs_of([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)]), with_ids=True).collect()
    assert sorted(r.doc_tokens for r in out if r.start == 0) == [1, 3, 3]
    assert all(len(r.ids) == r.length for r in out)
    assert packing.pack(docs_of([])).count() == 0


def test_remembered_words_stay_bounded_within_a_batch():
    encode = packing.Encoder(packing.vocabulary_path(), known=3)
    texts = ["one two three four five six seven", "seven one eight"]
    assert encode.ids(texts) == packing.Encoder(packing.vocabulary_path()).ids(texts)
    assert len(encode) <= 3
