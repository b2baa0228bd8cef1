"""Harmonic packing of token sequences.

A document's ids are cut into full sequences and a rest. A rest of length r belongs to
class m = capacity div r, so that its length lies above capacity / (m + 1) and m rests
fit into a sequence. A class fills its sequences with exactly m whole rests each. What
they leave free is shorter than any rest of the class, so the head of the next rest
fills it to the last token, and the tail of that one goes on to its own class: at most
one cut per sequence, and no padding. There are fewer than 2 sqrt(capacity) classes,
and every task fills its own sequences without knowing the others. The sequences that a
task leaves open are joined at its end, and the last of them is cut to lengths that
are powers of two, which need no padding.

Defined results: a null or empty text has the end id only; repeated rows are packed
each; a null doc_id is kept as null; ties do not arise, as rows are packed in the
order of their task; an empty table gives an empty result; other columns are passed
over. Words in the vocabulary's own end marks are taken as the tokenizer takes them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 4096
END_ID = 2
KNOWN_TOKENS = 1_000_000
BATCH_TEXTS = 256

# The vocabulary's word rule on lower-case Latin-1 text, and the white space below U+0100.
_BLANKS = "\t-\r \x85\xa0"
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
_BLANK = re.compile(rf"[{_BLANKS}]+")
_MARKS = ("<|startoftext|>", "<|endoftext|>")

# The vocabulary spells bytes as letters: printable ones as themselves, the others as the letters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTABLE)}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes.

    The vocabulary drops white space and never joins two words, so texts of Latin-1
    characters are split by its rule and each word is looked up; new words are merged
    by the vocabulary's own merge rules. Other words go to the tokenizer whole. The number of
    remembered words is bounded; forgetting changes nothing but the time.
    """

    def __init__(self, path: str, known: int = KNOWN_TOKENS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.known = Tokenizer.from_file(path), known
        self.merges = self.tokenizer.model

    def words(self, text: str) -> list[str]:
        """Strings that can be encoded one by one."""
        if any(m in text for m in _MARKS):
            return [text]
        if text.isascii() or max(text) < "Ā":
            return _TOKEN.findall(text.lower())
        return [x for w in _BLANK.split(text) if w for x in (_TOKEN.findall(w.lower()) if max(w) < "Ā" else [w])]

    def encoded(self, word: str) -> list[int]:
        """A lower-case Latin-1 word needs the vocabulary's merges only; other strings need all steps of the tokenizer."""
        if word.isascii() or max(word) < "Ā":
            if not any(m in word for m in _MARKS):
                spelled = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                return [t.id for t in self.merges.tokenize(spelled)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.known:
            self.clear()
        self[word] = found = array("I", self.encoded(word)).tobytes()
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, self.words(t))) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Bins:
    """The open sequence of each class in one task. A piece is (doc_id, start, tokens of its document, its ids as bytes)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, tuple[list[tuple], int]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        """Rows of the sequences that this piece completes; it may be of any length."""
        doc_id, start, tokens, data = piece
        rows, wide = [], 4 * self.capacity
        full = len(data) // wide
        for i in range(full):
            rows += self.close([(doc_id, start + i * self.capacity, tokens, data[i * wide : (i + 1) * wide])])
        if full:
            piece = doc_id, start + full * self.capacity, tokens, data[full * wide :]
        while piece[3]:
            length = len(piece[3]) // 4
            m = self.capacity // length
            held, used = self.open.pop(m, ([], 0))
            if len(held) < m:
                held.append(piece)
                used += length
                if used == self.capacity:
                    rows += self.close(held)
                else:
                    self.open[m] = held, used
                break
            head, piece = self.cut(piece, self.capacity - used)
            rows += self.close([*held, head])
        return rows

    @staticmethod
    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, tokens, data = piece
        return (doc_id, start, tokens, data[: 4 * n]), (doc_id, start + n, tokens, data[4 * n :])

    def close(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for doc_id, start, tokens, data in pieces:
            length = len(data) // 4
            rows.append((doc_id, start, length, zlib.crc32(data), tokens, data, self.next, offset))
            offset += length
        self.next += 1
        return rows

    def rest(self) -> list[tuple]:
        """The open sequences, longest pieces first, as full sequences and a last one cut at powers of two."""
        left = sorted((p for held, _ in self.open.values() for p in held), key=lambda p: len(p[3]))
        total, rows = sum(len(p[3]) // 4 for p in left), []
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> b & 1]
        for size in sizes:
            taken = []
            while size:
                piece = left.pop()
                if len(piece[3]) > 4 * size:
                    piece, more = self.cut(piece, size)
                    left.append(more)
                taken.append(piece)
                size -= len(piece[3]) // 4
            rows += self.close(taken)
        self.open = {}
        return rows


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place, CRC of its ids, and its sequence and offset; ``with_ids`` adds the ids.

    There is no shuffle: a task packs the documents it reads. ``capacity`` is a
    power of two. A sequence number holds the task's number in its upper bits.
    """
    path = path or vocabulary_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 36)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            # doc_id, start, length, crc, tokens, ids, sequence, offset
            keep = [*columns[:5], *columns[-2:]]
            arrays = [pa.array(c, pa.int64()) for c in keep]
            if not with_ids:
                return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([*arrays, lists], names=[*_ARROW.names, "ids"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                rows = []
                held = [t or "" for t in texts.slice(at, BATCH_TEXTS).to_pylist()]
                for doc_id, data in zip(ids[at : at + BATCH_TEXTS], encode.ids(held), strict=True):
                    data += END_ID.to_bytes(4, "little")
                    rows += bins.add((doc_id, 0, len(data) // 4, data))
                if rows:
                    yield made(rows)
        if rows := bins.rest():
            yield made(rows)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA + (", ids array<int>" if with_ids else ""))
