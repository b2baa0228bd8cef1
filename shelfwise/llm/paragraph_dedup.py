"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, components.

A paragraph is a line of 13 words or more. Lines with the same set of 5-word
shingles form a class; classes that share a band of two MinHash values are compared
by exact Jaccard similarity (0.8 or more), and links are joined to components. Six
bands find a pair at 0.8 with a probability of 0.998, more above.

A passage that was set into other text does not make whole lines alike. So texts
are also cut at words whose 3-word hash is the smallest of its neighbourhood, which
cuts equal passages alike wherever they stand. Pieces that occur twice are joined to
spans of 13 words or more, and spans that share a piece to components.

Defined results: null and empty texts and short lines give no row; a null doc_id
takes no part; rows that share a doc_id are one document, so a repeated row is no
repeat; the first place by (doc_id, first word) of a component stays; an empty table
gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stored
from .hashing import mix, powers, shingle_hashes, texts_in_parts, word_hashes
from .similar import candidate_roots, partial_stars, star_links, verified_links
from .suffix_dedup import repeated

MIN_WORDS = 13
WORDS, NUM, DEN = 5, 80, 100
BANDS, ROWS = 6, 2
REACH = 5
PIECE = 64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_NONE = np.uint64(2**64 - 1)


def paragraphs(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of the lines with MIN_WORDS words or more."""
    breaks = np.flatnonzero(data == 10)
    # Word numbers at which a line or a text begins.
    starts = np.unique(np.concatenate([at[:-1], np.searchsorted(first, breaks), at[-1:]]))
    if len(starts) < 2:
        return (np.zeros(0, np.int64),) * 3
    a, b = starts[:-1], starts[1:]
    long = b - a >= MIN_WORDS
    a, b = a[long], b[long]
    return np.searchsorted(at, a, "right") - 1, a, b


def line_sets(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    return [np.unique(shingles[i : j - WORDS + 1]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def as_ids(h1: np.ndarray, h2: np.ndarray) -> pa.Array:
    """16-byte ids."""
    both = np.ascontiguousarray(np.stack([h1, h2], 1).astype(">u8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(h1), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def class_ids(sets: list[np.ndarray]) -> pa.Array:
    h1 = np.array([np.add.reduce(mix(s)) for s in sets], np.uint64)
    h2 = np.array([np.add.reduce(mix(s ^ np.uint64(0x5555555555555555))) for s in sets], np.uint64)
    return as_ids(h1, h2)


def lines_of(docs: DataFrame) -> DataFrame:
    """id, doc_id, start, n_words, bands: one row per paragraph."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for x, _, data, offsets in texts_in_parts(batch.column(1)):
                w, first, at = word_hashes(data, offsets)
                text, a, b = paragraphs(data, offsets, first, at)
                if not len(text):
                    continue
                sets = line_sets(shingle_hashes(w, WORDS), a, b)
                ends = np.cumsum([0, *map(len, sets)])[:-1]
                flat = np.concatenate(sets)
                low = [np.minimum.reduceat(mix(flat ^ s), ends) for s in _SEEDS]
                bands = np.stack([mix(mix(low[ROWS * i] + np.uint64(i)) * np.uint64(3) + low[ROWS * i + 1]) for i in range(BANDS)], 1)
                lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [class_ids(sets), pa.array(ids[x + text]), pa.array(a - at[text]), pa.array(b - a), lists],
                    names=["id", "doc_id", "start", "n_words", "bands"],
                )

    return docs.mapInArrow(scan, "id binary, doc_id long, start long, n_words long, bands array<long>")


def band_rows(lines: DataFrame) -> DataFrame:
    """(key, id, other): the first row of each band of a batch, and links of the other rows to it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            index: dict[bytes, int] = {}
            number = np.array([index.setdefault(i, len(index)) for i in raw], np.int64)
            classes, heads = list(index), np.unique(number, return_index=True)[1]
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)[heads]
            key, row, pairs = partial_stars(keys.reshape(-1), np.repeat(np.arange(len(classes)), BANDS))
            id_of = pa.array(classes, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), id_of.take(pa.array(row)), pa.nulls(len(key), pa.binary())], names=["key", "id", "other"])
            if len(pairs):
                spread = pa.array(mix(pairs[:, 0].astype(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([spread, id_of.take(pa.array(pairs[:, 0])), id_of.take(pa.array(pairs[:, 1]))], names=["key", "id", "other"])

    return lines.select("id", "bands").mapInArrow(scan, "key long, id binary, other binary")


def sets_of(texts: DataFrame) -> DataFrame:
    """(id, root, set) for rows (text, wanted): the first words, ids and roots of some paragraphs of a text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            for x, y, data, offsets in texts_in_parts(batch.column(0)):
                w, first, at = word_hashes(data, offsets)
                sh = shingle_hashes(w, WORDS)
                text, a, b = paragraphs(data, offsets, first, at)
                place = {(t, s - at[t]): (s, e) for t, s, e in zip(text.tolist(), a.tolist(), b.tolist(), strict=True)}
                found = [(p["id"], p["root"], place[i - x, p["start"]]) for i in range(x, y) for p in lists[i]]
                if not found:
                    continue
                own, root, spans = zip(*found, strict=True)
                sets = line_sets(sh, np.array([s for s, _ in spans]), np.array([e for _, e in spans]))
                flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(root, pa.binary()), flat], names=["id", "root", "set"])

    return texts.mapInArrow(scan, "id binary, root binary, set array<long>")


def near_lines(docs: DataFrame) -> DataFrame:
    """kind, doc_id, start, n_words, of, removed for paragraphs in components of two or more lines."""
    lines = stored(lines_of(docs), "paragraphs")
    classes = stored(lines.groupBy("id").agg(F.count_distinct("doc_id", "start").alias("n"), F.min(F.struct("doc_id", "start")).alias("place")), "line_classes")
    roots = candidate_roots(star_links(band_rows(lines)), "near_lines")
    wanted = roots.join(classes, "id").groupBy(F.col("place.doc_id").alias("of_doc")).agg(
        F.collect_list(F.struct(F.col("place.start").alias("start"), "id", "root")).alias("wanted")
    )
    texts = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("of_doc")).select("text", "wanted")
    links = stored(verified_links(sets_of(texts), NUM, DEN), "line_links")
    labels = components(links, "a", "b", "lines")
    discard(roots, links)
    placed = classes.join(labels, "id", "left").where("n > 1 or root is not null").select("id", F.coalesce("root", "id").alias("root"), "place")
    first = placed.groupBy("root").agg(F.min("place").alias("of"))
    named = stored(placed.join(first, "root").select("id", "of"), "line_components")
    discard(classes, labels)
    return lines.join(named, "id").select(
        F.lit("paragraph").alias("kind"), "doc_id", "start", "n_words", "of", (F.struct("doc_id", "start") != F.col("of")).alias("removed")
    ).distinct()


def piece_rows(docs: DataFrame) -> DataFrame:
    """(key, run, rid, pos) of the pieces of each text; pos holds the first word and the number of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for x, y, data, offsets in texts_in_parts(batch.column(1)):
                w, _, at = word_hashes(data, offsets)
                if len(w) < 3:
                    continue
                text = np.repeat(np.arange(y - x), np.diff(at))
                three = np.full(len(w), _NONE)
                three[:-2] = shingle_hashes(w, 3)
                last = at[text + 1]
                three[np.arange(len(w)) + 3 > last] = _NONE
                # Texts stand apart by REACH places, so that no text sees its neighbours.
                place = np.arange(len(w)) + REACH * (text + 1)
                row = np.full(len(w) + REACH * (y - x + 2), _NONE)
                row[place] = three
                low = np.minimum.reduce([row[i : len(row) - 2 * REACH + i] for i in range(2 * REACH + 1)])
                cut = np.flatnonzero((three == low[place - REACH]) & (three != _NONE))
                if len(cut) < 2:
                    continue
                a, b = cut[:-1], cut[1:]
                inside = text[a] == text[b]
                a, b = a[inside], b[inside]
                if not len(a):
                    continue
                # Long pieces are cut again at fixed steps from their first word.
                times = -(-(b - a) // PIECE)
                step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                start = np.repeat(a, times) + PIECE * step
                end = np.minimum(np.repeat(b, times), start + PIECE)
                n = end - start
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                value = w[np.repeat(start, n) + inner] * powers(PIECE)[inner]
                key = mix(np.add.reduceat(value, np.cumsum(n) - n) + n.astype(np.uint64)).view(np.int64)
                own = text[start]
                columns = [key, np.zeros(len(key), np.int64), ids[x + own], (start - at[own]) * 128 + n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "run", "rid", "pos"])

    return docs.mapInArrow(scan, "key long, run long, rid long, pos long")


def passages(docs: DataFrame) -> DataFrame:
    """kind, doc_id, start, n_words, of, removed for spans of repeated pieces."""
    from pyspark.sql import Window as W

    pieces = repeated(piece_rows(docs), with_key=True).where("not open").select(
        F.col("rid").alias("doc_id"), F.expr("pos div 128").alias("start"), (F.col("pos") % 128).alias("n"), "key"
    )
    by_doc = W.partitionBy("doc_id").orderBy("start")
    goes_on = F.lag(F.col("start") + F.col("n")).over(by_doc) == F.col("start")
    begun = pieces.withColumn("head", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("start")))
    spans = begun.withColumn("head", F.last("head", ignorenulls=True).over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    total = F.sum("n").over(W.partitionBy("doc_id", "head"))
    held = stored(spans.withColumn("n_words", total).where(F.col("n_words") >= MIN_WORDS), "spans")
    name = lambda *c: F.unhex(F.md5(F.concat_ws(":", *[F.col(x).cast("string") for x in c])))
    keys = held.select(name("doc_id", "head").alias("span"), name("key").alias("piece"), F.struct("doc_id", F.col("head").alias("start")).alias("place"))
    # Each span is linked to the first span of each of its pieces, which a count before the shuffle finds.
    firsts = keys.groupBy("piece").agg(F.min("span").alias("lead"))
    links = keys.join(firsts, "piece").where("span <> lead").select(F.col("span").alias("a"), F.col("lead").alias("b")).distinct()
    labels = components(links, "a", "b", "span_links")
    own = held.groupBy("doc_id", "head", "n_words").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("key").alias("kinds"))
    own = own.withColumn("span", name("doc_id", "head")).withColumn("place", F.struct("doc_id", F.col("head").alias("start")))
    named = stored(own.join(labels.withColumnRenamed("id", "span"), "span", "left").withColumn("root", F.coalesce("root", "span")), "named_spans")
    first = named.groupBy("root").agg(F.min("place").alias("of"), F.count(F.lit(1)).alias("members"))
    # A span alone in its component repeats itself or pieces of spans that were too short.
    return named.join(first, "root").where("members > 1 or kinds < pieces").select(
        F.lit("passage").alias("kind"), "doc_id", F.col("head").alias("start"), "n_words", "of", (F.col("place") != F.col("of")).alias("removed")
    )


def repeated_parts(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start_word, n_words, of_doc, of_word, removed: one row per repeated paragraph or passage.

    (of_doc, of_word) is the first place of its component; that one is not removed.
    """
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = near_lines(texts).union(passages(texts))
    return found.select(
        "doc_id", "kind", F.col("start").alias("start_word"), F.col("n_words").cast("long").alias("n_words"),
        F.col("of.doc_id").alias("of_doc"), F.col("of.start").alias("of_word"), "removed",
    )
