"""N-gram Jaccard join: size-banded tiles, bit-count bounds, exact sorted-array intersection.

Two sets with a Jaccard similarity of t or more differ in at most
(1 - t) / (1 + t) of their summed sizes, say D hashes. Split by hash into D + 3
segments, three segments at least are equal. So documents of one size band (and
those close below the next band) that have an equal segment become candidates, and no
link is lost. With ``most`` segments given, of sets of 64 and more only segments of
two hashes or more count (three from 200 on), and that many at most: segments of one
hash join all texts that share a common line. A pair at the very threshold then has
an equal segment with a probability of 0.9997 or more at 0.8 and 72 segments, and
nearer to 1 at 0.9 or above the threshold. Equal empty segments are passed over unless a set has three of them.
Candidates are compared in tiles: sizes first, then parity bitmaps, then the sorted
arrays. Sets that are equal are compared once.

Defined results: a document without words or text is linked with nothing; shorter
texts than a shingle count as one shingle; a null doc_id takes no part in links and
has itself (null) as its component; rows that share a doc_id are one document for
links; ties do not arise; an empty table gives an empty result; other columns are
passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, fresh, stored
from .hashing import mix, shingle_hashes, shingle_set, texts_in_parts, word_hashes
from .similar import candidate_roots, partial_stars, star_links, verified_links

WORDS, NUM, DEN = 3, 90, 100
BAND = 1.5
SPARE = 3
# A value for ``most`` where texts share many lines.
SEGMENTS = 72


def top_size(band: int) -> int:
    """Largest size of a band; band 0 holds size 1."""
    return int(BAND**band)


def band_of(size: int) -> int:
    band = max(0, int(np.log(size) / np.log(BAND)) - 1)
    while top_size(band) < size:
        band += 1
    return band


def segment_keys(s: np.ndarray, num: int, den: int, most: int | None = None) -> np.ndarray:
    """Keys of a sorted hash set: its segments in its band and, if a partner may be there, in the next one."""
    own, keys = band_of(len(s)), []
    # A partner is at most den / num times as large; small bands may all hold the same few sizes.
    last = band_of(max(1, len(s) * den // num))
    for band in range(own, last + 1):
        k = 2 * top_size(band) * (den - num) // (den + num) + SPARE
        segment = (mix(s ^ np.uint64(band + 1)) % np.uint64(k)).astype(np.intp)
        total = np.zeros(k, np.uint64)
        np.add.at(total, segment, mix(s + np.uint64(0x1234567)))
        held = np.bincount(segment, minlength=k)
        filled = held > 0
        take = np.ones(k, bool) if k - np.count_nonzero(filled) >= SPARE else filled
        if most is not None:
            least = 1 if top_size(band) < 64 else 2 if top_size(band) < 200 else 3
            take = take & (np.arange(k) < most) & ((held >= least) | (least == 1))
        at = np.flatnonzero(take).astype(np.uint64)
        keys.append(mix(mix(total[take]) + at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 0xD6E8FEB86659FD93 % 2**64)))
    return np.concatenate(keys)


def fingerprints(docs: DataFrame, k: int, num: int, den: int, most: int | None = None) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits of the set), keys: one row per document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in texts_in_parts(batch.column(1)):
                w, _, at = word_hashes(data, offsets, lower=True)
                sh = shingle_hashes(w, k)
                n, h1, h2, keys = [], [], [], []
                for i in range(b - a):
                    s = shingle_set(w, sh, at[i], at[i + 1], k)
                    n.append(len(s))
                    h1.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                    h2.append(int(np.add.reduce(mix(s ^ np.uint64(0x5555555555555555))).view(np.int64)) if len(s) else 0)
                    keys.append(segment_keys(s, num, den, most).view(np.int64) if len(s) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), pa.array(np.concatenate(keys)))
                columns = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def key_rows(prints: DataFrame) -> DataFrame:
    """(key, id, other): the first row of each key of a batch, and links of the other rows to it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), np.diff(at))
            keys = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            key, row, pairs = partial_stars(keys, rows)
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), none], names=["key", "id", "other"])
            if len(pairs):
                a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(mix(a.astype(np.uint64)).view(np.int64)), pa.array(a), pa.array(b)], names=["key", "id", "other"])

    return prints.where("doc_id is not null and n_shingles > 0").select("doc_id", "keys").mapInArrow(scan, "key long, id long, other long")


def members(docs: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """(id, root, set) of the documents in ``roots`` (doc_id, id, root)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts_in_parts(batch.column(2)):
                w, _, at = word_hashes(data, offsets, lower=True)
                sh = shingle_hashes(w, k)
                sets = [shingle_set(w, sh, at[i], at[i + 1], k).view(np.int64) for i in range(b - a)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["id", "root", "set"])

    texts = docs.select("doc_id", "text").join(roots.hint("shuffle_hash"), "doc_id")
    return texts.select("id", "root", "text").mapInArrow(scan, "id long, root long, set array<long>")


def join_components(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, most: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document. Links need den * intersection >= num * union."""
    prints = stored(fingerprints(docs, k, num, den, most), "prints")
    same = ["n_shingles", "h1", "h2"]
    full = prints.where("doc_id is not null and n_shingles > 0")
    first = stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep")), "first")
    # Hashed names have no order, as the components want; the hash of one long is one-to-one.
    name = F.xxhash64("rep")
    named = stored(full.select("doc_id", *same).join(first, same).select("doc_id", "rep", name.alias("id")), "named")
    near = star_links(key_rows(prints))
    ends = (
        near.join(named.select(F.col("doc_id").alias("id"), F.col("id").alias("a")), "id")
        .join(named.select(F.col("doc_id").alias("lead"), F.col("id").alias("b")), "lead")
        .where("a <> b")
        .select(F.col("a").alias("id"), F.col("b").alias("lead"))
        .distinct()
    )
    roots = candidate_roots(ends, "near")
    of_docs = named.where("doc_id = rep").select("doc_id", "id", "rep").distinct().join(roots, "id")
    links = verified_links(members(docs, of_docs.select("doc_id", "id", "root"), k), num, den)
    links = stored(links, "links")
    labels = components(links, "a", "b", "linked")
    discard(roots, links)
    placed = named.select("rep", "id").distinct().join(labels, "id")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = placed.join(least, "root").select("rep", "component_id")
    known = named.join(found, "rep", "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("component_id", "rep").alias("component_id")
    ).groupBy("_id").agg(F.min("component_id").alias("component_id"))
    known = stored(known, "known")
    sizes = stored(prints.select("doc_id", "n_shingles"), "sizes")
    discard(prints, first, named, labels)
    return sizes.join(known, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, most: int | None = None) -> DataFrame:
    """The documents with the smallest doc_id of their component, and those without a doc_id; all columns."""
    gone_id = fresh(docs, "_gone_id")
    gone = join_components(docs, k, num, den, most).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(gone_id), "left_anti")
