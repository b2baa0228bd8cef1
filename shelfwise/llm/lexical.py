"""Ranked lexical search with geometric blocks per term.

One pass over the documents keeps, for every document, its length and its counts of
the terms that the items ask for; lengths and document frequencies come from that
table. The search then goes over tiles of documents. In a tile each term's posting
list is clustered by the similarity of its documents' vectors, and every cluster (a
block) gets a summary: the coordinatewise maximum of its documents. An item's weights
times a summary bound the scores of all documents of the block from above, in exact
integers. Blocks are scored from the highest bound down until the next bound lies
below the item's worst kept score, so what is skipped can't enter the list.

A sample of the documents is searched first; its k-th best scores are lower bounds for
all the others, which lets most blocks of most tiles go at once. The sample's size
changes the time only.

Defined results: a null text has no terms and does not count among the documents; rows
that share a doc_id are documents each, a null doc_id comes last among equal scores;
rows that share an item_id (null is an id of its own) are one item with the terms of
all; an item without terms, or with terms that no document holds, has no rows; empty
tables give an empty result; other columns are passed over. Terms meet by 64-bit hashes.

Items are taken in groups of at most ``GROUP_TERMS`` different terms (or one item), whose
term hashes and weights go to every task: 16 bytes a term.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import discard, stored
from .hashing import texts_in_parts, word_hashes

TOP = 50
GROUP_TERMS = 1 << 18
QUERY_TERMS = 2048
TILE_DOCS = 4096
TILE_CELLS = 1 << 24
BLOCK_DOCS = 32
SKETCH = 16
SAMPLE_DOCS = 50_000
FIRST_BLOCKS = 8

#: Bytes of terms: ASCII letters and digits and all of multi-byte characters.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


# ---------------------------------------------------------------- items and counts


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the sorted hashes of each item's different terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts_in_parts(batch.column(1)):
                h, _, at = word_hashes(data, offsets, True, TERM_BYTE)
                lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.cast(pa.list_(pa.int64()))], names=["item_id", "terms"])

    each = items.select("item_id", "text").mapInArrow(scan, "item_id long, terms array<long>")
    return each.select("item_id", F.explode("terms").alias("t")).distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("t")).alias("terms"))


def groups(items: DataFrame, most: int = GROUP_TERMS) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The items in runs with at most ``most`` different terms, or of one item."""
    run, held = [], set()
    for row in items.orderBy("item_id").toLocalIterator():
        terms = np.array(row["terms"], np.int64)
        more = held | set(row["terms"])
        if run and len(more) > most:
            yield run
            run, more = [], set(row["terms"])
        run.append((row["item_id"], terms))
        held = more
    if run:
        yield run


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf): each document's length and its counts of the vocabulary's terms, by their place in it."""
    schema = "doc_id long, n long, terms array<int>, tf array<long>"
    v = len(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts_in_parts(batch.column(1)):
                h, _, at = word_hashes(data, offsets, True, TERM_BYTE)
                h = h.view(np.int64)
                place = np.minimum(np.searchsorted(vocabulary, h), v - 1)
                hit = np.flatnonzero(vocabulary[place] == h)
                key, tf = np.unique((np.searchsorted(at, hit, "right") - 1) * v + place[hit], return_counts=True)
                ends = np.searchsorted(key, np.arange(b - a + 1) * v)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(key % v, pa.int32()), pa.array(tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at), pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def weights(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, weight of each term of the vocabulary)."""
    with_terms = counts.where("n > 0")
    total = with_terms.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(size, np.int64)
    for row in with_terms.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[row["t"]] = row["count"]
    return total["docs"], total["terms"] or 0, np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n docs) div terms, for each posting."""
    if 50 * docs * int(n.max(initial=0)) < 2**62:
        m = 50 + (50 * docs * n) // terms
    else:
        m = np.array([min(50 + 50 * docs * int(x) // terms, 2**53) for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


# ---------------------------------------------------------------- the blocks of a tile


class Tile:
    """Documents of a tile as rows of impacts over the terms of some items, with blocks per term."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, impact: np.ndarray, weight: np.ndarray, n_rows: int, block_docs: int = BLOCK_DOCS):
        v = len(weight)
        self.vectors = np.zeros((n_rows, v), np.float32)
        self.vectors[rows, cols] = impact  # below 10^6, exact
        useful = weight[cols] > 0
        rows, cols = rows[useful], cols[useful]
        if n_rows <= block_docs:
            # All lists lie within one block.
            self.summaries = self.vectors.max(axis=0, keepdims=True)
            held = np.unique(cols)
            self.first = np.zeros(v, np.int64)
            self.last = np.isin(np.arange(v), held).astype(np.int64)
            self.starts, self.docs = np.array([0, n_rows]), np.arange(n_rows)
            return
        order = np.lexsort((rows, cols))
        rows, cols = rows[order], cols[order]
        begin = np.searchsorted(cols, np.arange(v + 1))
        block = np.zeros(len(rows), np.int64)
        sketch = self.sketches(weight)
        self.first, self.last = np.zeros(v, np.int64), np.zeros(v, np.int64)
        made = 0
        for t in np.flatnonzero(np.diff(begin)):
            a, b = begin[t], begin[t + 1]
            own = self.clusters(sketch[rows[a:b]], -(-(b - a) // block_docs))
            block[a:b] = made + own
            self.first[t], made = made, made + int(own.max()) + 1
            self.last[t] = made
        order = np.argsort(block, kind="stable")
        self.docs, block = rows[order], block[order]
        self.starts = np.searchsorted(block, np.arange(made + 1))
        self.summaries = np.zeros((made, v), np.float32)
        for i in range(made):
            np.max(self.vectors[self.docs[self.starts[i] : self.starts[i + 1]]], axis=0, out=self.summaries[i])

    def sketches(self, weight: np.ndarray) -> np.ndarray:
        """Directions of the weighted vectors in a few random dimensions."""
        axes = np.random.default_rng(11).normal(size=(len(weight), SKETCH)).astype(np.float32)
        s = self.vectors @ (axes * weight[:, None].astype(np.float32))
        return s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def clusters(sketch: np.ndarray, n: int) -> np.ndarray:
        """Cluster numbers without gaps: the nearest of n documents that are spread over the list."""
        if n <= 1:
            return np.zeros(len(sketch), np.int64)
        centres = sketch[np.arange(n) * len(sketch) // n]
        return np.unique((sketch @ centres.T).argmax(axis=1), return_inverse=True)[1]

    def best(self, cols: np.ndarray, w: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(rows, scores, blocks, scored blocks): every row that may be among the k best with a score of ``floor`` or more."""
        blocks = _spans(self.first[cols], self.last[cols] - self.first[cols])
        bounds = self.summaries[blocks[:, None], cols[None, :]].astype(np.float64) @ w
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        seen = np.zeros(len(self.vectors), bool)
        at, step, done = 0, FIRST_BLOCKS, 0
        floor = max(floor, 1)
        while at < len(blocks) and bounds[at] >= floor:
            part = blocks[at : at + step][bounds[at : at + step] >= floor]
            docs = self.docs[_spans(self.starts[part], self.starts[part + 1] - self.starts[part])]
            docs = np.unique(docs[~seen[docs]])
            seen[docs] = True
            # Whole numbers below 2^53: sums of doubles are exact.
            found = self.vectors[docs[:, None], cols[None, :]].astype(np.float64) @ w
            good = found >= floor
            rows, scores = np.concatenate([rows, docs[good]]), np.concatenate([scores, found[good]])
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                good = scores >= floor
                rows, scores = rows[good], scores[good]
            at, step, done = at + step, 2 * step, done + len(part)
        return rows, scores.astype(np.int64), len(blocks), done


# ---------------------------------------------------------------- search


@dataclass
class Asked:
    """Items that are searched together: their terms as places in the group's vocabulary."""

    terms: np.ndarray
    weight: np.ndarray
    items: list[int] = field(default_factory=list)
    cols: list[np.ndarray] = field(default_factory=list)


def together(places: list[np.ndarray], weight: np.ndarray, most: int = QUERY_TERMS) -> list[Asked]:
    """The items of a group in runs with at most ``most`` different terms, or of one item."""
    runs, held = [], set()
    for i, p in enumerate(places):
        more = held | set(p.tolist())
        if not runs or len(more) > most and runs[-1]:
            runs.append([])
            more = set(p.tolist())
        runs[-1].append(i)
        held = more
    made = []
    for run in runs:
        terms = np.unique(np.concatenate([places[i] for i in run]))
        made.append(Asked(terms, weight[terms], run, [np.searchsorted(terms, places[i]) for i in run]))
    return made


class Lists:
    """The best k documents of each item so far."""

    def __init__(self, floors: Iterable[int], k: int):
        self.k, self.floors = k, list(floors)
        self.found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in self.floors]

    def add(self, i: int, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        if not len(scores):
            return
        self.found[i].append((ids, missing, scores))
        if sum(len(x[0]) for x in self.found[i]) > 4 * self.k:
            self.trim(i)

    def trim(self, i: int) -> tuple[np.ndarray, ...]:
        ids, missing, scores = (np.concatenate(x) for x in zip(*self.found[i], strict=True))
        best = np.lexsort((ids, missing, -scores))[: self.k]
        self.found[i] = [(ids[best], missing[best], scores[best])]
        if len(best) == self.k:
            self.floors[i] = max(self.floors[i], int(scores[best[-1]]))
        return self.found[i][0]


def scan_tiles(counts: DataFrame, asked: list[Asked], floors: list[int], docs: int, terms: int, k: int, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(item, doc_id, score) of each task's best, by the item's place in its group; with it the blocks and those scored."""
    tile_docs, block_docs = sizes or (TILE_DOCS, BLOCK_DOCS)
    widest = max(len(a.terms) for a in asked)
    tile_docs = max(block_docs, min(tile_docs, TILE_CELLS // widest)) if widest <= TILE_CELLS // block_docs else max(1, TILE_CELLS // widest)
    schema = "item int, doc_id long, score long, blocks long, scored long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(floors, k)
        seen, scored = np.zeros(len(floors), np.int64), np.zeros(len(floors), np.int64)
        held, rows_held = [], 0

        def search_tile(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, n = t.column("doc_id").combine_chunks(), t.column("n").to_numpy()
            lengths = t.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            place = t.column("terms").combine_chunks().flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), lengths)
            impact = impacts(t.column("tf").combine_chunks().flatten().to_numpy(), n[row], docs, terms)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for a in asked:
                col = np.minimum(np.searchsorted(a.terms, place), len(a.terms) - 1)
                own = a.terms[col] == place
                if not own.any():
                    continue
                used, at = np.unique(row[own], return_inverse=True)
                tile = Tile(at, col[own], impact[own], a.weight, len(used), block_docs)
                for i, cols in zip(a.items, a.cols, strict=True):
                    rows, scores, blocks, done = tile.best(cols, a.weight[cols].astype(np.float64), lists.floors[i], k)
                    lists.add(i, ids[used[rows]], missing[used[rows]], scores)
                    seen[i], scored[i] = seen[i] + blocks, scored[i] + done

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, tile_docs - rows_held)
                held, rows_held, at = [*held, part], rows_held + part.num_rows, at + part.num_rows
                if rows_held == tile_docs:
                    search_tile(held)
                    held, rows_held = [], 0
        if held:
            search_tile(held)
        for i in np.flatnonzero(seen):
            ids, missing, scores = lists.trim(i) if lists.found[i] else (np.zeros(1, np.int64), np.ones(1, bool), np.zeros(1, np.int64))
            first = np.arange(len(ids)) == 0  # the row that carries the counts
            columns = [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, pa.int64(), mask=missing), pa.array(scores), pa.array(first * seen[i]), pa.array(first * scored[i])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return counts.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tf").mapInArrow(scan, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item, with their rank."""
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, sample_docs: int = SAMPLE_DOCS, sizes: tuple[int, int] | None = None, most: tuple[int, int] = (GROUP_TERMS, QUERY_TERMS), report: bool = False) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best k documents; ``report`` returns the blocks of each item instead: item_id, blocks, scored."""
    spark, results = docs.sparkSession, []
    for group in groups(item_terms(items), most[0]):
        vocabulary = np.unique(np.concatenate([t for _, t in group]))
        places = [np.searchsorted(vocabulary, t) for _, t in group]
        counts = stored(term_counts(docs, vocabulary), "term_counts")
        n, terms, weight = weights(counts, len(vocabulary))
        if not terms:
            discard(counts)
            continue
        asked = together(places, weight, most[1])
        part = F.pmod(F.xxhash64("doc_id", "n"), F.lit(max(2, n // sample_docs)))
        first = stored(scan_tiles(counts.where(part == 0), asked, [1] * len(group), n, terms, k, sizes), "first_lists")
        floors = [1] * len(group)
        for row in ranked(first, k).where(F.col("rank") == k).select("item", "score").collect():
            floors[row["item"]] = row["score"]
        rest = stored(scan_tiles(counts.where(part != 0), asked, floors, n, terms, k, sizes), "other_lists")
        found = first.unionByName(rest)
        found = found.groupBy("item").agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored")) if report else ranked(found, k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(group)], "item int, item_id long")
        columns = ["item_id", "blocks", "scored"] if report else ["item_id", "rank", "doc_id", "score"]
        results.append(found.join(names, "item").select(*columns))
        discard(counts)
    if not results:
        return spark.createDataFrame([], "item_id long, blocks long, scored long" if report else "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
