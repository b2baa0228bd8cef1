"""Exhaustive top-k search over sparse integer vectors, term at a time.

Vectors are dealt into blocks. A task gets one block of queries and one block of
candidates, turns the candidates into postings per term, and for each term scatters
the queries' weights times the postings into a dense array of scores. Each query
keeps its best k of the block, and the blocks' lists are merged.

Defined results: equal scores go to the smaller id; a query is no candidate of its
own; rows that share an id each take part, a query given twice returns the union of
both lists' best k; null vectors, vectors with null or non-finite components, and
null ids take no part; vectors of other lengths meet on the terms they share; an
empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

TOP = 20
SCALE = 64
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
SCORE_TILE = 1 << 17


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, for rows without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))
    return rows.where(usable).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(lists: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's best k candidates, by score and smaller id.

    Scores stay in 32 bits where the largest possible one fits.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    largest = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(c).max(initial=0))
    kind = np.int32 if largest < 2**31 else np.int64
    # A posting list that covers most candidates is kept as a dense row; the others as places and weights.
    postings = []
    for t in range(c.shape[1]):
        at = np.flatnonzero(c[:, t])
        dense = 4 * len(at) > len(c)
        postings.append((None if dense else at, (c[:, t] if dense else c[at, t]).astype(kind)))
    out = [], [], []
    step = max(1, SCORE_TILE // max(1, len(c)))
    scores, product = np.zeros((step, len(c)), kind), np.zeros((step, len(c)), kind)
    for a in range(0, len(q), step):
        part = q[a : a + step].astype(kind)
        s, p = scores[: len(part)], product[: len(part)]
        s[:] = 0
        for t, (at, weight) in enumerate(postings):
            with_term = np.flatnonzero(part[:, t])
            if not len(with_term) or not len(weight):
                continue
            if at is None:
                np.multiply(part[:, t, None], weight[None, :], out=p)
                s += p
            else:
                s[np.ix_(with_term, at)] += part[with_term, t, None] * weight[None, :]
        for i in range(len(part)):
            row, own = s[i], q_ids[a + i]
            # Rows with the query's own id, however many, come last and are left out below.
            row[np.searchsorted(c_ids, own) : np.searchsorted(c_ids, own, "right")] = np.iinfo(kind).min
            if len(row) > k:
                # Ties at the border all stay.
                border = np.partition(row, len(row) - k)[len(row) - k]
                places = np.flatnonzero(row >= border)
            else:
                places = np.arange(len(row))
            places = places[c_ids[places] != own]
            places = places[np.lexsort((c_ids[places], -row[places].astype(np.int64)))][:k]
            out[0].append(np.full(len(places), own))
            out[1].append(c_ids[places])
            out[2].append(row[places].astype(np.int64))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out[0]), join(out[1]), join(out[2])


def search(vectors: DataFrame, is_query: Column, k: int = TOP, sizes: tuple[int, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among (vec_id, v) against all rows.

    Block counts follow the counted rows, so a cell has a fixed size at any scale.
    Each row is copied once per block of the other side, which is the least an
    exhaustive search in blocks can do.
    """
    count = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    q_size, c_size = sizes or (QUERY_BLOCK, CANDIDATE_BLOCK)
    q_blocks, c_blocks = max(1, -(-count["q"] // q_size)), max(1, -(-count["n"] // c_size))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = vectors.where(is_query).select(
        block(q_blocks, 1).alias("x"), every(c_blocks).alias("y"), F.lit(True).alias("asks"), "vec_id", "v"
    )
    candidates = vectors.select(every(q_blocks).alias("x"), block(c_blocks, 2).alias("y"), F.lit(False).alias("asks"), "vec_id", "v")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, lists = None, ([], []), ([], [])

        def close() -> pa.RecordBatch | None:
            if not ids[0] or not ids[1]:
                return None
            dim = max(len(v) for side in lists for v in side)
            found = block_top(
                np.array(ids[1], np.int64), _matrix(lists[1], dim), np.array(ids[0], np.int64), _matrix(lists[0], dim), k
            )
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

        for batch in batches:
            xs, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            asks, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            column = batch.column(4)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if (xs[i], ys[i]) != cell:
                    if (done := close()) is not None:
                        yield done
                    cell, ids, lists = (xs[i], ys[i]), ([], []), ([], [])
                ids[asks[i]].append(own[i])
                lists[asks[i]].append(flat[at[i] : at[i + 1]])
        if (done := close()) is not None:
            yield done

    cells = candidates.union(queries).repartition("x", "y").sortWithinPartitions("x", "y")
    best = cells.mapInArrow(scan, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
