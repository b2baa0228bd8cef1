"""Bipartite interaction graph: normalisation, propagation and a graph factor model.

Nodes are texts, ``u:<user>`` and ``i:<item>``; edges are stored in both directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, hash_uniform
from ..scale import dense_index, sum_vectors
from ..session import cut_lineage
from .features import normalize_ratings
from .interactions import sample_negatives

ADAM_FIRST, ADAM_SECOND, ADAM_EPSILON = 0.9, 0.999, 1e-8
# Nodes whose vectors are one matrix, a few MB, and about the edges of two such blocks that are one row.
BLOCK_NODES = 1 << 13
CELL_EDGES = 1 << 18
# Largest cell multiplied as a dense matrix, the share of it that must be edges, and edges met at once otherwise.
DENSE_CELL, DENSE_SHARE, EDGES_AT_ONCE = 1 << 22, 1 / 16, 1 << 15
ROWS_AT_ONCE = 1 << 12


def user_node(col: Column) -> Column:
    return F.concat(F.lit("u:"), col.cast("string"))


def item_node(col: Column) -> Column:
    return F.concat(F.lit("i:"), col.cast("string"))


def edge_weights(interactions: DataFrame) -> DataFrame:
    """(user_id, item_id, weight): interaction counts over the root of both ends' degrees."""
    counts = interactions.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    users = counts.groupBy("user_id").agg(F.sum("n").alias("du"))
    items = counts.groupBy("item_id").agg(F.sum("n").alias("di"))
    return (
        counts.join(users, "user_id")
        .join(items, "item_id")
        .select("user_id", "item_id", (F.col("n") / F.sqrt(F.col("du") * F.col("di"))).alias("weight"))
    )


def graph_normalize(interactions: DataFrame) -> DataFrame:
    """(src, dst, weight): ``edge_weights`` in both directions."""
    weighted = edge_weights(interactions).select(
        user_node(F.col("user_id")).alias("u"), item_node(F.col("item_id")).alias("i"), "weight"
    )
    ends = F.array(
        F.struct(F.col("u").alias("src"), F.col("i").alias("dst")), F.struct(F.col("i").alias("src"), F.col("u").alias("dst"))
    )
    return weighted.select(F.explode(ends).alias("e"), "weight").select("e.src", "e.dst", "weight")


def _step(vectors: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """One product of the edge matrix with the vectors; neighbours are summed map-side."""
    joined = edges.join(vectors.select(F.col("node").alias("src"), "features"), "src")
    return sum_vectors(
        joined, [F.col("dst").alias("node")], F.transform("features", lambda x: x * F.col("weight")), dim, "features"
    )


def graph_propagate(vectors: DataFrame, edges: DataFrame, layers: int = 3, dim: int | None = None) -> DataFrame:
    """(node, features): mean of the vectors after 0..``layers`` products with the edge matrix.

    Each layer is written to the shared folder, so a lost executor costs one
    layer and no layer is computed twice. Every layer reads ``edges``; hand over
    a stored table.
    """
    if dim is None:
        dim = len(vectors.select("features").first()["features"])
    layer = vectors.select("node", F.col("features").cast("array<double>").alias("features"))
    total = layer
    for k in range(layers):
        layer = _step(layer, edges, dim)
        if k < layers - 1:
            layer = cut_lineage(layer, f"layer{k}")
        total = total.unionByName(layer)
    mean = F.transform("features", lambda x: x / (layers + 1))
    return sum_vectors(total, ["node"], mean, dim, "features").select("node", "features")


def initial_vectors(nodes: DataFrame, dim: int, seed: int = 42, scale: float = 0.1) -> DataFrame:
    """Normal start vectors that depend only on the node and the seed."""
    def normal(i):
        radius = F.sqrt(-2 * F.log(1 - hash_uniform(F.col("node"), F.lit(i), F.lit("r"), seed=seed)))
        angle = 2 * 3.141592653589793 * hash_uniform(F.col("node"), F.lit(i), F.lit("a"), seed=seed)
        return radius * F.cos(angle) * scale

    return nodes.select("node", F.array(*[normal(i) for i in range(dim)]).alias("features"))


def _times(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Product of the ``n``-row matrix with the entries (row, col, w) and the matrix ``x``."""
    if n * len(x) <= DENSE_CELL and len(w) >= n * len(x) * DENSE_SHARE:
        return np.bincount(rows * len(x) + cols, weights=w, minlength=n * len(x)).reshape(n, len(x)) @ x
    out, order = np.zeros((n, x.shape[1])), np.argsort(rows, kind="stable")
    for a in range(0, len(order), EDGES_AT_ONCE):
        o = order[a : a + EDGES_AT_ONCE]
        r = rows[o]
        starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[starts]] += np.add.reduceat(x[cols[o]] * w[o, None], starts)
    return out


class NodeBlocks:
    """Users and items of weighted pairs dealt to blocks, whose vectors are rows (side, block, x); side 0 holds users.

    An edge lies in the cell of its user's and its item's block. A cell needs both
    blocks once for all its edges, so a product sends vectors per block and not per edge.
    """

    def __init__(self, pairs: DataFrame, dim: int, size: int | None = None):
        """``pairs`` (user_id, item_id) is a stored table without nulls; ``size`` bounds the nodes of a block."""
        self.dim, size = dim, size or BLOCK_NODES
        index = [dense_index(pairs, c, "idx").withColumnRenamed(c, "id") for c in ("user_id", "item_id")]
        self.counts = [x.count() for x in index]
        self.blocks = [max(1, -(-n // size)) for n in self.counts]
        # The larger side has enough blocks for every core.
        large = int(self.counts[1] > self.counts[0])
        wide = -(-2 * pairs.sparkSession.sparkContext.defaultParallelism // self.blocks[1 - large])
        self.blocks[large] = max(self.blocks[large], min(wide, self.counts[large] or 1))
        self.index = [
            x.select("id", (F.col("idx") % b).cast("int").alias("block"), F.floor(F.col("idx") / b).cast("int").alias("place"))
            for x, b in zip(index, self.blocks, strict=True)
        ]

    def nodes(self) -> DataFrame:
        """(node, side, block, place) of every node."""
        named = [x.withColumn("node", f(F.col("id"))) for x, f in zip(self.index, (user_node, item_node), strict=True)]
        return named[0].withColumn("side", F.lit(0)).select("node", "side", "block", "place").unionByName(
            named[1].withColumn("side", F.lit(1)).select("node", "side", "block", "place")
        )

    def located(self, rows: DataFrame, col: str, side: int, block: str, place: str) -> DataFrame:
        """Rows with the block and place of an id; others fall out."""
        at = self.index[side].select(F.col("id").alias(col), F.col("block").alias(block), F.col("place").alias(place))
        return rows.join(at, col).drop(col)

    def cells(self, edges: DataFrame, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
        """(keys, ub, ib, _part, up, ip, w, carried): edges (ub, up, ib, ip, w) of a cell as arrays, a large cell in parts."""
        parts = -(-edges.count() // (self.blocks[0] * self.blocks[1] * CELL_EDGES))
        columns = ("up", "ip", "w", *carry)
        part = F.pmod(F.xxhash64("up", "ip"), F.lit(max(1, parts))).cast("int")
        held = edges.withColumn("_part", part).groupBy(*keys, "ub", "ib", "_part").agg(F.collect_list(F.struct(*columns)).alias("_e"))
        return held.select(*keys, "ub", "ib", "_part", *[F.col(f"_e.{c}").alias(c) for c in columns])

    def meet(self, cells: DataFrame, vectors: DataFrame, answer: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``answer`` makes of each row of ``cells`` with its two blocks: (row, users' matrix, items' matrix)."""
        dim, columns = self.dim, cells.columns
        copies = lambda c, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
        left = vectors.where("side = 0").select(F.col("block").alias("ub"), copies("ib", self.blocks[1]), F.col("x").alias("_u"))
        right = vectors.where("side = 1").select(F.col("block").alias("ib"), copies("ub", self.blocks[0]), F.col("x").alias("_i"))
        met = cells.join(left, ["ub", "ib"]).join(right, ["ub", "ib"]).select(*columns, "_u", "_i")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = [batch.column(c)[k] for c in range(batch.num_columns)]
                    row = [x.values.to_numpy() if isinstance(x, pa.ListScalar) else x.as_py() for x in row]
                    yield from answer(dict(zip(columns, row, strict=False)), row[-2].reshape(-1, dim), row[-1].reshape(-1, dim))

        return met.mapInArrow(scan, schema)

    def product(self, cells: DataFrame, vectors: DataFrame) -> DataFrame:
        """The edges' matrix, in both directions, times the vectors."""
        dim = self.dim

        def multiply(cell: dict, u: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
            up, ip, w = cell["up"].astype(np.int64), cell["ip"].astype(np.int64), cell["w"]
            for side, block, at, x in ((0, cell["ub"], up, _times(up, ip, w, i, len(u))), (1, cell["ib"], ip, _times(ip, up, w, u, len(i)))):
                places = np.unique(at)
                for a in range(0, len(places), ROWS_AT_ONCE):
                    some = places[a : a + ROWS_AT_ONCE]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * len(some) + 1, dim), pa.int32()), pa.array(x[some].ravel()))
                    same = [pa.array(np.full(len(some), v), pa.int32()) for v in (side, block)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(some, pa.int32()), lists], names=["side", "block", "place", "features"])

        return self.summed(self.meet(cells, vectors, multiply, "side int, block int, place int, features array<double>"))

    def summed(self, rows: DataFrame) -> DataFrame:
        """(side, block, x): sums of the vectors of rows (side, block, place, features), zeros where there is none."""
        dim, counts, blocks = self.dim, self.counts, self.blocks
        tasks = min(sum(self.blocks), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.select("side", "block", "place", "features").repartition(tasks, "side", "block").sortWithinPartitions("side", "block")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, total = None, None

            def made() -> pa.RecordBatch:
                lists = pa.array([total.ravel()], pa.list_(pa.float64()))
                return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in last], lists], names=["side", "block", "x"])

            for batch in batches:
                sides, owns, places = (batch.column(c).to_numpy() for c in range(3))
                x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                cuts = np.flatnonzero((sides[1:] != sides[:-1]) | (owns[1:] != owns[:-1])) + 1
                for a, b in zip([0, *cuts], [*cuts, len(sides)], strict=True):
                    if a == b:
                        continue
                    if (sides[a], owns[a]) != last:
                        if last is not None:
                            yield made()
                        last = int(sides[a]), int(owns[a])
                        total = np.zeros((-(-(counts[last[0]] - last[1]) // blocks[last[0]]), dim))
                    order = a + np.argsort(places[a:b], kind="stable")
                    at = places[order]
                    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    total[at[starts]] += np.add.reduceat(x[order], starts)
            if last is not None:
                yield made()

        return dealt.mapInArrow(scan, "side int, block int, x array<double>")

    def combined(self, tables: list[DataFrame], f: Callable[..., list[np.ndarray]], *out: str) -> DataFrame:
        """(side, block, out...): ``f`` of the blocks' values in all tables; null where a later table has no such block."""
        met = tables[0]
        for k, table in enumerate(tables[1:]):
            met = met.join(table.withColumnRenamed("x", f"_x{k}"), ["side", "block"], "left")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    held = [batch.column(c)[k] for c in range(2, batch.num_columns)]
                    lists = [pa.array([x], pa.list_(pa.float64())) for x in f(*[x.values.to_numpy() if x.is_valid else None for x in held])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *lists], names=["side", "block", *out])

        return met.mapInArrow(scan, ", ".join(["side int", "block int", *[f"{c} array<double>" for c in out]]))

    def propagated(self, vectors: DataFrame, cells: DataFrame, layers: int) -> DataFrame:
        """Stored mean of the vectors after 0..``layers`` products; every layer is stored."""
        tables = [vectors.select("side", "block", "x")]
        for k in range(layers):
            tables.append(cut_lineage(self.product(cells, tables[-1]), f"layer{k}"))

        def mean(*xs: np.ndarray | None) -> list[np.ndarray]:
            return [sum(x for x in xs if x is not None) / (layers + 1)]

        return cut_lineage(self.combined(tables, mean, "x"), "propagated")

    def gradient(self, vectors: DataFrame, cells: DataFrame, n: int) -> DataFrame:
        """Gradient as in ``bpr_gradient`` of ``n`` triples whose two pairs are edges of ``cells`` (t, w): 1 for p, -1 for q.

        A triple's score gap is the sum of its two edges' scores; with the slope at
        the gap as their weight, the gradient is a product of the edges' matrix.
        """

        def score(cell: dict, u: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
            up, ip, w, t = (cell[c] for c in ("up", "ip", "w", "t"))
            for a in range(0, len(t), ROWS_AT_ONCE):
                b = slice(a, a + ROWS_AT_ONCE)
                s = np.einsum("ij,ij->i", u[up[b]], i[ip[b]]) * w[b]
                same = [pa.array(np.full(len(s), cell[c]), pa.int32()) for c in ("ub", "ib")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[b]), *same, *[pa.array(x[b], pa.int32()) for x in (up, ip)], pa.array(w[b]), pa.array(s)], names=["t", "ub", "ib", "up", "ip", "w", "s"]
                )

        scored = self.meet(cells, vectors, score, "t long, ub int, ib int, up int, ip int, w double, s double")
        # Two rows per triple.
        gaps = scored.groupBy("t").agg(F.sum("s").alias("d"), F.collect_list(F.struct("ub", "ib", "up", "ip", "w")).alias("_e"))
        slope = -(1 - 1 / (1 + F.exp(-F.col("d")))) / n
        edges = gaps.select(slope.alias("g"), F.inline("_e")).withColumn("w", F.col("w") * F.col("g")).drop("g")
        return self.product(self.cells(cut_lineage(edges, "slopes")), vectors)

    def rows(self, vectors: DataFrame) -> DataFrame:
        """(node, features) of block rows."""
        dim = self.dim

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    x = batch.column(2)[k].values.to_numpy()
                    for a in range(0, len(x) // dim, ROWS_AT_ONCE):
                        some = x[a * dim : (a + ROWS_AT_ONCE) * dim]
                        n = len(some) // dim
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) + 1, dim), pa.int32()), pa.array(some))
                        same = [pa.array(np.full(n, batch.column(c)[k].as_py()), pa.int32()) for c in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(a, a + n), pa.int32()), lists], names=["side", "block", "place", "features"])

        made = vectors.select("side", "block", "x").mapInArrow(scan, "side int, block int, place int, features array<double>")
        return made.join(self.nodes(), ["side", "block", "place"]).select("node", "features")


def item_index(ratings: DataFrame) -> DataFrame:
    """(item_id, idx) of the rated items."""
    return dense_index(ratings.select("item_id"), "item_id", "idx")


def bpr_triples(ratings: DataFrame, seed: int, index: DataFrame | None = None) -> DataFrame:
    """(u, p, q): a positive pair and an item the same user has not touched.

    Positives are the ratings above the smallest one. ``index`` is ``item_index`` of the ratings.
    """
    lowest = ratings.agg(F.min("rating")).scalar()
    pairs = ratings.select("user_id", "item_id").distinct()
    best = ratings.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating")).where(F.col("rating") > lowest)
    index = item_index(ratings) if index is None else index
    negatives = sample_negatives(pairs, 1, "row", seed).select(
        "user_id", F.col("draw_id").alias("idx"), F.col("item_id").alias("negative")
    )
    return (
        best.join(index, "item_id")
        .join(negatives, ["user_id", "idx"])
        .select(
            user_node(F.col("user_id")).alias("u"),
            item_node(F.col("item_id")).alias("p"),
            item_node(F.col("negative")).alias("q"),
        )
    )


def bpr_gradient(vectors: DataFrame, triples: DataFrame, dim: int) -> DataFrame:
    """(node, features): gradient of the mean of -log sigmoid(u.(p - q)) with respect to the propagated vectors."""
    n = triples.agg(F.count("*").cast("double")).scalar()
    named = {c: vectors.select(F.col("node").alias(c), F.col("features").alias(f"v{c}")) for c in ("u", "p", "q")}
    rows = triples.join(named["u"], "u").join(named["p"], "p").join(named["q"], "q")
    gap = F.zip_with("vp", "vq", lambda a, b: a - b)
    rows = rows.withColumn("d", gap).withColumn("g", -(1 - 1 / (1 + F.exp(-dot(F.col("vu"), F.col("d"))))) / n)
    parts = F.array(
        F.struct(F.col("u").alias("node"), F.transform("d", lambda x: x * F.col("g")).alias("features")),
        F.struct(F.col("p").alias("node"), F.transform("vu", lambda x: x * F.col("g")).alias("features")),
        F.struct(F.col("q").alias("node"), F.transform("vu", lambda x: -x * F.col("g")).alias("features")),
    )
    exploded = rows.select(F.inline(parts))
    return sum_vectors(exploded, ["node"], F.col("features"), dim, "features").select("node", "features")


def lightgcn_fit(
    ratings: DataFrame,
    dim: int = 64,
    layers: int = 3,
    lr: float = 0.05,
    epochs: int = 3,
    batches: int = 4,
    weight_decay: float = 1e-4,
    validation: DataFrame | None = None,
    patience: int = 10,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """User and item factors of (user_id, item_id, rating) rows: BPR on propagated vectors, Adam, mini-batches.

    Propagation is linear and the edge matrix symmetric, so the gradient at the
    start vectors is the propagated gradient. A step passes over the whole graph
    twice, so an epoch takes few steps (``batches``, dealt by hash) and long ones
    (``lr``). Vectors and edges are held in blocks (``NodeBlocks``). Every step ends in a
    written table. With ``validation`` ratings, training stops after ``patience`` epochs
    without a smaller mean squared error, and the best epoch is returned.
    """
    weights = cut_lineage(edge_weights(ratings), "weights")
    blocks = NodeBlocks(weights, dim)
    edges = blocks.located(blocks.located(weights, "user_id", 0, "ub", "up"), "item_id", 1, "ib", "ip")
    cells = cut_lineage(blocks.cells(edges.withColumnRenamed("weight", "w")), "cells")
    nodes = blocks.nodes()
    start = cut_lineage(blocks.summed(initial_vectors(nodes, dim, seed).join(nodes, "node")), "start")
    state = blocks.combined([start], lambda x: [x, np.zeros_like(x), np.zeros_like(x)], "x", "m", "v")
    state = cut_lineage(state, "epoch")
    best, best_loss, waited = None, None, 0
    final, index, steps = None, item_index(ratings), 0
    for epoch in range(1, epochs + 1):
        batch = F.pmod(F.xxhash64("u", "p", "q", F.lit(epoch)), F.lit(batches))
        triples = cut_lineage(bpr_triples(ratings, seed + epoch, index).withColumn("batch", batch), "triples")
        sizes = {r[0]: r[1] for r in triples.groupBy("batch").count().collect()}  # one row per batch
        pairs = cut_lineage(_triple_cells(triples, blocks), "pairs")
        for k in range(batches):
            propagated = blocks.propagated(state, cells, layers)
            gradient = cut_lineage(blocks.gradient(propagated, pairs.where(F.col("batch") == k).drop("batch"), sizes.get(k, 0)), "gradient")
            step = blocks.propagated(gradient, cells, layers) if k in sizes else gradient
            steps += 1
            state = cut_lineage(blocks.combined([state, step], _adam(steps, lr, weight_decay), "x", "m", "v"), "step")
        if validation is not None:
            final = cut_lineage(blocks.rows(blocks.propagated(state, cells, layers)), "final")
            loss = _validation_loss(final, ratings, validation)
            if loss is not None and (best_loss is None or loss < best_loss):
                best, best_loss, waited = final, loss, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    result = best if best is not None else cut_lineage(blocks.rows(blocks.propagated(state, cells, layers)), "final")
    return _named(result, ratings, "user_id", user_node), _named(result, ratings, "item_id", item_node)


def _triple_cells(triples: DataFrame, blocks: NodeBlocks) -> DataFrame:
    """Cells of the two pairs of each triple (u, p, q, batch), numbered ``t``; triples with an unknown node fall out."""
    nodes = blocks.nodes().drop("side")
    placed = triples
    for c in ("u", "p", "q"):
        placed = placed.join(nodes.select(F.col("node").alias(c), F.struct("block", "place").alias(f"_{c}")), c)
    numbered = cut_lineage(placed.select("batch", F.monotonically_increasing_id().alias("t"), "_u", "_p", "_q"), "numbered")
    ends = F.array(F.struct(F.col("_p").alias("i"), F.lit(1.0).alias("w")), F.struct(F.col("_q").alias("i"), F.lit(-1.0).alias("w")))
    pairs = numbered.select("batch", "t", "_u", F.inline(ends)).select(
        "batch", "t", F.col("_u.block").alias("ub"), F.col("_u.place").alias("up"), F.col("i.block").alias("ib"), F.col("i.place").alias("ip"), "w"
    )
    return blocks.cells(pairs, "batch", carry=("t",))


def _adam(epoch: int, lr: float, weight_decay: float) -> Callable[..., list[np.ndarray]]:
    """A step of the values x with moments m and v along the gradient g; none counts as 0."""

    def moved(x: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray | None) -> list[np.ndarray]:
        g = (0.0 if g is None else g) + weight_decay * x
        m = ADAM_FIRST * m + (1 - ADAM_FIRST) * g
        v = ADAM_SECOND * v + (1 - ADAM_SECOND) * g * g
        step = lr * (m / (1 - ADAM_FIRST**epoch)) / (np.sqrt(v / (1 - ADAM_SECOND**epoch)) + ADAM_EPSILON)
        return [x - step, m, v]

    return moved


def _named(vectors: DataFrame, ratings: DataFrame, id_col: str, node) -> DataFrame:
    ids = ratings.select(id_col).distinct()
    return ids.join(vectors, node(F.col(id_col)) == F.col("node")).select(id_col, "features")


def _validation_loss(vectors: DataFrame, ratings: DataFrame, validation: DataFrame) -> float | None:
    scaled = normalize_ratings(validation, ratings, 1e-10)
    rows = (
        scaled.withColumns({"u": user_node(F.col("user_id")), "p": item_node(F.col("item_id"))})
        .join(vectors.select(F.col("node").alias("u"), F.col("features").alias("vu")), "u")
        .join(vectors.select(F.col("node").alias("p"), F.col("features").alias("vp")), "p")
    )
    error = dot(F.col("vu"), F.col("vp")) - F.col("normalized_rating")
    return rows.agg(F.avg(error * error)).first()[0]
