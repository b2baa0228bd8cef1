"""Building blocks that stay distributed when one key holds a large share of the rows.

Plain ``Window`` sorts a whole key in one task. The helpers here first cut the
order into many chunks of similar size, work per (key, chunk), and join the few
per-chunk totals back.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .session import cut_lineage

# Rows of one key that a task sorts; a few dozen MB.
CHUNK_ROWS = 1_000_000
MOST_CHUNKS = 1 << 16


def with_chunk(df: DataFrame, order: Sequence[Column], out: str, chunks: int) -> DataFrame:
    """Add the number of the order chunk each row falls in, ascending with ``order``.

    Cut points are the order values with the smallest hash, a repeatable uniform
    sample; ``chunks`` bounds their number. Each row finds its chunk by halving; one
    chunk needs no halving.
    """
    depth = (chunks - 1).bit_length()
    if depth == 0:
        return df.withColumn(out, F.lit(0))
    value = order[0] if len(order) == 1 else F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    cuts = (
        df.select(value.alias("v"))
        .orderBy(F.xxhash64("v"), "v")
        .limit(2**depth - 1)
        .agg(F.array_sort(F.collect_list("v")).alias("cuts"))
        .scalar()
    )
    # One projection per halving keeps the search inside generated code.
    out_df = df.withColumn("_cuts", cuts).withColumn("_at", value).withColumn(out, F.lit(0))
    for k in reversed(range(depth)):
        probe = F.try_element_at(F.col("_cuts"), F.col(out) + 2**k)
        out_df = out_df.withColumn(out, F.col(out) + F.when(probe <= F.col("_at"), 2**k).otherwise(0))
    return out_df.drop("_cuts", "_at")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    chunks: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over this and all earlier rows of the key.

    ``order`` sorts ascending and must be unique within a key; a null key is a key.
    The rows are written first (unless the caller says that they come from a
    ``written`` table), so the input is computed once. Keys with more than
    ``CHUNK_ROWS`` rows are cut into chunks of about that size, whose totals are
    joined back; the others are summed as they are. ``chunks`` cuts all keys into so many.
    """
    valued = df.withColumn("_value", value)
    stored = valued if written else cut_lineage(valued, "rows")
    if chunks is not None:
        return _summed(stored, keys, order, out, chunks)
    count = stored.count()
    if not keys or count <= CHUNK_ROWS:
        return _summed(stored, keys, order, out, min(MOST_CHUNKS, -(-count // CHUNK_ROWS)))
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    sizes = stored.groupBy(*[F.col(k).alias(v) for k, v in names.items()]).agg(F.count("*").alias("_rows"))
    # At most one in CHUNK_ROWS rows.
    large = cut_lineage(sizes.where(F.col("_rows") > CHUNK_ROWS), "large_keys")
    count = large.agg(F.sum("_rows")).first()[0]
    if count is None:
        return _summed(stored, keys, order, out, 1)
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()])
    cut = _summed(stored.join(large, same, "left_semi"), keys, order, out, min(MOST_CHUNKS, -(-count // CHUNK_ROWS)))
    return _summed(stored.join(large, same, "left_anti"), keys, order, out, 1).unionByName(cut)


def _summed(stored: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, chunks: int) -> DataFrame:
    """Running sums of ``_value`` over all keys' rows in ``chunks`` parts of the order."""
    staged = with_chunk(stored, order, "_chunk", max(1, chunks))
    within = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = staged.withColumn("_within", F.sum("_value").over(within))
    if chunks <= 1:
        # Nothing comes before the only chunk.
        return inner.withColumn(out, F.col("_within")).drop("_value", "_chunk", "_within")
    totals = staged.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = by_key.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    offsets = totals.select(
        *[F.col(k).alias(v) for k, v in names.items()], F.col("_chunk").alias("_of"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_chunk") == F.col("_of")
    for k, v in names.items():
        same &= F.col(k).eqNullSafe(F.col(v))
    return (
        inner.join(offsets, same)
        .withColumn(out, F.col("_within") + F.col("_before"))
        .drop("_value", "_chunk", "_within", "_before", "_of", *names.values())
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out)


def dense_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """(value, 0-based index) of the sorted distinct non-null values of a column.

    The index is written to the shared folder: its users join it several times
    and must all see the same numbers.
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return cut_lineage(positions(values, [], [F.col(col)], out).withColumn(out, F.col(out) - 1), "index")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each key by ``order``, with their rank.

    The planner turns the rank filter into a limit per key on both sides of the
    shuffle, so a hot key sends at most ``n`` rows per map task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def first_rows(df: DataFrame, order: Sequence[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip + 1`` .. ``skip + n`` by ``order``, in that order."""
    return df.orderBy(*order).offset(skip).limit(n)


def pairs_within(df: DataFrame, key: str, item: str, carry: Sequence[str], block: int = 1024) -> DataFrame:
    """Unordered pairs of rows sharing ``key``: (key, a_item, b_item, a_*, b_*), a_item < b_item.

    For relations whose result holds every such pair. A key with more than
    ``block`` rows is spread over bucket pairs, so one join group never exceeds
    two blocks. (key, item) must be unique.
    """
    heavy = (
        df.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > block)
        .select(key, F.ceil(F.col("_n") / block).cast("int").alias("_buckets"))
    )
    spread = (
        df.select(key, item, *carry)
        .join(heavy, key, "left")
        .withColumn("_buckets", F.coalesce("_buckets", F.lit(1)))
        .withColumn("_b", F.pmod(F.xxhash64(item), F.col("_buckets")).cast("int"))
        .withColumn(
            "_cell",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.col("_buckets") - 1),
                    lambda k: F.struct(F.least("_b", k).alias("x"), F.greatest("_b", k).alias("y")),
                )
            ),
        )
        .withColumn("_x", F.col("_cell.x"))
        .withColumn("_y", F.col("_cell.y"))
        .drop("_cell", "_buckets")
    )
    a, b = spread.alias("a"), spread.alias("b")
    same_cell = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "_x", "_y")]
    joined = a.join(
        b,
        same_cell[0]
        & same_cell[1]
        & same_cell[2]
        & (F.col(f"a.{item}") < F.col(f"b.{item}"))
        & ((F.col("a._x") == F.col("a._y")) | (F.col("a._b") != F.col("b._b"))),
    )
    return joined.select(
        F.col(f"a.{key}").alias(key),
        F.col(f"a.{item}").alias(f"a_{item}"),
        F.col(f"b.{item}").alias(f"b_{item}"),
        *[F.col(f"a.{c}").alias(f"a_{c}") for c in carry],
        *[F.col(f"b.{c}").alias(f"b_{c}") for c in carry],
    )


def sum_vectors(df: DataFrame, keys: Sequence[str], vector: Column, dim: int, out: str, *extra: Column) -> DataFrame:
    """Element-wise sum of array vectors per key, combined map-side, one shuffle row per key and task."""
    staged = df.withColumn("_v", vector)
    sums = [F.sum(F.get("_v", F.lit(i))).alias(f"_s{i}") for i in range(dim)]
    return (
        staged.groupBy(*keys)
        .agg(*sums, *extra)
        .withColumn(out, F.array(*[F.col(f"_s{i}") for i in range(dim)]))
        .drop(*[f"_s{i}" for i in range(dim)])
    )
