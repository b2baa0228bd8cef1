"""Linear contextual bandit on logged decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


ARM_BLOCK = 512
SCORES_AT_ONCE = 1 << 20


def linucb_moments(log: DataFrame, dim: int = 10) -> DataFrame:
    """(arm, a, b): upper triangle of X'X, row by row, and X'reward of (arm, context, reward) rows.

    Moments of parts of a log add up to those of the whole.
    """
    upper = [(i, j) for i in range(dim) for j in range(i, dim)]
    x = [F.get("context", F.lit(i)).cast("double") for i in range(dim)]
    moments = log.groupBy("arm").agg(
        *[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in upper],
        *[F.sum(x[i] * F.col("reward")).alias(f"b{i}") for i in range(dim)],
    )
    return moments.select(
        "arm", F.array(*[F.col(f"a{i}_{j}") for i, j in upper]).alias("a"), F.array(*[F.col(f"b{i}") for i in range(dim)]).alias("b")
    )


def add_moments(parts: DataFrame) -> DataFrame:
    """One row per arm of several tables of moments."""
    plus = lambda c: F.aggregate(F.slice(c, F.lit(2), F.size(c)), F.get(c, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    # As many rows per arm as there are tables.
    held = parts.groupBy("arm").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return held.select("arm", plus(F.col("a")).alias("a"), plus(F.col("b")).alias("b"))


def linucb_solve(moments: DataFrame, dim: int = 10) -> DataFrame:
    """(arm, theta, a_inv): one small system per arm."""
    upper = np.triu_indices(dim)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for arms in batches:
            if arms.empty:
                continue
            a = np.zeros((len(arms), dim, dim))
            a[:, upper[0], upper[1]] = a[:, upper[1], upper[0]] = np.stack(arms["a"].to_numpy())
            inverse = np.linalg.inv(a + np.eye(dim))
            theta = np.einsum("nij,nj->ni", inverse, np.stack(arms["b"].to_numpy()))
            yield pd.DataFrame({"arm": arms["arm"], "theta": list(theta), "a_inv": [list(m) for m in inverse]})

    arm_type = moments.schema["arm"].dataType.simpleString()
    return moments.mapInPandas(solve, f"arm {arm_type}, theta array<double>, a_inv array<array<double>>")


def linucb_fit(log: DataFrame, dim: int = 10) -> DataFrame:
    """(arm, theta, a_inv) from (arm, context, reward) rows.

    The moments of all arms come from one map-side combined aggregate, upper
    triangle only; what is left to solve is one small system per arm.
    """
    return linucb_solve(linucb_moments(log, dim), dim)


def linucb_select(contexts: DataFrame, arms: DataFrame, alpha: float = 0.1, arm_block: int = ARM_BLOCK) -> DataFrame:
    """Add ``arm`` and its ``ucb``: the arm with the highest upper bound, the lowest arm on ties; null without arms or context.

    A task holds one block of arms and reads a share of the contexts as a stream, so
    each arm is sent once per share and a context once per block of arms.
    """
    spark, arm_type = contexts.sparkSession, arms.schema["arm"].dataType.simpleString()
    rows = cut_lineage(contexts.withColumn("_row", F.monotonically_increasing_id()), "contexts")
    count = arms.count()
    blocks = max(1, -(-count // arm_block))
    shares = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = F.concat(F.col("theta").cast("array<double>"), F.flatten("a_inv").cast("array<double>"))
    offered = arms.select(every(shares).alias("_x"), part("arm", blocks).alias("_y"), F.lit(False).alias("_asks"), F.lit(None).cast("long").alias("_row"), "arm", packed.alias("_v"))
    x = F.col("context").cast("array<double>")
    asked = rows.where(F.col("context").isNotNull() & ~F.exists(x, lambda v: v.isNull())).select(
        part("_row", shares).alias("_x"), every(blocks).alias("_y"), F.lit(True).alias("_asks"), "_row", F.lit(None).cast(arm_type).alias("arm"), x.alias("_v")
    )
    cells = offered.union(asked).repartition("_x", "_y").sortWithinPartitions("_x", "_y", "_asks", "arm")

    def best(contexts: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and upper bound of the best held arm for each context."""
        dim = contexts.shape[1]
        theta, inverse = held[:, :dim], held[:, dim:].reshape(-1, dim, dim)
        place, top = np.zeros(len(contexts), np.int64), np.full(len(contexts), -np.inf)
        for k in range(len(held)):
            bound = contexts @ theta[k] + alpha * np.sqrt(np.maximum(((contexts @ inverse[k]) * contexts).sum(axis=1), 0.0))
            better = bound > top
            place[better], top[better] = k, bound[better]
        return place, top

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, held, matrix = None, [], [], None
        for batch in batches:
            xs, ys, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lengths = batch.column(5).value_lengths().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1]) | (asks[1:] != asks[:-1]) | (lengths[1:] != lengths[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(xs)], strict=True):
                if a == b:
                    continue
                if (xs[a], ys[a]) != cell:
                    cell, names, held, matrix = (xs[a], ys[a]), [], [], None
                v = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not asks[a]:
                    names.append(batch.column(4).slice(a, b - a))
                    held.append(v)
                    continue
                matrix = np.concatenate(held) if held and matrix is None else matrix
                if matrix is None or matrix.shape[1] != v.shape[1] * (v.shape[1] + 1):
                    continue
                own = pa.concat_arrays(names)
                for at in range(0, len(v), max(1, SCORES_AT_ONCE // max(1, v.shape[1]))):
                    block = v[at : at + max(1, SCORES_AT_ONCE // max(1, v.shape[1]))]
                    place, top = best(block, matrix)
                    yield pa.RecordBatch.from_arrays([batch.column(3).slice(a + at, len(block)), own.take(pa.array(place)), pa.array(top)], names=["_row", "arm", "ucb"])

    met = cells.mapInArrow(scan, f"_row long, arm {arm_type}, ucb double")
    top = met.groupBy("_row").agg(F.min(F.struct((-F.col("ucb")).alias("neg"), "arm")).alias("_best"))
    return rows.join(top, "_row", "left").withColumns({"arm": F.col("_best.arm"), "ucb": -F.col("_best.neg")}).drop("_row", "_best")


def arm_stats(log: DataFrame) -> DataFrame:
    """(arm, num_pulls, avg_reward, confidence); confidence is infinite up to one pull."""
    n = F.count("*")
    return log.groupBy("arm").agg(
        n.alias("num_pulls"),
        F.avg("reward").alias("avg_reward"),
        F.when(n > 1, 1.96 * F.stddev_pop("reward") / F.sqrt(n)).otherwise(F.lit(float("inf"))).alias("confidence"),
    )
