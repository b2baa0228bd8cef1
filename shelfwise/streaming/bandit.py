"""A contextual bandit that learns from a stream of logged decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.bandit import add_moments, linucb_moments, linucb_solve
from ..session import cut_lineage
from .buckets import BUCKETS, BucketTable


class OnlineBandit:
    """Moments and fitted weights per arm below one folder; a batch solves the systems of its arms only."""

    def __init__(self, spark: SparkSession, path: str, log: DataFrame, dim: int = 10, buckets: int = BUCKETS):
        arm, base = log.schema["arm"].dataType.simpleString(), path.rstrip("/")
        self.dim = dim
        self.moments = BucketTable(spark, f"{base}/moments", f"arm {arm}, a array<double>, b array<double>", ["arm"], buckets=buckets)
        self.arms = BucketTable(spark, f"{base}/arms", f"arm {arm}, theta array<double>, a_inv array<array<double>>", ["arm"], buckets=buckets)

    def add(self, batch: DataFrame, version: int) -> None:
        fresh = cut_lineage(linucb_moments(batch.where("arm IS NOT NULL"), self.dim), "moments")
        total = cut_lineage(add_moments(fresh.unionByName(self.moments.rows_of(fresh, version))), "moments")
        self.moments.upsert(total, version)
        self.arms.upsert(linucb_solve(total, self.dim), version)


def stream_linucb(log: DataFrame, state: OnlineBandit, checkpoint: str, every: str | None = "10 seconds"):
    """Writer that adds each batch of (arm, context, reward) rows to the state."""
    from .jobs import run

    return run(log, lambda batch, version: state.add(batch, version), checkpoint, every)
