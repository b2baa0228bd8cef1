"""Behaviour statistics of a sliding window, kept while events come in.

State, each a ``BucketTable``: cells (session id, minute, product) of the sessions that
can still be active, and each user's last moment. A batch adds its cells, the summary is
made from the cells of all open sessions, and cells of sessions that ended before the
window and the allowed lateness go. So the state is as large as the traffic of a window
with its open sessions, whatever the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import SUMS, behaviour_summary, merge_cells, session_cells, sessions_of
from ..session import cut_lineage
from .buckets import BUCKETS, BucketTable


class BehaviourWindow:
    """Running behaviour statistics below one folder; ``events`` gives the types of the ids."""

    def __init__(self, spark: SparkSession, path: str, events: DataFrame, minutes: int = 30, late_minutes: int = 10, buckets: int = BUCKETS):
        kind = {c: events.schema[c].dataType.simpleString() for c in ("session_id", "product_id", "user_id")}
        self.spark, self.path, self.minutes, self.late = spark, path.rstrip("/"), minutes, late_minutes
        counts = ", ".join(f"{c} long" for c in SUMS)
        schema = f"session_id {kind['session_id']}, minute long, product_id {kind['product_id']}, user_id {kind['user_id']}, lo long, hi long, {counts}"
        self.cells = BucketTable(spark, f"{self.path}/cells", schema, ["session_id", "minute", "product_id"], ["session_id"], buckets)
        self.users = BucketTable(spark, f"{self.path}/users", f"user_id {kind['user_id']}, last long", ["user_id"], buckets=buckets)

    def add(self, batch: DataFrame, version: int) -> None:
        """Take a batch and write the statistics at the newest moment so far as a row of ``summaries``."""
        events = cut_lineage(batch, "batch")
        newest = events.agg(F.unix_micros(F.max("ts")).alias("at"))
        before = self.users._read(self.users.before(version)).agg(F.max("last").alias("at"))
        at = newest.union(before).agg(F.max("at")).first()[0]
        if at is None:
            return
        start = at - self.minutes * 60_000_000
        fresh = cut_lineage(session_cells(events), "cells")
        merged = merge_cells(fresh.unionByName(self.cells.rows_of(fresh, version)))
        untouched = self.cells._read(self.cells.before(version)).join(fresh.select("session_id").distinct(), "session_id", "left_anti")
        every = cut_lineage(merged.unionByName(untouched.select(merged.columns)), "all_cells")
        sessions = cut_lineage(sessions_of(every, self.minutes), "sessions")
        # A session id keeps the cells of its last session while an event may still continue it.
        oldest = start - self.late * 60_000_000
        ended = sessions.where(F.col("hi") < oldest).select("session_id", F.col("start").alias("_lo"), F.col("hi").alias("_hi"))
        of = every.join(ended, "session_id").where(F.col("lo").between(F.col("_lo"), F.col("_hi"))).select("session_id", "minute", "product_id")
        closed = cut_lineage(of, "closed")
        kept = merged.join(closed, ["session_id", "minute", "product_id"], "left_anti")
        last = events.where("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id").agg(F.unix_micros(F.max("ts")).alias("last"))
        seen = last.unionByName(self.users.rows_of(last, version)).groupBy("user_id").agg(F.max("last").alias("last"))
        self.users.upsert(seen, version)
        self.cells.upsert(kept, version, closed)
        users = self.users.read(version).where(F.col("last") >= start).agg(F.count("*")).scalar()
        summary = behaviour_summary(sessions.where(F.col("hi") >= start), users)
        row = summary.withColumn("as_of", F.timestamp_micros(F.lit(at)))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/summaries/batch={version}")

    def summaries(self) -> DataFrame:
        """(as_of, statistics): one row per batch that had active sessions."""
        return self.spark.read.parquet(f"{self.path}/summaries").drop("batch")


def stream_behaviour_window(events: DataFrame, state: BehaviourWindow, checkpoint: str, every: str | None = "1 minute"):
    """Writer that adds each batch to the state."""
    from .jobs import run

    return run(events, lambda batch, version: state.add(batch, version), checkpoint, every)
