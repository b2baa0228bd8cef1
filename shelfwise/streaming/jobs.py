"""Structured Streaming versions of the event operators.

Counting jobs keep their totals as Spark state and overwrite the touched keys; jobs
whose result depends on all events so far keep what they need of them in bucketed
tables. A replayed batch gives its version again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import features
from ..operators.ranking import latest_per_key
from ..operators.sessions import SESSION_COUNTS
from ..session import cut_lineage, shared_path
from .buckets import BUCKETS, BucketTable
from .feedback import EnsembleLists, FeedbackWeights, ranked_from_candidates, stream_feedback_weights, stream_rank_and_ensemble
from .live import LiveRecommendations, live_recommendations

__all__ = [
    "EnsembleLists", "FeedbackWeights", "History", "LiveRecommendations", "append_stream", "live_sessions", "ranked_from_candidates", "running_counts",
    "session_stats_stream", "stream_feedback_weights", "stream_product_features", "stream_rank_and_ensemble", "stream_update_recommendations",
    "stream_user_features", "update_stream", "user_table",
]

WATERMARK = "10 minutes"


def session_stats_stream(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Closed sessions, each once, when the watermark passes their end. Late events are dropped.

    The state of an open session is its counters and its set of products; where
    sessions touch very many products use ``live_sessions``, which keeps that
    set in the state store.
    """
    kind = F.col("event_type")
    return (
        events.withWatermark("ts", WATERMARK)
        .groupBy("session_id", F.session_window("ts", gap).alias("w"))
        .agg(
            F.min_by("user_id", "ts").alias("user_id"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("last_time"),
            F.count("*").alias("events"),
            F.size(F.collect_set("product_id")).alias("products"),
            *[F.count_if(kind == k).alias(name) for name, k in SESSION_COUNTS.items()],
        )
        .drop("w")
    )


class LiveSessions(StatefulProcessor):
    """Running counters per session id; a timer drops a session idle for longer than the gap."""

    def __init__(self, gap_ms: int = 30 * 60 * 1000):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        counts = ", ".join(f"{c} bigint" for c in ("events", *SESSION_COUNTS))
        self.totals = handle.getValueState("totals", f"user_id string, start_ms bigint, last_ms bigint, {counts}")
        self.products = handle.getMapState("products", "product_id string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.totals.get()) if self.totals.exists() else None
        for pdf in rows:
            ms = pdf["ts_ms"]
            counts = [len(pdf)] + [int((pdf["event_type"] == k).sum()) for k in SESSION_COUNTS.values()]
            if state is None:
                first = pdf.loc[ms.idxmin()]
                state = [str(first["user_id"]), int(ms.min()), int(ms.max()), *counts]
            else:
                state[1], state[2] = min(state[1], int(ms.min())), max(state[2], int(ms.max()))
                state[3:] = [a + b for a, b in zip(state[3:], counts)]
            for product in pdf["product_id"].unique():
                self.products.updateValue((str(product),), (True,))
        self.totals.update(tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[2] + self.gap_ms)
        products = sum(1 for _ in self.products.keys())
        yield pd.DataFrame([[key[0], *state, products, False]], columns=LIVE_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.totals.get())
        products = sum(1 for _ in self.products.keys())
        self.totals.clear()
        self.products.clear()
        yield pd.DataFrame([[key[0], *state, products, True]], columns=LIVE_COLUMNS)

    def close(self) -> None:
        pass


LIVE_COLUMNS = ["session_id", "user_id", "start_ms", "last_ms", "events", *SESSION_COUNTS, "products", "closed"]
LIVE_SCHEMA = (
    "session_id string, user_id string, start_ms bigint, last_ms bigint, events bigint, "
    + ", ".join(f"{c} bigint" for c in SESSION_COUNTS)
    + ", products bigint, closed boolean"
)


def live_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Every change of an open session, and its last state when it closes. Needs the RocksDB state store."""
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", WATERMARK).select(
        F.col("session_id").cast("string").alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("product_id").cast("string").alias("product_id"),
        "event_type",
        F.unix_millis("ts").alias("ts_ms"),
        "ts",
    )
    return rows.groupBy("session_id").transformWithStateInPandas(
        LiveSessions(gap_minutes * 60 * 1000), LIVE_SCHEMA, "update", "eventTime"
    )


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """Totals per product or user for update mode: counts and rating sums, kept as aggregate state."""
    rated = F.col("event_type") == "rating"
    return events.groupBy(key).agg(
        F.count_if(F.col("event_type") == "view").alias("view_count"),
        F.count_if(F.col("event_type") == "purchase").alias("purchase_count"),
        F.count_if(rated).alias("rating_count"),
        F.coalesce(F.sum(F.when(rated, F.coalesce("rating", F.lit(0.0)))), F.lit(0.0)).alias("rating_sum"),
        F.max("ts").alias("last_active"),
    )


def stream_product_features(events: DataFrame) -> DataFrame:
    """Running features of each touched product, for an ``update`` sink."""
    counted = running_counts(events, "product_id")
    average = F.when(F.col("rating_count") > 0, F.col("rating_sum") / F.col("rating_count")).otherwise(0.0)
    return counted.select(
        "product_id",
        "view_count",
        "purchase_count",
        "rating_count",
        average.alias("avg_rating"),
        (F.col("view_count") + 10 * F.col("purchase_count") + 5 * F.col("rating_sum")).alias("popularity"),
    )


class History:
    """All events so far, one folder per batch; each event counts once, whichever batches brought it."""

    def __init__(self, spark: SparkSession, path: str, key: str = "event_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        rows = self.spark.read.parquet(self.path).where(F.col("batch") <= batch_id).drop("batch")
        return rows.dropDuplicates([self.key]) if self.key in rows.columns else rows


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None):
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def user_table(spark: SparkSession, path: str, events: DataFrame, buckets: int = BUCKETS) -> BucketTable:
    """The keyed table of user features for events with these types."""
    kind = {c: events.schema[c].dataType.simpleString() for c in ("user_id", "product_id", "ts")}
    schema = (
        f"user_id {kind['user_id']}, view_count long, purchase_count long, rating_count long, avg_rating double, last_active {kind['ts']}, "
        f"recent_views array<{kind['product_id']}>, purchased_products array<{kind['product_id']}>"
    )
    return BucketTable(spark, path, schema, ["user_id"], buckets=buckets)


def stream_user_features(events: DataFrame, table: BucketTable, checkpoint: str, every: str | None = "10 seconds"):
    """Writer that merges each batch into the user feature table: counts add up, lists continue, other users' buckets stay."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(batch, "batch")
        table.upsert(features.user_event_features(rows, table.rows_of(rows, batch_id)), batch_id)

    return run(events, each, checkpoint, every)


def stream_update_recommendations(events: DataFrame, state: LiveRecommendations, checkpoint: str, every: str | None = "30 seconds"):
    """Writer that moves the item relation with each batch and refreshes the lists of its users."""
    return live_recommendations(events, state, checkpoint, every)


def append_stream(df: DataFrame, spark: SparkSession, name: str):
    """Run an append stream over what is available into a table in the shared folder, and read it back."""
    path = shared_path(spark, name)
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def update_stream(df: DataFrame, key: str, spark: SparkSession, name: str) -> DataFrame:
    """Run an update stream over what is available; the newest row per key is the result."""
    path = shared_path(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = run(df, each, f"{path}/checkpoint", None).outputMode("update").start()
    query.awaitTermination()
    return latest_per_key(spark.read.parquet(f"{path}/data"), [key], ["batch"]).drop("batch")
