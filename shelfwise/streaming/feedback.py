"""Model weights and ensemble lists that follow a stream; a batch costs as much as the rows that it touches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ensemble import (
    attribute_feedback,
    diversity_penalty,
    ensemble_weighted_rank,
    success_counts,
    success_weights,
    user_model_weights,
)
from ..operators.ranking import latest_per_key
from ..session import cut_lineage
from .buckets import BUCKETS, BucketTable


class FeedbackWeights:
    """Feedback counts and weights per model, and weights per user and model, below one folder.

    Global weights move once per batch over all feedback so far, from added-up counts;
    user weights step through the batch. How far the global weights move thus
    depends on the trigger; each version is kept.
    """

    def __init__(self, spark: SparkSession, path: str, feedback: DataFrame, weights: Mapping[str, float], min_feedback: int = 100, buckets: int = BUCKETS):
        user = feedback.schema["user_id"].dataType.simpleString()
        base = path.rstrip("/")
        self.start, self.min_feedback = dict(weights), min_feedback
        self.counts = BucketTable(spark, f"{base}/counts", "model string, feedback long, clicks long, purchases long, ratings long, rating_sum double", ["model"], buckets=1)
        self.models = BucketTable(spark, f"{base}/models", "model string, feedback long, success double, weight double", ["model"], buckets=1)
        self.users = BucketTable(spark, f"{base}/users", f"user_id {user}, model string, weight double", ["user_id", "model"], buckets=buckets)

    def add(self, batch: DataFrame, recs: DataFrame, version: int) -> None:
        rows = cut_lineage(attribute_feedback(batch, recs), "attributed")
        fresh = success_counts(rows)
        held = self.counts._read(self.counts.before(version))
        names = [c for c in held.columns if c != "model"]
        summed = fresh.unionByName(held).groupBy("model").agg(*[F.sum(c).alias(c) for c in names])
        counts = cut_lineage(summed, "counts")
        # One row per model.
        before = self.start | {r["model"]: r["weight"] for r in self.models._read(self.models.before(version)).select("model", "weight").collect()}
        self.counts.upsert(counts, version)
        self.models.upsert(success_weights(counts, before, self.min_feedback), version)
        self.users.upsert(user_model_weights(rows, before, self.users.rows_of(rows, version)), version)


def stream_feedback_weights(feedback: DataFrame, recs: DataFrame, state: FeedbackWeights, checkpoint: str, every: str | None = "10 seconds", late: str | None = None):
    """Writer that takes each batch into the state. Repeated events count once: for ever, or within ``late`` of the watermark."""
    from .jobs import run

    once = feedback.dropDuplicates(["event_id"]) if late is None else feedback.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return run(once, lambda batch, version: state.add(batch, recs, version), checkpoint, every)


def ranked_from_candidates(messages: DataFrame, scorer) -> DataFrame:
    """(user_id, source_model, ts, item_id, score, original_score, ...) rows, one per listed candidate."""
    rows = messages.select("user_id", "source_model", "ts", F.explode("candidates").alias("c")).select(
        "user_id", "source_model", "ts", "c.item_id", "c.score", "c.model"
    )
    scored = rows.withColumn("original_score", F.col("score"))
    return scored.withColumn("score", scorer(scored) if callable(scorer) else scorer)


class EnsembleLists:
    """The newest list per user and model, and each user's combined list, below one folder."""

    def __init__(self, spark: SparkSession, path: str, messages: DataFrame, weights: Mapping[str, float], max_age_seconds: int = 3600, buckets: int = BUCKETS):
        kind = {c: messages.schema[c].dataType.simpleString() for c in ("user_id", "source_model", "ts")}
        item = messages.schema["candidates"].dataType.elementType["item_id"].dataType.simpleString()
        base, self.weights, self.max_age = path.rstrip("/"), weights, max_age_seconds
        schema = f"user_id {kind['user_id']}, source_model {kind['source_model']}, ts {kind['ts']}, items array<struct<neg: double, item_id: {item}>>"
        self.newest = BucketTable(spark, f"{base}/newest", schema, ["user_id", "source_model"], ["user_id"], buckets)
        self.lists = BucketTable(spark, f"{base}/lists", f"user_id {kind['user_id']}, item_id {item}, score double, rank int", ["user_id"], buckets=buckets)

    def add(self, messages: DataFrame, scorer, version: int) -> None:
        """Re-score a batch of candidate lists and combine the lists of its users anew."""
        scored = ranked_from_candidates(messages, scorer)
        fresh = scored.groupBy("user_id", "source_model", "ts").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("score")).cast("double").alias("neg"), "item_id"))).alias("items")
        )
        fresh = cut_lineage(fresh, "lists")
        held = self.newest.rows_of(fresh, version)
        touched = cut_lineage(latest_per_key(fresh.unionByName(held.select(fresh.columns)), ["user_id", "source_model"], ["ts", "items"]), "newest")
        self.newest.upsert(touched, version)
        self.lists.upsert(self.combined(touched, version), version, touched.select("user_id").distinct())

    def combined(self, lists: DataFrame, version: int | None = None) -> DataFrame:
        """(user_id, item_id, score, rank) from lists that are not older than allowed at the newest moment of a version."""
        now = self.newest.read(version).agg(F.max("ts").cast("string")).first()[0]
        alive = lists if now is None else latest_per_key(lists, ["user_id", "source_model"], ["ts"], self.max_age, now)
        ranked = alive.select("user_id", F.col("source_model").alias("model"), F.posexplode("items").alias("pos", "i")).select(
            "user_id", "model", F.col("i.item_id").alias("item_id"), (-F.col("i.neg")).alias("score"), (F.col("pos") + 1).alias("rank")
        )
        return diversity_penalty(ensemble_weighted_rank(ranked, self.weights)).select("user_id", "item_id", "score", F.col("rank").cast("int").alias("rank"))

    def all_lists(self) -> DataFrame:
        """Everyone's lists at the newest moment: lists that have grown too old since they came count no more."""
        return self.combined(self.newest.read())


def stream_rank_and_ensemble(messages: DataFrame, scorer, state: EnsembleLists, checkpoint: str, every: str | None = "10 seconds"):
    """Writer: candidate lists are re-scored, the newest list per user and model is kept, the batch's users' lists are combined."""
    from .jobs import run

    return run(messages, lambda batch, version: state.add(batch, scorer, version), checkpoint, every)
