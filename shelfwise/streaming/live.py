"""Recommendations from a stream of events: the item relation and the lists move with each batch.

A user's events weigh 2 with a session and 1 without. With T the user's whole weight
and B(p) the weight before the first touch of product p, a pair of products has gained
T - max(B(a), B(b)) from this user: what ``cooccurrence_feedback`` gives over all
events. So a batch adds T's growth to the pairs that its users had already and the
remainder since the later first touch to new pairs; other users' pairs do not change.

State, each a ``BucketTable``: T per user, B per user and product, the relation, views
per product, and the lists. Events count in the order of their batches and, within a
batch, of ``event_id``; an event counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import activity_level, rank_to_score
from ..operators import interactions, ranking
from ..scale import pairs_within, running_sum
from ..session import cut_lineage
from .buckets import BUCKETS, BucketTable


class LiveRecommendations:
    """The tables of a running recommender below one folder."""

    def __init__(self, spark: SparkSession, path: str, events: DataFrame, n: int = 100, buckets: int = BUCKETS, model_popular: DataFrame | None = None, keep_lists: bool = True):
        """``events`` gives the types of the ids; ``model_popular`` (item_id, rank) continues the list of most viewed items.

        Without ``keep_lists`` batches leave the lists alone; ``all_lists`` makes them when asked.
        """
        kind = {c: events.schema[c].dataType.simpleString() for c in ("user_id", "product_id")}
        user, item = f"user_id {kind['user_id']}", kind["product_id"]
        make = lambda name, schema, keys, deal=None: BucketTable(spark, f"{path.rstrip('/')}/{name}", schema, keys, deal, buckets)
        self.n, self.model_popular, self.keep_lists = n, model_popular, keep_lists
        self.users = make("users", f"{user}, total long, products long", ["user_id"])
        self.touches = make("touches", f"{user}, product_id {item}, before long", ["user_id", "product_id"], ["user_id"])
        self.relation = make("relation", f"product_id {item}, related_id {item}, score double", ["product_id", "related_id"], ["product_id"])
        self.views = make("views", f"product_id {item}, view_count long", ["product_id"])
        self.lists = make("lists", f"{user}, item_id {item}, rank int, score double, activity_level string", ["user_id"])

    def add(self, batch: DataFrame, version: int) -> None:
        """Take a batch of events into every table and refresh the lists of its users."""
        events = cut_lineage(batch, "batch")
        rows = events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
        in_session = F.col("session_id").isNotNull() & (F.col("session_id") != "default")
        weighed = rows.withColumn("weight", F.when(in_session, F.lit(2)).otherwise(F.lit(1)).cast("long"))
        upto = running_sum(weighed, ["user_id"], [F.col("event_id")], F.col("weight"), "upto")
        first = cut_lineage(
            upto.groupBy("user_id", "product_id").agg(F.min(F.col("upto") - F.col("weight")).alias("since"), F.sum("weight").alias("weight")), "firsts"
        )
        grown = first.groupBy("user_id").agg(F.sum("weight").alias("more"))
        old = self.users.rows_of(first, version)
        totals = cut_lineage(
            grown.join(old, "user_id", "left").select("user_id", F.coalesce("total", F.lit(0)).alias("was"), (F.coalesce("total", F.lit(0)) + F.col("more")).alias("total")), "totals"
        )
        held = self.touches.rows_of(first, version).select("user_id", "product_id", "before", F.lit(True).alias("old"))
        new = (
            first.join(held, ["user_id", "product_id"], "left_anti").join(totals, "user_id")
            .select("user_id", "product_id", (F.col("was") + F.col("since")).alias("before"), F.lit(False).alias("old"))
        )
        touched = cut_lineage(held.unionByName(new).join(totals, "user_id"), "touched")
        self._relate(touched, version)
        seen = touched.groupBy("user_id").agg(F.first("total").alias("total"), F.count("*").alias("products"))
        self.users.upsert(seen, version)
        self.touches.upsert(touched.where(~F.col("old")), version)
        viewed = interactions.item_popularity(events)
        both = viewed.unionByName(self.views.rows_of(viewed, version))
        self.views.upsert(both.groupBy("product_id").agg(F.sum("view_count").alias("view_count")), version)
        if self.keep_lists:
            lists = self.lists_of(touched, version)
            self.lists.upsert(lists, version, touched.select("user_id").distinct())

    def _relate(self, touched: DataFrame, version: int) -> None:
        """Add what the touched users' pairs gain to the relation."""
        pairs = pairs_within(touched, "user_id", "product_id", ["before", "old", "was", "total"])
        whole = F.col("a_total") - F.greatest("a_before", "b_before")
        gain = F.when(F.col("a_old") & F.col("b_old"), F.col("a_total") - F.col("a_was")).otherwise(whole)
        gains = pairs.groupBy("a_product_id", "b_product_id").agg(F.sum(gain).cast("double").alias("score"))
        more = cut_lineage(interactions.mirrored(gains), "gains")
        # Only pairs that gain are written anew; their buckets' other rows are taken over.
        held = self.relation.rows_of(more, version).join(more.select("product_id", "related_id"), ["product_id", "related_id"], "left_semi")
        self.relation.upsert(more.unionByName(held).groupBy("product_id", "related_id").agg(F.sum("score").alias("score")), version)

    def popular(self, version: int | None = None) -> DataFrame:
        """(item_id, rank): the most viewed items, then the model's."""
        views = self.views.read(version).withColumnRenamed("product_id", "item_id")
        top = ranking.ranked_list(views, [F.desc("view_count"), F.col("item_id")], self.n)
        return top if self.model_popular is None else ranking.merge_popular(top, self.model_popular, self.n)

    def lists_of(self, touched: DataFrame, version: int) -> DataFrame:
        """(user_id, item_id, rank, score, activity_level) of users with all their touches (user_id, product_id), by the version's relation."""
        seen = touched.select("user_id", "product_id")
        related = self.relation._read(self.relation.manifest(version), self.relation.touched(seen))
        known = seen.select("user_id", F.col("product_id").alias("item_id"))
        candidates = interactions.exclude_seen(interactions.related_candidates(seen, related), known)
        sizes = seen.groupBy("user_id").agg(F.count("*").alias("products"))
        filled = ranking.fill_from_popular(ranking.top_n_per_user(candidates, self.n), self.popular(version), known, self.n, sizes)
        return rank_to_score(filled).join(activity_level(sizes), "user_id").select("user_id", "item_id", "rank", "score", "activity_level")

    def all_lists(self) -> DataFrame:
        """Everyone's lists by the newest state, those of users that no recent batch touched included."""
        return self.lists_of(self.touches.read(), self.relation.versions()[-1])


def live_recommendations(events: DataFrame, state: LiveRecommendations, checkpoint: str, every: str | None = "30 seconds", late: str | None = None):
    """Writer that takes each batch into the state. Repeated events count once: for ever, or within ``late`` of the watermark."""
    from .jobs import run

    once = events.dropDuplicates(["event_id"]) if late is None else events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return run(once, lambda batch, version: state.add(batch, version), checkpoint, every)
