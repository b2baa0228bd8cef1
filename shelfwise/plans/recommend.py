"""Queries put together from several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import activity_level, rank_to_score
from ..operators import cleaning, interactions, ranking
from ..session import cut_lineage


def update_recommendations(
    events: DataFrame,
    popular: DataFrame | None = None,
    n: int = 100,
    max_seen: int | None = None,
    related: DataFrame | None = None,
    model_popular: DataFrame | None = None,
) -> DataFrame:
    """(user_id, item_id, rank, score, activity_level) for every user of the events.

    Items related to what the user touched, best sum first, then popular ones: the most
    viewed, followed by those of ``model_popular`` (item_id, rank) if given.
    With ``max_seen`` a user with more products is taken for a bot and gets no
    list, but still counts in the item relation.
    """
    seen = cut_lineage(interactions.seen_products(events), "seen")
    sizes = seen.groupBy("user_id").agg(F.count("*").alias("products"))
    targets = sizes if max_seen is None else sizes.where(F.col("products") <= max_seen)
    history = seen.join(targets.select("user_id"), "user_id", "left_semi")
    if related is None:
        related = cut_lineage(interactions.cooccurrence_feedback(events), "related")
    known = history.select("user_id", F.col("product_id").alias("item_id"))
    candidates = interactions.exclude_seen(interactions.related_candidates(history, related), known)
    own = ranking.top_n_per_user(candidates, n)
    if popular is None:
        popular = ranking.top_popular(events, n)
    if model_popular is not None:
        popular = cut_lineage(ranking.merge_popular(popular, model_popular, n), "popular")
    filled = ranking.fill_from_popular(own, popular, known, n, targets)
    return (
        rank_to_score(filled)
        .join(activity_level(targets), "user_id")
        .select("user_id", "item_id", "rank", "score", "activity_level")
    )


def behaviour_recommendations(events: DataFrame, n: int = 100, min_user: int = 5, min_product: int = 5) -> DataFrame:
    """The whole way from raw events to lists, over sufficiently active users and products."""
    active = cut_lineage(cleaning.filter_min_activity(events, min_user, min_product), "active")
    return update_recommendations(active, ranking.top_popular(active, n), n)

