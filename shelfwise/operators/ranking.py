"""Top lists, popular lists and list completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import positions, top_n
from ..session import cut_lineage
from .interactions import item_popularity

def by_score() -> list[Column]:
    """Highest score first, ties by item."""
    return [F.desc("score"), F.col("item_id")]


def top_n_per_user(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best items of each user, with their rank."""
    return top_n(scores, ["user_id"], by_score(), n)


def score_threshold(recs: DataFrame, min_score: float = 0.01, n: int = 10, max_n: int = 100) -> DataFrame:
    """Items that reach the minimum score, at most ``n`` (itself at most ``max_n``) per user."""
    return top_n_per_user(recs.where(F.col("score") >= min_score), min(n, max_n))


def ranked_list(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of the whole table with ``rank``; no more than ``n`` rows leave a task."""
    top = df.orderBy(*order).limit(n)
    return top_n(top.withColumn("_all", F.lit(0)), ["_all"], order, n).drop("_all")


def top_popular(events: DataFrame, n: int) -> DataFrame:
    """(item_id, view_count, rank): the most viewed items."""
    views = item_popularity(events).withColumnRenamed("product_id", "item_id")
    return ranked_list(views, [F.desc("view_count"), F.col("item_id")], n)


def factor_popularity(item_factors: DataFrame, n: int = 100) -> DataFrame:
    """(item_id, popularity, rank): items with the largest sum of factor values."""
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return ranked_list(
        item_factors.select("item_id", total.alias("popularity")), [F.desc("popularity"), F.col("item_id")], n
    )


def merge_popular(event_popular: DataFrame, model_popular: DataFrame, n: int) -> DataFrame:
    """(item_id, rank): event-based items, then model-based ones not yet listed, 2n at most.

    All event-based items stay, even if there are more.
    """
    first = event_popular.select("item_id", F.lit(0).alias("source"), "rank")
    extra = model_popular.select("item_id", F.lit(1).alias("source"), "rank").join(
        event_popular.select("item_id"), "item_id", "left_anti"
    )
    both = first.unionByName(extra).withColumnRenamed("rank", "_place")
    ranked = positions(both, [], [F.col("source"), F.col("_place"), F.col("item_id")])
    return ranked.where((F.col("source") == 0) | (F.col("rank") <= 2 * n)).select("item_id", F.col("rank").cast("int").alias("rank"))


def fill_from_popular(
    recs: DataFrame, popular: DataFrame, seen: DataFrame, n: int, users: DataFrame | None = None
) -> DataFrame:
    """(user_id, item_id, rank): a user's own list, then popular items neither seen nor listed, up to ``n``.

    ``recs`` has (user_id, item_id, rank) with rank <= n, ``popular`` is a short
    ranked list. ``users`` adds users without a list of their own. A user is
    offered only as many popular items as can be needed: the open places plus
    those popular items that are seen or listed already.
    """
    own = cut_lineage(recs.where(F.col("rank") <= n).select("user_id", "item_id", "rank"), "own")
    everyone = own.select("user_id") if users is None else own.select("user_id").unionByName(users.select("user_id"))
    known = seen.select("user_id", "item_id").unionByName(own.select("user_id", "item_id")).distinct()
    # The popular list has a fixed length, so it travels as one array.
    offers = popular.agg(F.array_sort(F.collect_list(F.struct("rank", "item_id")))).scalar()
    overlap = (
        known.join(popular.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("known"))
    )
    lengths = own.groupBy("user_id").agg(F.count("*").alias("own"))
    open_places = (
        everyone.distinct()
        .join(lengths, "user_id", "left")
        .join(overlap, "user_id", "left")
        .withColumn("own", F.coalesce("own", F.lit(0)))
        .withColumn("need", n - F.col("own"))
        .where(F.col("need") > 0)
        .withColumn("take", (F.col("need") + F.coalesce("known", F.lit(0))).cast("int"))
    )
    offered = (
        open_places.select("user_id", "own", F.explode(F.slice(offers, F.lit(1), F.col("take"))).alias("o"))
        .select("user_id", "own", F.col("o.item_id").alias("item_id"), F.col("o.rank").alias("place"))
        .join(known, ["user_id", "item_id"], "left_anti")
    )
    filled = top_n(offered, ["user_id"], [F.col("place")], n).select(
        "user_id", "item_id", (F.col("rank") + F.col("own")).cast("int").alias("rank")
    )
    return own.withColumn("rank", F.col("rank").cast("int")).unionByName(filled).where(F.col("rank") <= n)


def popularity_by_demographic(ratings: DataFrame, col: str, n: int = 1000, sample: int | None = None) -> DataFrame:
    """(value, item_id, interactions, rank): most rated items per value of a user attribute.

    All ratings count; ``sample`` is for callers that ask for a report on some rows.
    """
    from .cleaning import sample_rows

    rows = ratings if sample is None else sample_rows(ratings, sample)
    counts = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"), F.col("product_id").alias("item_id")).agg(
        F.count("*").alias("interactions")
    )
    return top_n(counts, ["value"], [F.desc("interactions"), F.col("item_id")], n)


def popularity_by_category(items: DataFrame, counts: DataFrame, n: int = 1000) -> DataFrame:
    """(category, item_id, interactions, rank): items of each category, most popular first."""
    joined = items.select("category", "item_id").join(counts.select("item_id", "interactions"), "item_id", "left")
    filled = joined.select("category", "item_id", F.coalesce("interactions", F.lit(0)).alias("interactions"))
    return top_n(
        filled.where(F.col("category").isNotNull()), ["category"], [F.desc("interactions"), F.col("item_id")], n
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_age_seconds: int | None = None, now: str | None = None, ts: str = "ts") -> DataFrame:
    """The newest row per key, merged map-side; rows older than ``max_age_seconds`` before ``now`` are dropped."""
    rest = [c for c in df.columns if c not in keys]
    newest = (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )
    if max_age_seconds is None:
        return newest
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts))
    return newest.where(age <= max_age_seconds * 1_000_000)
