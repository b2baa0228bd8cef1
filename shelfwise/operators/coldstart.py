"""Lists for users without a model vector.

Every list is at most ``n`` long, so a user's lists live in array columns and
the shared ones arrive as one-row arrays; no step pairs users with the catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform, rank_score
from .ranking import popularity_by_category, popularity_by_demographic, ranked_list

# User attributes in the order they are tried, and the strategy chain.
DEMOGRAPHICS = ("user_age", "user_gender", "user_location")
STRATEGIES = ("popularity", "category", "diversity", "random")
POPULAR_MINIMUM = 10
CACHE_SIZE = 1000
FILL_CATEGORIES = 10


def popularity_tables(item_counts: DataFrame, ratings: DataFrame | None = None, cache: int = CACHE_SIZE, minimum: int = POPULAR_MINIMUM, sample: int | None = None) -> DataFrame:
    """(feature, value, item_id, rank): overall list, and one per value of each attribute column ``ratings`` has."""
    popular = item_counts.where(F.col("interactions") >= minimum)
    tables = ranked_list(popular, [F.desc("interactions"), F.col("item_id")], cache).select(
        F.lit("overall").alias("feature"), F.lit("").alias("value"), "item_id", "rank"
    )
    for col in DEMOGRAPHICS:
        if ratings is not None and col in ratings.columns:
            part = popularity_by_demographic(ratings, col, cache, sample)
            tables = tables.unionByName(
                part.select(F.lit(col).alias("feature"), F.col("value").cast("string").alias("value"), "item_id", "rank")
            )
    return tables


def refresh_cold_start(ratings: DataFrame, items: DataFrame | None = None, clusters: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Popularity, category and cluster lists from the latest ratings."""
    counts = ratings.groupBy(F.col("product_id").alias("item_id")).agg(F.count("*").alias("interactions"))
    tables = {"popularity": popularity_tables(counts, ratings, **options)}
    if items is not None:
        tables["category"] = popularity_by_category(items, counts, options.get("cache", CACHE_SIZE))
        tables["items"] = items.select("item_id")
    if clusters is not None:
        tables["clusters"] = clusters
    return tables


def _lists(ranked: DataFrame, keys: Sequence[str], n: int, out: str) -> DataFrame:
    """First ``n`` items of each key as one array."""
    return (
        ranked.where(F.col("rank") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("_l"))
        .select(*keys, F.col("_l.item_id").alias(out))
    )


def _popularity(users: DataFrame, popularity: DataFrame, n: int) -> DataFrame:
    overall = (
        popularity.where((F.col("feature") == "overall") & (F.col("rank") <= n))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))))
        .scalar()
    )
    tried = []
    df = users
    for col in DEMOGRAPHICS:
        if col in users.columns:
            lists = _lists(popularity.where(F.col("feature") == col), ["value"], n, f"_list_{col}")
            df = df.withColumn("value", F.col(col).cast("string")).join(lists, "value", "left").drop("value")
            tried.append(F.col(f"_list_{col}"))
    df = df.withColumn("_overall", overall)
    df = df.withColumn("_popularity", F.coalesce(*tried, F.col("_overall.item_id")))
    return df.drop("_overall", *[f"_list_{c}" for c in DEMOGRAPHICS])


def _category(users: DataFrame, by_category: DataFrame, n: int, shelves: int = FILL_CATEGORIES) -> DataFrame:
    lists = _lists(by_category, ["category"], n, "items")
    first_ten = (
        lists.orderBy("category")
        .limit(shelves)
        .agg(F.array_sort(F.collect_list(F.struct("category", "items"))))
        .scalar()
    )
    df = users.withColumn("_shelves", first_ten)
    if "preferred_categories" in users.columns:
        wanted = F.size("preferred_categories")
        per = F.greatest(F.lit(1), F.floor(F.lit(n) / wanted)).cast("int")
        chosen = (
            users.where(wanted > 0)
            .select("user_id", per.alias("per"), F.posexplode("preferred_categories").alias("pos", "category"))
            .join(lists, "category")
            .groupBy("user_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", F.slice("items", F.lit(1), F.col("per")).alias("l")))).alias("_c"))
            .select("user_id", F.flatten("_c.l").alias("_chosen"))
        )
        df = df.join(chosen, "user_id", "left")
    else:
        df = df.withColumn("_chosen", F.lit(None).cast(f"array<{_item_type(by_category)}>"))
    df = df.withColumn("_chosen", F.coalesce("_chosen", F.array()))
    short = F.lit(n) - F.size("_chosen")
    share = F.greatest(F.lit(1), F.floor(short / F.nullif(F.size("_shelves"), F.lit(0)))).cast("int")
    df = df.withColumn("_share", F.coalesce(share, F.lit(1)))
    fill = F.flatten(F.transform("_shelves", lambda c: F.slice(c["items"], F.lit(1), F.col("_share"))))
    extra = F.array_except(fill, F.col("_chosen"))
    listed = F.when(short > 0, F.concat("_chosen", extra)).otherwise(F.col("_chosen"))
    return df.withColumn("_category", F.slice(listed, 1, n)).drop("_shelves", "_chosen", "_share")


def _item_type(df: DataFrame) -> str:
    return df.schema["item_id"].dataType.simpleString()


def _diversity(users: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    lists = _lists(clusters, ["cluster"], n, "items")
    shelves = lists.agg(F.array_sort(F.collect_list(F.struct("cluster", "items")))).scalar()
    df = users.withColumn("_shelves", shelves)
    per = F.greatest(F.lit(1), F.floor(F.lit(n) / F.nullif(F.size("_shelves"), F.lit(0)))).cast("int")
    df = df.withColumn("_per", F.coalesce(per, F.lit(1)))
    picked = F.flatten(F.transform("_shelves", lambda c: F.slice(c["items"], F.lit(1), F.col("_per"))))
    return df.withColumn("_diversity", F.slice(F.array_distinct(picked), 1, n)).drop("_shelves", "_per")


def _random(users: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    draw = hash_uniform(F.col("item_id"), seed=seed)
    picked = ranked_list(items.select("item_id").distinct(), [draw, F.col("item_id")], n)
    drawn = picked.agg(F.array_sort(F.collect_list(F.struct("rank", "item_id")))).scalar()
    return users.withColumn("_random", drawn).withColumn("_random", F.col("_random.item_id"))


def _rows(lists: DataFrame, items: Column) -> DataFrame:
    """(user_id, item_id, rank, score) from one array per user."""
    return (
        lists.select("user_id", F.posexplode(items).alias("pos", "item_id"))
        .withColumn("rank", F.col("pos") + 1)
        .select("user_id", "item_id", "rank", rank_score(F.col("rank")).alias("score"))
    )


def cold_start_popularity(users: DataFrame, popularity: DataFrame, n: int = 10) -> DataFrame:
    """The list of the user's first known attribute that has one, else the overall list."""
    return _rows(_popularity(users, popularity, n), F.col("_popularity"))


def cold_start_category(users: DataFrame, by_category: DataFrame, n: int = 10, shelves: int = FILL_CATEGORIES) -> DataFrame:
    """Equal shares of the preferred categories, then of the first ``shelves`` categories until ``n``."""
    return _rows(_category(users, by_category, n, shelves), F.col("_category"))


def cold_start_diversity(users: DataFrame, clusters: DataFrame, n: int = 10) -> DataFrame:
    """Equal shares of each item cluster; ``clusters`` is (cluster, item_id, rank)."""
    return _rows(_diversity(users, clusters, n), F.col("_diversity"))


def cold_start_random(users: DataFrame, items: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """A seeded sample of the items, the same for every user."""
    return _rows(_random(users, items, n, seed), F.col("_random"))


def cold_start_recommend(users: DataFrame, tables: dict[str, DataFrame], strategies: Sequence[str] = STRATEGIES, n: int = 10, seed: int = 42) -> DataFrame:
    """Strategies in order until ``n`` different items are found.

    ``tables`` are those of ``refresh_cold_start``; a strategy without its table adds nothing.
    """
    df, columns = users, []
    for strategy in strategies:
        if strategy == "popularity" and "popularity" in tables:
            df = _popularity(df, tables["popularity"], n)
        elif strategy == "category" and "category" in tables:
            df = _category(df, tables["category"], n)
        elif strategy == "diversity" and "clusters" in tables:
            df = _diversity(df, tables["clusters"], n)
        elif strategy == "random" and ("items" in tables or "popularity" in tables):
            pool = tables.get("items")
            if pool is None:
                pool = tables["popularity"].where(F.col("feature") == "overall")
            df = _random(df, pool, n, seed)
        else:
            if strategy not in STRATEGIES:
                raise ValueError(f"unknown strategy: {strategy}")
            continue
        columns.append(F.col(f"_{strategy}"))
    chain = F.slice(F.array_distinct(F.concat(*columns)), 1, n)
    return _rows(df, chain)


def recommend_or_cold_start(users: DataFrame, known: DataFrame, cold: DataFrame, n: int = 10) -> DataFrame:
    """Model lists for users that have one, cold-start lists for the others."""
    wanted = users.select("user_id").distinct()
    mine = known.join(wanted, "user_id", "left_semi").where(F.col("rank") <= n)
    rest = wanted.join(known.select("user_id").distinct(), "user_id", "left_anti")
    theirs = cold.join(rest, "user_id", "left_semi").where(F.col("rank") <= n)
    columns = ("user_id", "item_id", "score", "rank")
    return mine.select(*columns, F.lit(False).alias("cold_start")).unionByName(
        theirs.select(*columns, F.lit(True).alias("cold_start"))
    )
