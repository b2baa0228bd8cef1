"""Column functions and row-wise projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Feedback kinds to (rating, weight), event weights, and the score rules.
VIEW_SECONDS_FOR_FULL_RATING = 300.0
EVENT_WEIGHTS = {"click": 1.0, "view": 0.5, "purchase": 5.0, "add_to_cart": 2.0, "rate": 3.0}
RANK_STEP = 0.01

# Fixed value: the characters that separate words.
BLANKS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"


def shard_id(col: Column, n: int = 4) -> Column:
    """md5 of the id, as one 128-bit number, modulo ``n``: four 32-bit words folded in turn."""
    digest = F.md5(col.cast("string"))
    rest = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        rest = (rest * F.lit(2**32) + word) % n
    return rest.cast("int")


def hash_uniform(*cols: Column, seed: int = 42) -> Column:
    """Number in [0, 1) that depends only on the values and the seed."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def text_features(df: DataFrame, cols: Sequence[str] = ("review_text", "summary")) -> DataFrame:
    """Add character and whitespace-token counts of each text column present; null counts as ''."""
    added = {}
    for c in cols:
        if c in df.columns:
            text = F.coalesce(F.col(c), F.lit(""))
            added[f"{c}_length"] = F.length(text)
            added[f"{c}_word_count"] = F.size(F.filter(F.split(text, BLANKS), lambda w: w != ""))
    return df.withColumns(added)


def temporal_features(df: DataFrame, now: str, cols: Sequence[str] = ("review_date",)) -> DataFrame:
    """Add calendar parts (Monday is 0) and whole days before ``now``."""
    added = {}
    for c in cols:
        if c in df.columns:
            ts = F.col(c)
            seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)
            added |= {
                f"{c}_year": F.year(ts),
                f"{c}_month": F.month(ts),
                f"{c}_day": F.day(ts),
                f"{c}_dayofweek": F.weekday(ts),
                f"{c}_hour": F.hour(ts),
                f"{c}_days_since": F.floor(seconds / 86400),
            }
    return df.withColumns(added)


def interaction_features(df: DataFrame) -> DataFrame:
    """Rating counted only for verified purchases, and votes per character of text."""
    added = {}
    if {"rating", "verified_purchase"} <= set(df.columns):
        added["rating_verified_interaction"] = F.col("rating") * F.coalesce("verified_purchase", F.lit(False)).cast("int")
    if {"votes", "review_text_length"} <= set(df.columns):
        added["votes_per_length"] = F.col("votes") / (F.col("review_text_length") + 1)
    return df.withColumns(added)


def dot(a: Column, b: Column) -> Column:
    """Sum of element products of two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vector_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product of the unit vectors; 0 if either is zero."""
    return dot(vector_normalize(a), vector_normalize(b))


def feedback_to_rating(events: DataFrame) -> DataFrame:
    """Add the (rating, weight) a feedback event stands for, as ``target_rating`` and ``target_weight``."""
    kind = F.col("feedback_type")
    seconds = F.coalesce(F.col("view_time_seconds").cast("double"), F.lit(0.0))
    given = F.coalesce(F.col("rating").cast("double"), F.lit(0.0))
    return events.withColumns(
        {
            "target_rating": F.when(kind.isin("click", "purchase"), F.lit(1.0))
            .when(kind == "rating", given / 5.0)
            .when(kind == "view_time", F.least(seconds / VIEW_SECONDS_FOR_FULL_RATING, F.lit(1.0)))
            .otherwise(F.lit(0.0)),
            "target_weight": F.when(kind == "click", F.lit(0.5))
            .when(kind == "view_time", F.lit(0.7))
            .otherwise(F.lit(1.0)),
        }
    )


def event_weights(events: DataFrame, weights: Mapping[str, float] = EVENT_WEIGHTS) -> DataFrame:
    """Add the configured weight of each event; kinds without one get null."""
    lookup = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return events.withColumn("event_weight", F.try_element_at(lookup, F.col("event_type")))


def rank_score(rank: Column) -> Column:
    """Score of a 1-based list position."""
    return 1.0 - RANK_STEP * (rank - 1)


def rank_to_score(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", rank_score(F.col("rank")))


def activity_level(user_counts: DataFrame, col: str = "products") -> DataFrame:
    """high above 20 products, medium above 5, else low."""
    return user_counts.withColumn(
        "activity_level", F.when(F.col(col) > 20, "high").when(F.col(col) > 5, "medium").otherwise("low")
    )


def parse_json_payload(df: DataFrame, col: str, schema: T.DataType | str) -> DataFrame:
    """Replace a JSON text column by the parsed value."""
    return df.withColumn(col, F.from_json(F.col(col), schema))


def format_ranking_text(
    candidates: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None, context: str | None = None
) -> DataFrame:
    """Add the text handed to a ranking model.

    ``users`` (user_id, user_text) and ``items`` (item_id, item_text) replace the
    default descriptions; ``context`` names a map column.
    """
    df = candidates
    user_text = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    item_text = F.concat(F.lit("Product "), F.col("item_id").cast("string"))
    if users is not None:
        df = df.join(users.select("user_id", F.col("user_text").alias("_user_text")), "user_id", "left")
        user_text = F.coalesce("_user_text", user_text)
    if items is not None:
        df = df.join(items.select("item_id", F.col("item_text").alias("_item_text")), "item_id", "left")
        item_text = F.coalesce("_item_text", item_text)
    if context is not None:
        entries = F.transform(F.map_entries(context), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
        suffix = F.when(F.size(F.map_keys(context)) > 0, F.concat(F.lit(" Context: "), F.array_join(entries, " ")))
        user_text = F.concat(user_text, F.coalesce(suffix, F.lit("")))
    text = F.concat(F.lit("User: "), user_text, F.lit(" Item: "), item_text)
    return df.withColumn("ranking_text", text).drop("_user_text", "_item_text")
