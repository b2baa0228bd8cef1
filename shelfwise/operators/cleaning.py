"""Review cleaning, activity filters, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_uniform
from ..scale import running_sum

# Accepted input names and the column each stands for. When a file
# has several names for one column, the one listed last is kept.
ALIASES = [
    ("asin", "product_id"),
    ("reviewer_id", "user_id"),
    ("overall", "rating"),
    ("reviewtext", "review_text"),
    ("review", "review_text"),
    ("title", "summary"),
    ("timestamp", "review_date"),
    ("unixreviewtime", "review_date"),
    ("unix_review_time", "review_date"),
]
REQUIRED = ("product_id", "user_id", "rating")


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores, plus the standard columns their aliases stand for."""
    df = df.select([F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in df.columns])
    present = set(df.columns)
    return df.withColumns({target: F.col(name) for name, target in ALIASES if name in present})


def _as_timestamp(df: DataFrame, col: str):
    kind = df.schema[col].dataType
    if isinstance(kind, T.NumericType):
        return F.timestamp_seconds(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(col).cast("timestamp")
    return F.col(col).try_cast("timestamp")


def clean_reviews(df: DataFrame, now: str | None = None) -> DataFrame:
    """Standard columns and types; rows without product, user or numeric rating are dropped."""
    df = standardize_columns(df)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    have = set(df.columns)
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")

    def text(col):
        return F.coalesce(F.col(col).cast("string"), F.lit("")) if col in have else F.lit("")

    votes = "helpful_votes" if "helpful_votes" in have else "votes" if "votes" in have else None
    return df.withColumns(
        {
            "review_text": text("review_text"),
            "summary": text("summary"),
            "rating": F.col("rating").try_cast("double"),
            "review_date": _as_timestamp(df, "review_date") if "review_date" in have else moment,
            "verified_purchase": F.col("verified_purchase") if "verified_purchase" in have else F.lit(False),
            "votes": F.col(votes) if votes else F.lit(0),
        }
    ).dropna(subset=list(REQUIRED))


def filter_min_activity(reviews: DataFrame, min_user: int = 5, min_product: int = 5) -> DataFrame:
    """Reviews of users and products that both reach their minimum in the unfiltered input.

    The key lists are small next to the reviews; the adaptive planner broadcasts
    them when they measure small and splits hot users and products otherwise.
    """
    keep_users = reviews.groupBy("user_id").count().where(F.col("count") >= min_user).select("user_id")
    keep_products = reviews.groupBy("product_id").count().where(F.col("count") >= min_product).select("product_id")
    return reviews.join(keep_users, "user_id", "left_semi").join(keep_products, "product_id", "left_semi")


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run; all rows if there are fewer."""
    draw = hash_uniform(*[F.col(c) for c in df.columns], seed=seed)
    order = [draw, *[F.col(c) for c in df.columns]]
    # Numbering needs a unique order, so equal rows are numbered as one and unfolded.
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    upto = running_sum(groups, [], order, F.col("_n"), "_upto")
    taken = F.least(F.col("_n"), F.lit(n) - (F.col("_upto") - F.col("_n")))
    kept = upto.withColumn("_take", taken).where(F.col("_take") > 0)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take")))).select(*df.columns)


def split_train_val_test(
    df: DataFrame, test: float = 0.2, validation: float = 0.25, seed: int = 42, sample_size: int = 1000
) -> dict[str, DataFrame]:
    """Train, validation and test parts by row hash, and a small sample of the whole.

    ``validation`` is a share of what the test part leaves. Every part filters
    the same column, so no row can be in two parts or in none.
    """
    tagged = tag_split(df, test, validation, seed)
    parts = {name: tagged.where(F.col("split") == name).drop("split") for name in ("train", "validation", "test")}
    return parts | {"sample": sample_rows(df, sample_size, seed)}


def tag_split(df: DataFrame, test: float = 0.2, validation: float = 0.25, seed: int = 42) -> DataFrame:
    draw = hash_uniform(*[F.col(c) for c in df.columns], seed=seed)
    return df.withColumn(
        "split",
        F.when(draw < test, "test").when(draw < test + (1 - test) * validation, "validation").otherwise("train"),
    )
