"""Derives the library's inputs from the given star-schema tables.

Every builder has a SQL twin in ``shelfwise.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed renaming of the source's event types to the library's.
EVENT_TYPES = {"signup": "add_to_cart", "click": "recommend_click", "error": "rating"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without text: one row per line item, written by the order's customer."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        (F.floor((F.col("l_quantity") - 1) / 10).cast("int") + 1).alias("rating"),
        F.col("l_linenumber").alias("votes"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.col("l_shipdate").cast("timestamp").alias("review_date"),
    )


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the product's name as their text."""
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("review_text")
    )
    return reviews(spark, sf_dir).join(names, "product_id")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("p_retailprice").alias("price"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("user_segment"),
        F.col("c_nationkey").alias("user_location"),
    )


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour events; ``event_id`` is their sequence."""
    kind = F.col("event_type")
    for old, new in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        (F.floor("value").cast("long") % 5 + 1).cast("double").alias("rating"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors in the role of user factors."""
    return vectors(spark, sf_dir).select(F.col("item_id").alias("user_id"), "features")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("item_id", "features")


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, model, score): four score tables taken from behaviour amounts."""
    per_pair = (
        behaviour(spark, sf_dir)
        .groupBy("user_id", F.col("product_id").alias("item_id"))
        .agg(F.sum("cents").alias("s"), F.max("cents").alias("hi"), F.min("cents").alias("lo"), F.count("*").alias("n"))
    )
    scored = F.array(
        F.struct(F.lit("lightgcn").alias("model"), (F.col("s") / 10000.0).alias("score")),
        F.struct(F.lit("content_based").alias("model"), (F.col("hi") / 10000.0).alias("score")),
        F.struct(F.lit("mf").alias("model"), (F.col("n") / 10.0).alias("score")),
        F.struct(F.lit("ncf").alias("model"), ((F.col("lo") - 300) / 1000000.0).alias("score")),
    )
    return per_pair.select("user_id", "item_id", F.explode(scored).alias("m")).select(
        "user_id", "item_id", F.col("m.model").alias("model"), F.col("m.score").alias("score")
    )
