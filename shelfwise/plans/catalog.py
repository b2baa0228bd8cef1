"""Every operator as a named query over the given tables.

A query takes (spark, sf_dir) and returns a DataFrame with plain columns; its
SQL twin, where there is one, has the same name in ``oracles``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import datasets as d
from ..functions import scalars
from ..functions.scalars import dot
from ..operators import (
    bandit,
    cleaning,
    coldstart,
    ensemble,
    evaluation,
    factors,
    features,
    graph,
    interactions,
    matching,
    pipeline,
    quality,
    ranking,
    sessions,
    store,
)
from ..session import cut_lineage, shared_path, tune
from ..sources import files, messages
from ..scale import dense_index
from ..streaming import jobs
from ..streaming.bandit import OnlineBandit, stream_linucb as bandit_stream
from ..streaming.behaviour import BehaviourWindow, stream_behaviour_window as behaviour_stream
from . import recommend
from .preprocess import preprocess as whole_run
from .oracles import STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2024-02-01 00:00:00"
AS_OF = "2024-01-15 12:00:00"


def nearest_decimal(c: Column, places: int) -> Column:
    """The same as ``F.round``, which turns every value into text and back.

    Only values near a tie, very large ones, NaN and infinities still take that way.
    """
    unit = F.lit(10.0**places)
    whole = F.rint(c * unit)
    apart = F.abs(F.abs(c * unit - whole) - 0.5)
    return F.when((F.abs(c * unit) < 2.0**40) & (apart > 0.001), whole / unit).otherwise(F.round(c, places))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns rounded, so that the order of additions does not show."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nearest_decimal(c.cast("double"), places) + F.lit(0.0)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(fn: Query, places: int = 6) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return rounded(fn(spark, sf_dir), places)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__.removesuffix("_")] = run
    return run


def finer_query(fn: Query) -> Query:
    """For results whose exact values have more than six decimals, where rounding would meet ties."""
    return query(fn, 12)


# ---------------------------------------------------------------- shared inputs


def sessioned(spark, sf):
    """Behaviour events in which ratings carry no session."""
    ev = d.behaviour(spark, sf)
    return ev.withColumn("session_id", F.when(F.col("event_type") != "rating", F.col("session_id")))


def lists(spark, sf, n=10):
    """Each user's best ``n`` per model."""
    return ensemble.top_per_model(d.model_scores(spark, sf), n)


def one_model(spark, sf, model="lightgcn"):
    return d.model_scores(spark, sf).where(F.col("model") == model)


def rating_events(spark, sf):
    """(user_id, item_id, rating): best rating per pair."""
    ev = d.behaviour(spark, sf).where(F.col("event_type") == "rating")
    return ev.groupBy("user_id", F.col("product_id").alias("item_id")).agg(F.max("rating").alias("rating"))


def review_pairs(spark, sf):
    """(user_id, item_id, rating): best rating per pair of the reviews."""
    return d.reviews(spark, sf).groupBy("user_id", F.col("product_id").alias("item_id")).agg(F.max("rating").alias("rating"))


def viewed(spark, sf):
    ev = d.behaviour(spark, sf).where(F.col("event_type") == "view")
    return ev.select("user_id", F.col("product_id").alias("item_id")).distinct()


def catalogue(spark, sf):
    return d.products(spark, sf).select(F.col("product_id").alias("item_id"), "category", "subcategory", "price")


def feedback(spark, sf):
    """Behaviour in the words of the feedback log."""
    kind = F.col("event_type")
    named = F.when(kind == "recommend_click", "click").when(kind == "view", "view_time").otherwise(kind)
    return d.behaviour(spark, sf).select(
        "event_id",
        "user_id",
        F.col("product_id").alias("item_id"),
        named.alias("event_type"),
        named.alias("feedback_type"),
        "rating",
        F.col("rating").alias("value"),
        (F.col("cents") / 100.0).alias("view_time_seconds"),
        F.when(F.col("cents") % 2 == 0, F.lit("mf")).alias("model_name"),
        "ts",
    )


def feature_rows(spark, sf):
    """Feature-store writes: the last product per kind of event of each user."""
    return d.behaviour(spark, sf).select(
        F.lit("user").alias("feature_type"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.concat("event_type", F.lit("_last")).alias("feature_name"),
        F.col("product_id").cast("string").alias("value"),
        F.col("ts").alias("updated_at"),
    )


def list_log(spark, sf):
    """Log of stored lists: each behaviour event stores one for its user."""
    return d.behaviour(spark, sf).select(
        "user_id",
        F.col("event_type").alias("model"),
        F.concat(F.lit("day:"), F.date_format("ts", "yyyy-MM-dd")).alias("context"),
        F.lit(10).alias("limit"),
        F.col("ts").alias("created_at"),
        (F.col("event_type") == "view").alias("cold_start"),
        "product_id",
    )


def bandit_log(spark, sf):
    v = d.vectors(spark, sf)
    return v.select(
        F.col("label").alias("arm"), F.slice("features", 1, 10).alias("context"), F.col("features")[10].alias("reward")
    )


def text_of_time(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


# ---------------------------------------------------------------- sources and sinks


@query
def read_reviews(spark, sf):
    raw = files.read_reviews(spark, f"{sf}/lineitem.parquet")
    return raw.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query
def write_table(spark, sf):
    path = shared_path(spark, "products")
    files.write_table(d.products(spark, sf), path, partition_by=["category"])
    return spark.read.parquet(path).select("product_id", "title", "category", "price")


@query
def validate_messages(spark, sf):
    typed = d.behaviour(spark, sf).withColumn("product_id", F.when(F.col("event_type") != "add_to_cart", F.col("product_id")))
    good, bad = messages.validate_messages(typed, "product_event")
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


@query
def write_messages(spark, sf):
    rows = d.behaviour(spark, sf).select("user_id", "product_id", "event_type", F.unix_millis("ts").alias("timestamp"))
    return messages.to_messages(rows, "product_event")


@query
def write_messages_files(spark, sf):
    """Messages that a stream has written to files."""
    path = shared_path(spark, "sent")
    rows = event_stream(spark, sf).select("user_id", "product_id", "event_type", F.unix_millis("ts").alias("timestamp"))
    messages.write_messages(rows, "product_event", f"{path}/checkpoint", path=f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(f"{path}/out")


@query
def read_events_stream(spark, sf):
    """Messages written as JSON text, read back as a stream."""
    rows = d.behaviour(spark, sf).select(
        "user_id", "product_id", "event_type", F.unix_millis("ts").alias("timestamp"), "session_id", "rating"
    )
    path = shared_path(spark, "messages")
    messages.to_messages(rows, "product_event").select("value").write.text(path)
    stream = messages.read_events_stream(spark, path)
    out = jobs.append_stream(stream.select("user_id", "product_id", "event_type", "session_id", "rating", "ts"), spark, "events")
    return text_of_time(out, "ts")


@query
def feedback_event_log(spark, sf):
    rows = feedback(spark, sf).withColumns(
        {"timestamp": F.col("ts"), "context": F.create_map(F.lit("model"), F.coalesce("model_name", F.lit("none")))}
    )
    log = messages.feedback_messages(rows)
    return text_of_time(
        log.select("user_id", "item_id", "event_type", "timestamp", "rating", log["context"]["model"].alias("model")), "timestamp"
    )


@query
def feedback_event_log_files(spark, sf):
    """The log that a stream of feedback has written, read back."""
    path = shared_path(spark, "feedback-log")
    rows = feedback(spark, sf).withColumns(
        {"timestamp": F.col("ts"), "context": F.create_map(F.lit("model"), F.coalesce("model_name", F.lit("none")))}
    )
    rows.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    writer = messages.feedback_event_log(stream, f"{path}/out", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema("user_id STRING, item_id STRING, event_type STRING, timestamp TIMESTAMP, context MAP<STRING, STRING>, rating DOUBLE").json(f"{path}/out")
    return text_of_time(
        log.select("user_id", "item_id", "event_type", "timestamp", "rating", log["context"]["model"].alias("model")), "timestamp"
    )


@query
def write_recommendations(spark, sf):
    path = shared_path(spark, "recommendations")
    files.write_recommendations(ranking.top_n_per_user(one_model(spark, sf), 10), path, "v1", NOW)
    rows = spark.read.parquet(path)
    return rows.select("user_id", "product_id", F.col("score").cast("double").alias("score"), "model_version", "clicked")


@query
def write_factors(spark, sf):
    path = shared_path(spark, "factors")
    files.write_factors(d.item_vectors(spark, sf), path)
    back = files.read_factors(spark, path)
    return back.select("item_id", F.posexplode("features").alias("pos", "value"))


@query
def table_page(spark, sf):
    return files.table_page(d.users(spark, sf), "user_id", 20, 50)


@query
def table_upsert(spark, sf):
    orders = d.table(spark, sf, "orders")
    changes = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderpriority").alias("user_segment"))
    return text_of_time(files.table_upsert(d.users(spark, sf), changes, "user_id", NOW), "updated_at")


@query
def table_delete(spark, sf):
    orders = d.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return files.table_delete(d.users(spark, sf), orders.select(F.col("o_custkey").alias("user_id")), "user_id")


@query
def shard_id(spark, sf):
    return d.users(spark, sf).select(
        "user_id",
        scalars.shard_id(F.col("user_id")).alias("shard_4"),
        scalars.shard_id(F.col("user_id"), 7).alias("shard_7"),
    )


@query
def sharded_write(spark, sf):
    path = shared_path(spark, "shards")
    files.sharded_write(d.users(spark, sf), path)
    return spark.read.parquet(path).select("user_id", "username", F.col("shard").cast("int").alias("shard"))


@query
def sharded_lookup(spark, sf):
    path = shared_path(spark, "shards")
    files.sharded_write(d.users(spark, sf), path)
    buyers = d.behaviour(spark, sf).where(F.col("event_type") == "purchase").select("user_id").distinct()
    return files.sharded_lookup(spark, path, buyers).select("user_id", "username")


# ---------------------------------------------------------------- projections


def raw_reviews(spark, sf):
    """Reviews under the names raw files use."""
    return d.text_reviews(spark, sf).select(
        F.col("product_id").alias("asin"),
        F.when(F.col("votes") < 7, F.col("user_id")).alias("Reviewer ID"),
        F.when(F.col("rating") == 3, "n/a").otherwise(F.col("rating").cast("string")).alias("overall"),
        F.nullif("review_text", F.lit("red bolt")).alias("reviewText"),
        F.unix_timestamp("review_date").alias("unixReviewTime"),
        F.col("votes").alias("helpful votes"),
    )


@query
def standardize_columns(spark, sf):
    return cleaning.standardize_columns(raw_reviews(spark, sf)).select(
        "product_id", "user_id", "rating", "review_text", "review_date", "helpful_votes"
    )


@query
def clean_reviews(spark, sf):
    clean = cleaning.clean_reviews(raw_reviews(spark, sf), NOW)
    return text_of_time(
        clean.select("product_id", "user_id", "rating", "review_text", "summary", "review_date", "verified_purchase", "votes"),
        "review_date",
    )


@query
def text_features(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", F.col("text").alias("review_text"), F.col("source").alias("summary"))
    return scalars.text_features(docs).drop("review_text", "summary")


@query
def temporal_features(spark, sf):
    rows = scalars.temporal_features(d.reviews(spark, sf), NOW)
    return text_of_time(rows.drop("rating", "verified_purchase"), "review_date")


@query
def interaction_features(spark, sf):
    rows = scalars.interaction_features(scalars.text_features(d.text_reviews(spark, sf)))
    return rows.select("user_id", "product_id", "rating_verified_interaction", "votes_per_length")


@query
def label_encode(spark, sf):
    items = d.products(spark, sf)
    return features.label_encode(items, items, ["category", "subcategory"]).select(
        "product_id", "category_encoded", "subcategory_encoded"
    )


@query
def standard_scale(spark, sf):
    rows = d.reviews(spark, sf)
    return features.standard_scale(rows, rows, ["rating", "votes"]).select("user_id", "product_id", "rating_scaled", "votes_scaled")


@query
def minmax_scale(spark, sf):
    rows = d.reviews(spark, sf)
    return features.minmax_scale(rows, rows, ["rating", "votes"]).select("user_id", "product_id", "rating_normalized", "votes_normalized")


@query
def tfidf_features(spark, sf):
    docs = d.documents(spark, sf).select("doc_id", "text")
    return features.tfidf_features(docs, docs, "doc_id", "text", stop_words=STOP_WORDS)


def fitted_pipeline(spark, sf):
    """Fitted on the products with an even key, stored."""
    items = d.products(spark, sf)
    path = shared_path(spark, "pipeline")
    known = items.where(F.col("product_id") % 2 == 0)
    pipeline.FeaturePipeline(spark, path, texts=["title"], stop_words=STOP_WORDS, min_df=0.002).fit(known, "product_id")
    return pipeline.FeaturePipeline(spark, path, texts=["title"], stop_words=STOP_WORDS, min_df=0.002), items


@query
def feature_pipeline(spark, sf):
    """Codes and scaled prices of all products by the stored fit."""
    fitted, items = fitted_pipeline(spark, sf)
    return fitted.transform(items).select("product_id", "category_encoded", "subcategory_encoded", "price_scaled", "price_normalized")


@query
def feature_pipeline_texts(spark, sf):
    """Term weights of all titles by the stored fit."""
    fitted, items = fitted_pipeline(spark, sf)
    return fitted.text_weights(items, "product_id", "title")


@query
def preprocess(spark, sf):
    """All four tables of a preprocessing run over raw reviews."""
    parts = whole_run(
        raw_reviews(spark, sf), shared_path(spark, "preprocessed"), min_user=20, min_product=15, small=100, now=NOW,
        columns=["user_id", "product_id", "rating"],
    )
    tables = [rows.select(F.lit(name).alias("part"), "user_id", "product_id", "rating") for name, rows in parts.items()]
    return functools.reduce(DataFrame.unionByName, tables)


@query
def normalize_ratings(spark, sf):
    return features.normalize_ratings(d.reviews(spark, sf), epsilon=1e-10).select("user_id", "product_id", "normalized_rating")


@query
def vector_normalize(spark, sf):
    v = d.vectors(spark, sf)
    return v.select("item_id", F.posexplode(scalars.vector_normalize(F.col("features"))).alias("pos", "value"))


@query
def cosine_similarity(spark, sf):
    """Every vector against the next one."""
    v = d.vectors(spark, sf)
    other = v.select((F.col("item_id") - 1).alias("item_id"), F.col("features").alias("following"))
    return v.join(other, "item_id").select(
        "item_id", scalars.cosine_similarity(F.col("features"), F.col("following")).alias("similarity")
    )


@query
def feedback_to_rating(spark, sf):
    return scalars.feedback_to_rating(feedback(spark, sf)).select("event_id", "target_rating", "target_weight")


@query
def event_weights(spark, sf):
    rows = scalars.event_weights(d.behaviour(spark, sf))
    return rows.groupBy("user_id").agg(F.sum("event_weight").alias("weight"), F.count("event_weight").alias("events"))


@query
def ncf_score_rescale(spark, sf):
    return ensemble.ncf_score_rescale(one_model(spark, sf, "ncf")).select("user_id", "item_id", "score")


@query
def rank_to_score(spark, sf):
    return scalars.rank_to_score(ranking.top_n_per_user(one_model(spark, sf), 10)).select("user_id", "item_id", "score")


@query
def activity_level(spark, sf):
    counts = interactions.seen_products(d.behaviour(spark, sf)).groupBy("user_id").agg(F.count("*").alias("products"))
    return scalars.activity_level(counts)


@query
def score_threshold(spark, sf):
    return ranking.score_threshold(one_model(spark, sf), 0.01, 10).select("user_id", "item_id", "score", "rank")


@query
def parse_json_payload(spark, sf):
    rows = scalars.parse_json_payload(d.table(spark, sf, "events"), "props", "k INT")
    return rows.select("event_id", F.col("props.k").alias("k"))


@query
def format_ranking_text(spark, sf):
    rows = d.behaviour(spark, sf).select(
        "event_id", "user_id", F.col("product_id").alias("item_id"), F.create_map(F.lit("source"), "event_type").alias("context")
    )
    names = d.users(spark, sf).select("user_id", F.col("username").alias("user_text"))
    return scalars.format_ranking_text(rows, users=names, context="context").select("event_id", "ranking_text")


# ---------------------------------------------------------------- joins


@query
def filter_min_activity(spark, sf):
    return cleaning.filter_min_activity(d.reviews(spark, sf), 45, 32).select("user_id", "product_id", "rating", "votes")


@query
def map_ids(spark, sf):
    """Reviews under the index numbers of the users and products that have behaviour events."""
    ev = d.behaviour(spark, sf)
    users = dense_index(ev, "user_id", "user_idx")
    items = dense_index(ev, "product_id", "item_idx").withColumnRenamed("product_id", "item_id")
    rows = review_pairs(spark, sf)
    return interactions.map_ids(rows, users, items).select("user_idx", "item_idx", "rating")


@query
def exclude_seen(spark, sf):
    return interactions.exclude_seen(review_pairs(spark, sf), viewed(spark, sf))


@query
def sample_negatives(spark, sf):
    return interactions.sample_negatives(review_pairs(spark, sf), 4, "user").select("user_id", "item_id", "draw_id")


@query
def sample_negatives_per_row(spark, sf):
    return interactions.sample_negatives(review_pairs(spark, sf), 1, "row").select("user_id", "item_id", "draw_id")


@query
def cooccurrence_feedback(spark, sf):
    return interactions.cooccurrence_feedback(sessioned(spark, sf))


@query
def cooccurrence_realtime(spark, sf):
    return interactions.cooccurrence_realtime(sessioned(spark, sf))


@query
def suffix_weight_sum(spark, sf):
    return interactions.suffix_weight_sum(sessioned(spark, sf)).select("event_id", "user_id", "suffix_weight")


@query
def score_all_pairs(spark, sf):
    return matching.score_all_pairs(d.user_vectors(spark, sf), d.item_vectors(spark, sf))


@query
def score_pairs(spark, sf):
    pairs = d.behaviour(spark, sf).select("event_id", "user_id", F.col("product_id").alias("item_id"))
    return interactions.score_pairs(pairs, d.user_vectors(spark, sf), d.item_vectors(spark, sf)).select("event_id", "score")


@query
def attach_verified_counts(spark, sf):
    return features.attach_verified_counts(d.reviews(spark, sf), "product_id")


@query
def pairwise_jaccard(spark, sf):
    return evaluation.pairwise_jaccard(ranking.top_n_per_user(one_model(spark, sf), 10))


@query
def pairwise_jaccard_models(spark, sf):
    return evaluation.pairwise_jaccard(lists(spark, sf), "model")


@query
def attribute_feedback(spark, sf):
    return ensemble.attribute_feedback(feedback(spark, sf), lists(spark, sf)).select("event_id", "model", "event_type", "model_score")


@query
def entity_join(spark, sf):
    joined = interactions.entity_join(d.reviews(spark, sf), d.products(spark, sf), "product_id")
    return joined.groupBy("category", "subcategory").agg(F.count("*").alias("reviews"), F.avg("rating").alias("rating"))


# ---------------------------------------------------------------- aggregations


@query
def product_features(spark, sf):
    return features.product_features(d.reviews(spark, sf))


@query
def user_features(spark, sf):
    return features.user_features(d.reviews(spark, sf))


@query
def user_item_ratings(spark, sf):
    return interactions.user_item_ratings(d.reviews(spark, sf))


@query
def item_popularity(spark, sf):
    return interactions.item_popularity(d.behaviour(spark, sf))


@query
def user_activity(spark, sf):
    return interactions.user_activity(d.behaviour(spark, sf))


def labelled(spark, sf):
    docs = d.table(spark, sf, "documents")
    return docs.join(d.table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


@query
def missing_values(spark, sf):
    return quality.missing_values(labelled(spark, sf))


@query
def duplicate_rows(spark, sf):
    return quality.duplicate_rows(d.reviews(spark, sf), ["user_id", "product_id"])


@query
def duplicate_rows_all(spark, sf):
    return quality.duplicate_rows(d.table(spark, sf, "documents").drop("doc_id"))


@query
def numeric_profile(spark, sf):
    lines = d.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    return rounded(quality.numeric_profile(lines), 4)


@query
def categorical_profile(spark, sf):
    docs = d.table(spark, sf, "documents").select("lang", "source", "text")
    return quality.categorical_profile(docs)


@query
def consistency_check(spark, sf):
    return quality.consistency_check(d.reviews(spark, sf), "2000-01-01")


@query
def invalid_ratings(spark, sf):
    """Quantities in the role of ratings: most are none."""
    rows = d.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("rating"))
    return quality.invalid_ratings(rows)


@query
def relationship_check(spark, sf):
    return quality.relationship_check(d.text_reviews(spark, sf))


@query
def temporal_profile(spark, sf):
    return quality.temporal_profile(d.reviews(spark, sf))


@query
def quality_summary(spark, sf):
    rows = d.reviews(spark, sf)
    return quality.quality_summary(
        quality.missing_values(labelled(spark, sf)),
        quality.duplicate_rows(rows, ["user_id", "product_id"]),
        quality.consistency_check(rows, "2000-01-01"),
    )


@query
def product_event_features(spark, sf):
    return features.product_event_features(d.behaviour(spark, sf))


@query
def user_event_features(spark, sf):
    rows = features.user_event_features(d.behaviour(spark, sf))
    shown = rows.withColumns(
        {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("recent_views", "purchased_products")}
    )
    return text_of_time(shown, "last_active")


@query
def event_type_metrics(spark, sf):
    return features.event_type_metrics(d.behaviour(spark, sf))


@query
def feedback_stats(spark, sf):
    return features.feedback_stats(d.behaviour(spark, sf))


@query
def evaluate_rating_error(spark, sf):
    return evaluation.evaluate_rating_error(one_model(spark, sf), rating_events(spark, sf))


@query
def evaluate_topk(spark, sf):
    return evaluation.evaluate_topk(ranking.top_n_per_user(one_model(spark, sf), 20), rating_events(spark, sf))


@query
def precision_recall_ndcg(spark, sf):
    relevant = rating_events(spark, sf).where(F.col("rating") >= 4)
    return evaluation.precision_recall_ndcg(ranking.top_n_per_user(one_model(spark, sf), 10), relevant)


@query
def recs_diversity_coverage(spark, sf):
    return evaluation.recs_diversity_coverage(ranking.top_n_per_user(one_model(spark, sf), 10), catalogue(spark, sf))


@query
def personalization(spark, sf):
    return evaluation.personalization(ranking.top_n_per_user(one_model(spark, sf), 10))


@query
def recs_distribution(spark, sf):
    return evaluation.recs_distribution(lists(spark, sf))


@query
def ab_readiness(spark, sf):
    top = lists(spark, sf)
    return evaluation.ab_readiness(evaluation.model_jaccard(top), evaluation.recs_distribution(top))


@query
def model_metric_average(spark, sf):
    per_model = d.model_scores(spark, sf).groupBy("model").agg(F.avg("score").alias("mean_score"), F.max("score").alias("best_score"))
    rows = per_model.select(
        "model",
        F.expr("stack(2, 'mean_score', mean_score, 'best_score', best_score) as (metric_name, metric_value)"),
    )
    return evaluation.model_metric_average(rows)


def fit_residuals(log, fitted):
    """The summed rewards b of each arm, and how far the fitted weights are from solving (I + X'X) theta = b."""
    x = F.transform(F.slice("context", 1, 10), lambda v: v.cast("double"))
    rows = log.join(fitted.select("arm", "theta"), "arm").withColumn("x", x).withColumn("fit", dot(F.col("x"), F.col("theta")))
    sums = rows.select("arm", "theta", "fit", "reward", F.posexplode("x").alias("pos", "v")).groupBy("arm", "pos").agg(
        F.sum(F.col("v") * F.col("reward")).alias("b"), F.sum(F.col("v") * F.col("fit")).alias("ax"), F.first(F.get("theta", F.col("pos"))).alias("theta")
    )
    return sums.select("arm", "pos", F.round("b", 6).alias("reward_sum"), F.round(F.abs(F.col("ax") + F.col("theta") - F.col("b")), 6).alias("residual"))


@query
def linucb_fit(spark, sf):
    log = bandit_log(spark, sf)
    return fit_residuals(log, bandit.linucb_fit(log))


@query
def stream_linucb(spark, sf):
    """Arms that a stream of four batches has fitted."""
    path = shared_path(spark, "bandit")
    log = bandit_log(spark, sf)
    log.repartition(4).write.parquet(f"{path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    state = OnlineBandit(spark, f"{path}/state", stream, buckets=8)
    bandit_stream(stream, state, f"{path}/checkpoint", None).start().awaitTermination()
    return fit_residuals(log, state.arms.read())


@query
def linucb_select_fitted(spark, sf):
    """The whole way in two dimensions: fit on the log, then an arm for every context."""
    log = bandit_log(spark, sf)
    contexts = d.vectors(spark, sf).select("item_id", F.slice("features", 1, 2).alias("context"))
    return bandit.linucb_select(contexts, bandit.linucb_fit(log, 2)).select("item_id", "arm", "ucb")


@query
def linucb_select(spark, sf):
    """Arms with the mean context as weights and a scaled unit matrix as spread."""
    log = bandit_log(spark, sf)
    n = F.count("*")
    mean = F.array(*[F.avg(F.get("context", F.lit(i))) for i in range(10)])
    square = F.array(*[F.array(*[(F.lit(1.0) if i == j else F.lit(0.0)) / n for j in range(10)]) for i in range(10)])
    arms = log.groupBy("arm").agg(mean.alias("theta"), square.alias("a_inv"))
    contexts = d.vectors(spark, sf).select("item_id", F.slice("features", 1, 10).alias("context"))
    return bandit.linucb_select(contexts, arms).select("item_id", "arm", "ucb")


@query
def arm_stats(spark, sf):
    return bandit.arm_stats(bandit_log(spark, sf))


@query
def model_success_weights(spark, sf):
    attributed = ensemble.attribute_feedback(feedback(spark, sf), lists(spark, sf))
    return ensemble.model_success_weights(attributed, ensemble.MINMAX_WEIGHTS)


@query
def user_model_weights(spark, sf):
    attributed = ensemble.attribute_feedback(feedback(spark, sf), lists(spark, sf))
    return ensemble.user_model_weights(attributed, ensemble.MINMAX_WEIGHTS)


# ---------------------------------------------------------------- windows, limits, samples


@query
def top_n_per_user(spark, sf):
    return ranking.top_n_per_user(one_model(spark, sf), 10).select("user_id", "item_id", "score", "rank")


@query
def top_popular(spark, sf):
    return ranking.top_popular(d.behaviour(spark, sf), 20)


@query
def factor_popularity(spark, sf):
    return ranking.factor_popularity(d.item_vectors(spark, sf))


@query
def popularity_by_demographic(spark, sf):
    rows = d.reviews(spark, sf).join(d.users(spark, sf), "user_id")
    return ranking.popularity_by_demographic(rows, "user_location", 20, None)


@query
def popularity_by_category(spark, sf):
    counts = d.reviews(spark, sf).groupBy(F.col("product_id").alias("item_id")).agg(F.count("*").alias("interactions"))
    return ranking.popularity_by_category(catalogue(spark, sf), counts)


@query
def latest_per_key(spark, sf):
    rows = d.behaviour(spark, sf).select("user_id", "event_type", "event_id", "product_id", "ts")
    out = ranking.latest_per_key(rows, ["user_id", "event_type"], ["event_id"], 10 * 86400, NOW)
    return out.select("user_id", "event_type", "event_id", "product_id")


@query
def sample_rows(spark, sf):
    return cleaning.sample_rows(d.products(spark, sf).select("product_id", "title"), 100)


@query
def split_train_val_test(spark, sf):
    return cleaning.tag_split(d.products(spark, sf).select("product_id", "title")).drop("title")


@query
def split_parts(spark, sf):
    """All four tables of the split."""
    parts = cleaning.split_train_val_test(d.products(spark, sf).select("product_id", "title"), sample_size=100)
    tables = [rows.select(F.lit(name).alias("part"), "product_id", "title") for name, rows in parts.items()]
    return functools.reduce(DataFrame.unionByName, tables)


# ---------------------------------------------------------------- set operations


@query
def fill_from_popular(spark, sf):
    """Short own lists of viewed items, filled with popular ones."""
    own = ranking.top_n_per_user(one_model(spark, sf, "content_based").where(F.col("score") > 0.15), 5)
    return ranking.fill_from_popular(own, ranking.top_popular(d.behaviour(spark, sf), 40), viewed(spark, sf), 15)


@query
def merge_popular(spark, sf):
    by_events = ranking.top_popular(d.behaviour(spark, sf), 20)
    return ranking.merge_popular(by_events, ranking.factor_popularity(d.item_vectors(spark, sf), 100), 20)


@query
def append_rows(spark, sf):
    return interactions.with_negatives(review_pairs(spark, sf), 4)


@query
def hits(spark, sf):
    relevant = rating_events(spark, sf).where(F.col("rating") >= 4)
    return interactions.hits(ranking.top_n_per_user(one_model(spark, sf), 20), relevant, 10).select("user_id", "item_id", "rank")


@query
def unseen_items(spark, sf):
    ev = d.behaviour(spark, sf).select("user_id", F.col("product_id").alias("item_id"))
    return interactions.unseen_items(ev, ev, ev)


# ---------------------------------------------------------------- models


@query
def mf_recommend(spark, sf):
    rows = one_model(spark, sf).select("user_id", "item_id", F.col("score").alias("rating"))
    u, i = factors.mf_fit(rows)
    return factors.mf_recommend(u, i, 10)


def equation_gaps(ratings, users, items, reg=0.1):
    """(user_id, ratings, solved): whether each user's factors solve the regularised least squares over the user's ratings."""
    own = users.select("user_id", F.col("features").cast("array<double>").alias("u"))
    other = items.select("item_id", F.col("features").cast("array<double>").alias("v"))
    rows = ratings.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).join(own, "user_id").join(other, "item_id")
    miss = rows.withColumn("miss", dot(F.col("u"), F.col("v")) - F.col("rating"))
    per_axis = miss.select("user_id", "rating", "miss", "u", F.posexplode("v").alias("pos", "x")).groupBy("user_id", "pos").agg(
        F.sum(F.col("miss") * F.col("x")).alias("g"), F.count("*").alias("n"), F.first(F.get("u", F.col("pos"))).alias("w"), F.sum(F.abs(F.col("rating") * F.col("x"))).alias("size")
    )
    gap = F.abs(F.col("g") + reg * F.col("n") * F.col("w")) <= 1e-4 * (1 + F.col("size"))
    return per_axis.groupBy("user_id").agg(F.max("n").alias("ratings"), F.every(gap).alias("solved"))


def score_ratings(spark, sf):
    return one_model(spark, sf).select("user_id", "item_id", F.col("score").alias("rating"))


@query
def mf_fit(spark, sf):
    """Whether every user's factors solve the last half-step of the fit."""
    rows = cut_lineage(score_ratings(spark, sf), "ratings")
    users, items = factors.mf_fit(rows)
    return equation_gaps(rows, users, items)


@query
def mf_update(spark, sf):
    """A fit on nine tenths of the ratings, updated with the rest: the users of the batch and their equations."""
    rows = cut_lineage(score_ratings(spark, sf), "ratings")
    late = (F.col("user_id") + F.col("item_id")) % 10 == 0
    history, batch = rows.where(~late), rows.where(late)
    users, items = factors.mf_fit(history, rank=20, max_iter=10)
    users, items = factors.mf_update(users, items, history, batch)
    return equation_gaps(rows.join(batch.select("user_id").distinct(), "user_id", "left_semi"), users, items)


@query
def graph_normalize(spark, sf):
    ev = d.behaviour(spark, sf).select("user_id", F.col("product_id").alias("item_id"))
    return graph.graph_normalize(ev)


@query
def graph_propagate(spark, sf):
    """The given vectors on users and items alike, two rounds."""
    ev = d.behaviour(spark, sf).select("user_id", F.col("product_id").alias("item_id"))
    v = d.vectors(spark, sf)
    start = v.select(graph.user_node(F.col("item_id")).alias("node"), "features").unionByName(
        v.select(graph.item_node(F.col("item_id")).alias("node"), "features")
    )
    out = graph.graph_propagate(start, cut_lineage(graph.graph_normalize(ev), "edges"), 2, 64)
    return out.select("node", F.posexplode("features").alias("pos", "value"))


@query
def lightgcn_fit(spark, sf):
    rows = d.behaviour(spark, sf).select("user_id", F.col("product_id").alias("item_id"), "rating")
    u, i = graph.lightgcn_fit(rows)
    return matching.recommend(u, i, 10)


@query
def ncf_gmf_fit(spark, sf):
    rows = review_pairs(spark, sf)
    u, i, weights, intercept = factors.ncf_gmf_fit(rows)
    return factors.ncf_gmf_score(rows.select("user_id", "item_id"), u, i, weights, intercept)


@query
def content_factors(spark, sf):
    f = factors.content_factors(catalogue(spark, sf))
    return f.select("item_id", F.posexplode("features").alias("pos", "value"))


@query
def content_components(spark, sf):
    """(a, b, shared): that two components have nothing in common, and (a, a, ...) that they come in falling order, over all items."""
    rows = cut_lineage(factors.content_factors(catalogue(spark, sf)), "content")
    left = rows.select("item_id", F.posexplode("features").alias("a", "x"))
    right = rows.select("item_id", F.posexplode("features").alias("b", "y"))
    sums = left.join(right, "item_id").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    energy = sums.where("a = b").select("a", "s", F.lead("s").over(W.orderBy("a")).alias("next"))
    own = energy.select("a", F.col("a").alias("b"), F.coalesce(F.col("s") >= F.col("next") - 1e-6, F.lit(True)).alias("holds"))
    return own.unionByName(sums.where("a < b").select("a", "b", (F.abs("s") < 1e-6).alias("holds")))


@query
def content_user_profiles(spark, sf):
    profiles = factors.content_user_profiles(review_pairs(spark, sf), d.item_vectors(spark, sf))
    return profiles.select("user_id", F.posexplode("features").alias("pos", "value"))


@query
def content_recommend(spark, sf):
    profiles = factors.content_user_profiles(review_pairs(spark, sf), d.item_vectors(spark, sf))
    return factors.content_recommend(profiles, d.item_vectors(spark, sf), 10)


@query
def similar_products(spark, sf):
    return matching.similar_products(d.item_vectors(spark, sf))


@query
def item_clusters(spark, sf):
    return factors.item_clusters(d.item_vectors(spark, sf))


@query
def incremental_feedback_batch(spark, sf):
    rows = factors.incremental_feedback_batch(feedback(spark, sf), ["lightgcn", "mf"])
    return rows.groupBy("model", "user_id", "item_id").agg(F.sum("rating").alias("rating"), F.sum("weight").alias("weight"))


# ---------------------------------------------------------------- recommendation stages


@query
def generate_candidates(spark, sf):
    return matching.generate_candidates(d.users(spark, sf), d.user_vectors(spark, sf), d.item_vectors(spark, sf), limit=100)


@query
def filter_candidates(spark, sf):
    found = one_model(spark, sf).select("user_id", "item_id", "score")
    return matching.filter_candidates(
        found, catalogue(spark, sf), F.col("price") < 905, ranking.top_popular(d.behaviour(spark, sf), 100), 60
    ).select("user_id", "item_id", "rank")


@query
def rank_candidates(spark, sf):
    found = ranking.top_n_per_user(one_model(spark, sf), 20)
    return matching.rank_candidates(found, F.col("score") * (1 + F.col("item_id") % 7)).select(
        "user_id", "item_id", "score", "original_score", "rank"
    )


@query
def rank_text_pairs(spark, sf):
    """Text pairs scored by a model that reads text; here their lengths stand in for it."""
    found = ranking.top_n_per_user(one_model(spark, sf), 20)
    return matching.rank_candidates(found, lambda text: F.length(text).cast("double")).select(
        "user_id", "item_id", "score", "original_score", "rank"
    )


@finer_query
def ensemble_weighted_rank(spark, sf):
    return ensemble.ensemble_weighted_rank(lists(spark, sf))


@finer_query
def diversity_penalty(spark, sf):
    return ensemble.diversity_penalty(ranking.top_n_per_user(one_model(spark, sf), 20)).select("user_id", "item_id", "score", "rank")


@query
def hybrid_weighted_scores(spark, sf):
    return ensemble.hybrid_weighted_scores(one_model(spark, sf), one_model(spark, sf, "content_based"))


@query
def hybrid_rank_blend(spark, sf):
    return ensemble.hybrid_rank_blend(d.model_scores(spark, sf))


@query
def ensemble_minmax(spark, sf):
    return ensemble.ensemble_minmax(d.model_scores(spark, sf))


def cold_users(spark, sf):
    """Customers; preferred categories are the two the user's order statuses point to."""
    prefer = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "P", "ECONOMY").otherwise("SMALL"))).alias("preferred_categories")
    )
    users = d.users(spark, sf).select("user_id", "user_location")
    return users.join(prefer, "user_id", "left").withColumn(
        "preferred_categories", F.coalesce("preferred_categories", F.array())
    )


def cold_tables(spark, sf):
    ratings = d.reviews(spark, sf).join(d.users(spark, sf).select("user_id", "user_location"), "user_id")
    clusters = d.vectors(spark, sf).select(F.col("label").alias("cluster"), "item_id").withColumn(
        "rank", F.row_number().over(W.partitionBy("cluster").orderBy("item_id"))
    )
    return coldstart.refresh_cold_start(ratings, catalogue(spark, sf), clusters, sample=None)


@query
def cold_start_popularity(spark, sf):
    return coldstart.cold_start_popularity(cold_users(spark, sf), cold_tables(spark, sf)["popularity"])


@query
def cold_start_category(spark, sf):
    return coldstart.cold_start_category(cold_users(spark, sf), cold_tables(spark, sf)["category"])


@query
def cold_start_diversity(spark, sf):
    return coldstart.cold_start_diversity(cold_users(spark, sf), cold_tables(spark, sf)["clusters"], 25)


@query
def cold_start_random(spark, sf):
    return coldstart.cold_start_random(cold_users(spark, sf), catalogue(spark, sf))


@query
def cold_start_recommend(spark, sf):
    return coldstart.cold_start_recommend(
        cold_users(spark, sf), cold_tables(spark, sf), ("category", "popularity", "diversity", "random"), 15
    )


@query
def recommend_or_cold_start(spark, sf):
    known = ranking.top_n_per_user(one_model(spark, sf), 10)
    cold = coldstart.cold_start_popularity(d.users(spark, sf).select("user_id"), cold_tables(spark, sf)["popularity"])
    return coldstart.recommend_or_cold_start(d.users(spark, sf), known, cold)


@query
def refresh_cold_start(spark, sf):
    return cold_tables(spark, sf)["popularity"]


@query
def refresh_cold_start_tables(spark, sf):
    """The category, item and cluster tables of a refresh."""
    tables = cold_tables(spark, sf)
    shape = lambda name, key, rank: tables[name].select(F.lit(name).alias("feature"), key.cast("string").alias("value"), "item_id", rank.cast("int").alias("rank"))
    none = F.lit(None)
    category = shape("category", F.col("category"), F.col("rank"))
    return category.unionByName(shape("items", none, none)).unionByName(shape("clusters", F.col("cluster"), F.col("rank")))


@query
def update_recommendations(spark, sf):
    ev = d.behaviour(spark, sf)
    return recommend.update_recommendations(ev, ranking.top_popular(ev, 100), 100)


@query
def update_recommendations_merged(spark, sf):
    """Lists that are filled with viewed items first and then with those of large factors."""
    ev = d.behaviour(spark, sf)
    model = ranking.factor_popularity(d.item_vectors(spark, sf), 100)
    return recommend.update_recommendations(ev, ranking.top_popular(ev, 60), 100, model_popular=model)


@query
def behaviour_recommendations(spark, sf):
    return recommend.behaviour_recommendations(d.behaviour(spark, sf), 100, 60, 11)


@query
def recs_snapshot(spark, sf):
    out = store.recs_snapshot(list_log(spark, sf), "2024-01-15 12:00:00")
    return text_of_time(out.select("user_id", "model", "context", "product_id", "expires_at"), "expires_at")


@query
def recs_invalidate(spark, sf):
    kept = store.recs_invalidate(store.recs_snapshot(list_log(spark, sf), "2024-01-01 00:00:00"), model="purchase")
    return kept.select("user_id", "model", "context", "product_id")


@query
def recs_snapshot_stats(spark, sf):
    return store.recs_snapshot_stats(store.recs_snapshot(list_log(spark, sf), "2024-01-15 12:00:00"))


# ---------------------------------------------------------------- feature store


@query
def set_features(spark, sf):
    out = store.set_features(None, feature_rows(spark, sf), 86400)
    return text_of_time(out.drop("feature_type"), "updated_at", "expires_at")


@query
def get_features(spark, sf):
    held = store.set_features(None, feature_rows(spark, sf), 86400)
    return store.get_features(held, "user", ["view_last", "purchase_last"], "2024-01-30 12:00:00")


@query
def all_features(spark, sf):
    held = store.set_features(None, feature_rows(spark, sf))
    out = store.all_features(held, "user")
    return out.select("entity_id", F.explode("features").alias("feature_name", "value"))


@query
def set_vector(spark, sf):
    rows = d.vectors(spark, sf).select(
        F.lit("product").alias("feature_type"),
        F.col("item_id").cast("string").alias("entity_id"),
        F.lit("embedding").alias("feature_name"),
        F.col("features").cast("array<float>").alias("vector"),
        F.lit(NOW).cast("timestamp").alias("updated_at"),
    )
    out = store.get_vector(store.set_vector(None, rows), "product", "embedding")
    return out.select("entity_id", F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "value"))


@query
def increment_features(spark, sf):
    held = store.set_features(None, feature_rows(spark, sf))
    deltas = feature_rows(spark, sf).select("feature_type", "entity_id", "feature_name", F.lit(1.5).alias("delta"))
    out = store.increment_features(held, deltas, NOW)
    return out.select("entity_id", "feature_name", F.col("value").cast("double").alias("value"))


@query
def delete_features(spark, sf):
    held = store.set_features(None, feature_rows(spark, sf))
    return store.delete_features(held, "user", "3").select("entity_id", "feature_name", "value")


@query
def feature_stats(spark, sf):
    return store.feature_stats(store.set_features(None, feature_rows(spark, sf)), "user")


@query
def list_entities(spark, sf):
    return store.list_entities(store.set_features(None, feature_rows(spark, sf)), "user", "1.*")


# ---------------------------------------------------------------- sessions, drift, streams


@query
def session_stats(spark, sf):
    return text_of_time(sessions.session_stats(d.behaviour(spark, sf)), "start_time", "last_time")


@query
def behaviour_window(spark, sf):
    return sessions.behaviour_window(d.behaviour(spark, sf), AS_OF, 240)


@query
def drift_detect(spark, sf):
    ev = d.behaviour(spark, sf)
    baseline = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    return sessions.drift_detect(ev, baseline, AS_OF, 600, 0.02)


@query
def metrics_rows(spark, sf):
    rows = features.metrics_rows(sessions.behaviour_window(d.behaviour(spark, sf), AS_OF, 240), {"source": "batch"}, NOW)
    return rows.select("metric_name", "metric_value", rows["tags"]["source"].alias("source"))


def event_stream(spark, sf):
    """Behaviour events as a file stream of messages with typed columns."""
    path = shared_path(spark, "stream")
    d.behaviour(spark, sf).repartition(4, "user_id").write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


FILE_ROWS = 250_000


def files_per_batch(counts):
    """Files that each of the batches is dealt to, about ``FILE_ROWS`` rows each; the same for all, as the stream counts files.

    No file may be missing because it is empty: a batch has 10,000 rows for each, so that
    some task that deals it out has a row for every file.
    """
    return max(1, min(-(-max(counts) // FILE_ROWS), min(counts) // 10_000))


def ordered_stream(spark, events, by="event_id", files=3):
    """Events as a stream of ``files`` batches that hold successive events."""
    path, order = shared_path(spark, "stream"), F.expr(by)
    ends = events.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(order).alias("n")).first()
    place = F.floor((order - ends["lo"]) * files / (ends["hi"] - ends["lo"] + 1))
    counts = [ends["n"]]
    if ends["n"] > FILE_ROWS:
        found = {r[0]: r[1] for r in events.groupBy(place.alias("k")).count().collect()}
        counts = [found.get(k, 0) for k in range(files)]
    each = files_per_batch(counts)
    for k in range(files):  # one after the other: a stream takes files by their time
        batch = events.where(place == k)
        dealt = batch.coalesce(1) if each == 1 else batch.repartition(each)
        dealt.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", each).parquet(path)


@query
def stream_session_stats(spark, sf):
    """Sessions closed by the watermark; one batch takes all files."""
    path = shared_path(spark, "stream")
    d.behaviour(spark, sf).repartition("user_id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = jobs.append_stream(jobs.session_stats_stream(stream), spark, "sessions")
    return text_of_time(out, "start_time", "last_time")


@query
def stream_behaviour_window(spark, sf):
    """The statistics at the newest event of each of three batches."""
    path = shared_path(spark, "live-behaviour")
    events = ordered_stream(spark, d.behaviour(spark, sf), "unix_micros(ts)")
    state = BehaviourWindow(spark, f"{path}/state", events, 240, buckets=16)
    behaviour_stream(events, state, f"{path}/checkpoint", None).start().awaitTermination()
    return text_of_time(state.summaries(), "as_of")


@query
def drift_timeline(spark, sf):
    ev = d.behaviour(spark, sf)
    baseline = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    return text_of_time(sessions.drift_timeline(ev, baseline, 240, 30, 0.1), "start", "end")


@query
def stream_drift_timeline(spark, sf):
    """Windows that the watermark has closed."""
    ev = d.behaviour(spark, sf)
    baseline = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    stream = ordered_stream(spark, ev, "unix_micros(ts)")
    windows = sessions.drift_timeline(stream.withWatermark("ts", "10 minutes"), baseline, 240, 30, 0.1)
    return text_of_time(jobs.append_stream(windows, spark, "drift"), "start", "end")


@query
def stream_product_features(spark, sf):
    return jobs.update_stream(jobs.stream_product_features(event_stream(spark, sf)), "product_id", spark, "product-features")


@query
def stream_user_features(spark, sf):
    path = shared_path(spark, "user-features")
    events = event_stream(spark, sf)
    table = jobs.user_table(spark, f"{path}/table", events)
    jobs.stream_user_features(events, table, f"{path}/checkpoint", None).start().awaitTermination()
    shown = table.read().withColumns(
        {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("recent_views", "purchased_products")}
    )
    return text_of_time(shown, "last_active")


@query
def stream_update_recommendations(spark, sf):
    """The state after all batches; users of earlier batches get their lists by the newest relation, too."""
    path = shared_path(spark, "live-recs")
    events = event_stream(spark, sf)
    state = jobs.LiveRecommendations(spark, f"{path}/state", events, 100, buckets=16)
    jobs.stream_update_recommendations(events, state, f"{path}/checkpoint", None).start().awaitTermination()
    return state.all_lists()


@query
def stream_item_relation(spark, sf):
    """The item relation that the batches of a stream leave."""
    path = shared_path(spark, "live-relation")
    events = ordered_stream(spark, sessioned(spark, sf))
    state = jobs.LiveRecommendations(spark, f"{path}/state", events, 10, buckets=16, keep_lists=False)
    jobs.stream_update_recommendations(events, state, f"{path}/checkpoint", None).start().awaitTermination()
    return state.relation.read()


@finer_query
def stream_rank_and_ensemble(spark, sf):
    """Each model's list as one candidate message per user."""
    path = shared_path(spark, "ensemble")
    rows = lists(spark, sf).withColumn("c", F.struct("item_id", "score", F.lit("candidates").alias("stage"), "model"))
    rows.groupBy("user_id", F.col("model").alias("source_model")).agg(F.collect_list("c").alias("candidates")).withColumn(
        "ts", F.lit(NOW).cast("timestamp")
    ).write.parquet(f"{path}/messages")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/messages").schema).parquet(f"{path}/messages")
    state = jobs.EnsembleLists(spark, f"{path}/state", stream, ensemble.STAGE_WEIGHTS, buckets=16)
    jobs.stream_rank_and_ensemble(stream, F.col("score") * 2, state, f"{path}/checkpoint", None).start().awaitTermination()
    return state.lists.read()


def feedback_weights(spark, sf):
    """The state after all feedback came in one batch."""
    path = shared_path(spark, "weights")
    feedback(spark, sf).coalesce(1).write.parquet(f"{path}/feedback")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/feedback").schema).parquet(f"{path}/feedback")
    state = jobs.FeedbackWeights(spark, f"{path}/state", stream, ensemble.MINMAX_WEIGHTS, buckets=16)
    jobs.stream_feedback_weights(stream, lists(spark, sf), state, f"{path}/checkpoint", None).start().awaitTermination()
    return state


@query
def stream_feedback_weights(spark, sf):
    return feedback_weights(spark, sf).users.read()


@query
def stream_model_weights(spark, sf):
    return feedback_weights(spark, sf).models.read()
