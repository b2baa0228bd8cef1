"""Combining ranked lists of several models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..scale import positions, top_n
from .ranking import by_score, top_n_per_user

# Default weights of the ensembles and of the weight updates.
STAGE_WEIGHTS = {
    "lightgcn": 0.5,
    "product_transformer": 0.8,
    "product_transformer_onnx": 0.8,
    "user_history": 0.3,
    "popularity": 0.1,
    "diversity": 0.2,
}
MINMAX_WEIGHTS = {"lightgcn": 0.5, "content_based": 0.2, "mf": 0.2, "ncf": 0.1}
BLEND_WEIGHTS = {"lightgcn": 0.7, "content_based": 0.3}
UNKNOWN_WEIGHT = 0.5
LOWEST_WEIGHT, HIGHEST_WEIGHT = 0.1, 1.0
FOLD_BLOCK = 10_000


def weight_of(model: Column, weights: Mapping[str, float], default: float | None) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    known = F.try_element_at(lookup, model)
    return known if default is None else F.coalesce(known, F.lit(default))


def ensemble_weighted_rank(
    ranked: DataFrame, weights: Mapping[str, float] = STAGE_WEIGHTS, user_weights: DataFrame | None = None
) -> DataFrame:
    """(user_id, item_id, score, models, rank): mean over models of score x weight / rank.

    ``ranked`` rows carry ``rank`` within (user, model). ``user_weights``
    (user_id, model, weight) take precedence over the global ones.
    """
    weight = weight_of(F.col("model"), weights, UNKNOWN_WEIGHT)
    rows = ranked
    if user_weights is not None:
        own = user_weights.select("user_id", "model", F.col("weight").alias("_own"))
        rows = rows.join(own, ["user_id", "model"], "left")
        weight = F.coalesce("_own", weight)
    combined = rows.groupBy("user_id", "item_id").agg(
        (F.sum(F.col("score") * weight / F.col("rank")) / F.count("*")).alias("score"), F.count("*").alias("models")
    )
    return positions(combined, ["user_id"], [-F.col("score"), F.col("item_id")])


def diversity_penalty(recs: DataFrame, weight: float = 0.2) -> DataFrame:
    """Lower every score but the first by ``weight`` over its position, and rank again."""
    penalised = recs.withColumn(
        "score", F.when(F.col("rank") > 1, F.col("score") * (1 - weight / F.col("rank"))).otherwise(F.col("score"))
    ).drop("rank")
    return positions(penalised, ["user_id"], [-F.col("score"), F.col("item_id")])


def top_per_model(scores: DataFrame, n: int) -> DataFrame:
    return top_n(scores, ["user_id", "model"], by_score(), n)


def hybrid_weighted_scores(collab: DataFrame, content: DataFrame, collab_weight: float = 0.7, n: int = 10) -> DataFrame:
    """Weighted sum of two models' raw scores over each one's best 2n items."""
    parts = [
        top_n_per_user(scores.select("user_id", "item_id", "score"), 2 * n).withColumn("score", F.col("score") * weight)
        for scores, weight in ((collab, collab_weight), (content, 1 - collab_weight))
    ]
    both = parts[0].unionByName(parts[1]).groupBy("user_id", "item_id").agg(F.sum("score").alias("score"))
    return top_n_per_user(both, n)


def hybrid_rank_blend(recs_by_model: DataFrame, weights: Mapping[str, float] = BLEND_WEIGHTS, n: int = 10) -> DataFrame:
    """Sum over models of weight x (2n - place) / 2n over each one's best 2n items, place from 0."""
    known = recs_by_model.where(F.col("model").isin(*weights))
    ranked = top_per_model(known, 2 * n)
    gain = weight_of(F.col("model"), weights, None) * (2 * n - (F.col("rank") - 1)) / (2 * n)
    return top_n_per_user(ranked.groupBy("user_id", "item_id").agg(F.sum(gain).alias("score")), n)


def ensemble_minmax(scores_by_model: DataFrame, weights: Mapping[str, float] = MINMAX_WEIGHTS, n: int = 10) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each model's best 2n of the user; .5 where they are all equal."""
    used = {m: w for m, w in weights.items() if w != 0}
    ranked = top_per_model(scores_by_model.where(F.col("model").isin(*used)), 2 * n)
    # These windows see the at most 2n rows just kept per user and model.
    whole = W.partitionBy("user_id", "model")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    scaled = ranked.withColumns({"_lo": low, "_hi": high})
    share = F.when(
        F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    ).otherwise(0.5)
    gain = share * weight_of(F.col("model"), used, None)
    return top_n_per_user(scaled.groupBy("user_id", "item_id").agg(F.sum(gain).alias("score")), n)


def ncf_score_rescale(scores: DataFrame) -> DataFrame:
    """Per user: scores all below .1 are multiplied by 10000, and if any is negative all go through a sigmoid."""
    extent = scores.groupBy("user_id").agg(
        F.max(F.abs("score")).alias("_top"), F.min("score").alias("_low")
    )
    small = F.col("_top") < 0.1
    scaled = F.when(small, F.col("score") * 10000.0).otherwise(F.col("score"))
    return (
        scores.join(extent, "user_id")
        .withColumn("score", F.when(F.col("_low") < 0, 1 / (1 + F.exp(-scaled))).otherwise(scaled))
        .drop("_top", "_low")
    )


# ---------------------------------------------------------------- learning the weights


def attribute_feedback(feedback: DataFrame, recs: DataFrame) -> DataFrame:
    """Feedback rows once per model that recommended the item, with that model's score."""
    listed = recs.select("user_id", "item_id", "model", F.col("score").alias("model_score"))
    return feedback.join(listed, ["user_id", "item_id"])


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(LOWEST_WEIGHT), F.least(F.lit(HIGHEST_WEIGHT), x))


def success_counts(attributed: DataFrame) -> DataFrame:
    """(model, feedback, clicks, purchases, ratings, rating_sum): counts that add up over parts of the feedback."""
    kind = F.col("event_type")
    rated = F.when(kind == "rating", F.col("value"))
    return attributed.where(kind.isin("click", "purchase", "rating", "view_time")).groupBy("model").agg(
        F.count("*").alias("feedback"), F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "purchase").alias("purchases"),
        F.count(rated).alias("ratings"), F.coalesce(F.sum(rated), F.lit(0.0)).cast("double").alias("rating_sum"),
    )


def success_weights(counts: DataFrame, weights: Mapping[str, float], min_feedback: int = 100) -> DataFrame:
    """(model, feedback, success, weight): each model with enough feedback moves a fifth of the way to its success rate."""
    total = F.col("feedback")
    rating = F.when(F.col("ratings") > 0, F.col("rating_sum") / F.col("ratings")).otherwise(0.0)
    success = 0.3 * F.col("clicks") / total + 0.5 * F.col("purchases") / total + 0.2 * rating / 5
    old = weight_of(F.col("model"), weights, UNKNOWN_WEIGHT)
    new = F.when(total >= min_feedback, _clamp(0.8 * old + 0.2 * F.col("success"))).otherwise(old)
    return counts.withColumn("success", success).select("model", "feedback", "success", new.alias("weight"))


def model_success_weights(attributed: DataFrame, weights: Mapping[str, float], min_feedback: int = 100) -> DataFrame:
    """(model, feedback, success, weight): each model with enough feedback moves a fifth of the way to its success rate."""
    return success_weights(success_counts(attributed), weights, min_feedback)


def user_model_weights(
    attributed: DataFrame, weights: Mapping[str, float], current: DataFrame | None = None, order: str = "event_id"
) -> DataFrame:
    """(user_id, model, weight) after applying each feedback in order, clamped to .1..1 at every step.

    One step turns w into min(hi, max(lo, w + d)). Steps of that form compose
    into one of the same form, so blocks of at most ``FOLD_BLOCK`` numbered steps
    are folded on their own, then blocks of blocks, and the single remaining
    step is applied to the starting weight.
    """
    kind = F.col("event_type")
    delta = (
        F.when(kind == "click", F.lit(0.01))
        .when(kind == "purchase", F.lit(0.03))
        .otherwise(F.coalesce(0.02 * (F.col("value") - 3) / 2, F.lit(0.0)))
    )
    steps = attributed.where(kind.isin("click", "purchase", "rating")).select(
        "user_id", "model", order, delta.alias("d"), F.lit(LOWEST_WEIGHT).alias("lo"), F.lit(HIGHEST_WEIGHT).alias("hi")
    )
    folded = positions(steps, ["user_id", "model"], [F.col(order)], "at").withColumn("at", F.col("at") - 1)
    for _ in range(3):
        folded = _fold_blocks(folded)
    old = weight_of(F.col("model"), weights, UNKNOWN_WEIGHT)
    if current is not None:
        folded = folded.join(
            current.select("user_id", "model", F.col("weight").alias("_own")), ["user_id", "model"], "left"
        )
        old = F.coalesce("_own", old)
    return folded.select(
        "user_id", "model", F.least("hi", F.greatest("lo", old + F.col("d"))).alias("weight")
    )


def _fold_blocks(steps: DataFrame) -> DataFrame:
    """Compose each run of ``FOLD_BLOCK`` consecutive steps of a (user, model) into one."""
    identity = F.struct(
        F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")
    )

    def then(first: Column, step: Column) -> Column:
        def inside(x):
            return F.least(step["hi"], F.greatest(step["lo"], x))

        return F.struct(
            (first["d"] + step["d"]).alias("d"),
            inside(first["lo"] + step["d"]).alias("lo"),
            inside(first["hi"] + step["d"]).alias("hi"),
        )

    block = F.floor(F.col("at") / FOLD_BLOCK).alias("at")
    return (
        steps.groupBy("user_id", "model", block)
        .agg(F.array_sort(F.collect_list(F.struct("at", "d", "lo", "hi"))).alias("run"))
        .withColumn("f", F.aggregate("run", identity, then))
        .select("user_id", "model", "at", "f.d", "f.lo", "f.hi")
    )
