"""Weights and ensemble lists that are kept batch by batch, against the operators over everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ensemble
from shelfwise.streaming.feedback import EnsembleLists, FeedbackWeights, stream_feedback_weights

FEEDBACK = "event_id long, user_id long, item_id long, event_type string, value double"
MESSAGES = "user_id long, source_model string, ts timestamp, candidates array<struct<item_id: long, score: double, stage: string, model: string>>"
BEGIN = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 12), rng.randint(1, 9), rng.choice(["click", "purchase", "rating", "view_time", "other"]), rng.choice([None, 1.0, 4.0, 5.0])) for i in range(900)]
    recs = [(u, i, m, 0.5) for u in range(1, 13) for i in range(1, 10) for m in ("lightgcn", "mf", "new") if rng.random() < 0.5]
    return spark.createDataFrame(rows, FEEDBACK), spark.createDataFrame(recs, "user_id long, item_id long, model string, score double")


def rounded(df):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=str)


def plain(feedback, recs, cuts):
    """Weights by going over all feedback of each batch with the operators of the whole table."""
    weights, users = dict(ensemble.MINMAX_WEIGHTS), None
    for a, b in zip(cuts, cuts[1:], strict=False):
        so_far = ensemble.attribute_feedback(feedback.where(F.col("event_id") < b), recs)
        batch = ensemble.attribute_feedback(feedback.where(F.col("event_id").between(a, b - 1)), recs)
        models = ensemble.model_success_weights(so_far, weights, 100).collect()
        stepped = ensemble.user_model_weights(batch, weights, users)
        stepped = feedback.sparkSession.createDataFrame(stepped.collect(), "user_id long, model string, weight double")
        if users is not None:
            stepped = stepped.unionByName(users.join(stepped, ["user_id", "model"], "left_anti"))
        users = feedback.sparkSession.createDataFrame(stepped.collect(), "user_id long, model string, weight double")
        weights |= {r.model: r.weight for r in models}
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in models], key=str), rounded(users)


def test_batches_equal_the_whole_table(spark, tables, tmp_path):
    feedback, recs = tables
    cuts = [0, 300, 320, 900]
    state = FeedbackWeights(spark, str(tmp_path), feedback, ensemble.MINMAX_WEIGHTS, 100, buckets=4)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        state.add(feedback.where(F.col("event_id").between(a, b - 1)), recs, k)
    models, users = plain(feedback, recs, cuts)
    assert rounded(state.models.read()) == models and rounded(state.users.read()) == users
    again = FeedbackWeights(spark, str(tmp_path), feedback, ensemble.MINMAX_WEIGHTS, 100, buckets=4)
    again.add(feedback.where("event_id >= 320"), recs, 2)
    assert rounded(again.models.read()) == models and rounded(again.users.read()) == users


def test_a_repeated_event_counts_once_after_a_restart(spark, tables, tmp_path):
    feedback, recs = tables
    path = str(tmp_path / "in")
    for a, b in ((0, 500), (400, 900)):
        feedback.where(F.col("event_id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(FEEDBACK).parquet(path)
        state = FeedbackWeights(spark, str(tmp_path / "state"), source, ensemble.MINMAX_WEIGHTS, buckets=4)
        stream_feedback_weights(source, recs, state, str(tmp_path / "cp"), None).start().awaitTermination()
    models, users = plain(feedback, recs, [0, 500, 900])
    assert rounded(state.models.read()) == models and rounded(state.users.read()) == users


def test_newest_lists_are_combined(spark, tmp_path):
    rng = random.Random(4)

    def message(user, model, minute):
        listed = [(i, round(rng.random(), 6), "c", model) for i in rng.sample(range(20), 5)]
        return user, model, BEGIN + timedelta(minutes=minute), listed

    rows = [message(u, m, t) for t in (0, 10, 40) for u in range(1, 8) for m in ("lightgcn", "mf") if t == 0 or (u + t) % 3 == 0]
    rows.append(message(1, "mf", 75))
    frame = lambda x: spark.createDataFrame(x, MESSAGES)
    state = EnsembleLists(spark, str(tmp_path), frame(rows), ensemble.STAGE_WEIGHTS, 3600, buckets=4)
    batches = [rows[:10], rows[10:20], rows[20:]]
    for k, part in enumerate(batches):
        state.add(frame(part), F.col("score") * 2, k)
    newest = {}
    for u, m, t, listed in rows:
        if (u, m) not in newest or newest[u, m][0] <= t:
            newest[u, m] = t, listed
    now = max(t for t, _ in newest.values())
    flat = [
        (u, m, i, 2 * s, k + 1) for (u, m), (t, listed) in newest.items() if now - t <= timedelta(hours=1)
        for k, (s, i) in enumerate(sorted(((s, i) for i, s, _, _ in listed), key=lambda x: (-x[0], x[1])))
    ]
    want = ensemble.diversity_penalty(ensemble.ensemble_weighted_rank(spark.createDataFrame(flat, "user_id long, model string, item_id long, score double, rank int"), ensemble.STAGE_WEIGHTS))
    assert rounded(state.all_lists().select("user_id", "item_id", "score", "rank")) == rounded(want.select("user_id", "item_id", "score", "rank"))
    last = {u for u, *_ in batches[-1]}
    shown = state.lists.read().where(F.col("user_id").isin(*last))
    assert rounded(shown) == rounded(want.select("user_id", "item_id", "score", "rank").where(F.col("user_id").isin(*last)))
