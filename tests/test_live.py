"""The bucketed table and the running recommender against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import interactions, ranking
from shelfwise.plans.recommend import update_recommendations
from shelfwise.streaming import jobs
from shelfwise.streaming.buckets import BucketTable
from shelfwise.streaming.live import LiveRecommendations

EVENTS = "event_id long, user_id long, product_id long, event_type string, session_id string, ts timestamp"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        user = 1 if rng.random() < 0.33 else rng.randint(2, 25)
        if 400 <= i:
            user = rng.choice([1, 3, 5, 40])
        session = rng.choice([None, "default", f"s{user}"])
        rows.append((i, user if rng.random() > 0.02 else None, rng.randint(1, 18), rng.choice(["view", "view", "purchase"]), session, None))
    return spark.createDataFrame(rows, EVENTS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def lists(df):
    return rows_of(df.select("user_id", "item_id", "rank", F.round("score", 6), "activity_level"))


def test_batches_equal_the_batch_operator(spark, events, tmp_path):
    state = LiveRecommendations(spark, str(tmp_path), events, 6, buckets=8)
    shown, newest = {}, {}
    for k, (a, b) in enumerate([(0, 200), (200, 400), (400, 600)]):
        batch, upto = events.where(F.col("event_id").between(a, b - 1)), events.where(F.col("event_id") < b)
        state.add(batch, k)
        assert rows_of(state.relation.read().select("product_id", "related_id", "score")) == rows_of(interactions.cooccurrence_feedback(upto))
        whole = update_recommendations(upto.where("user_id is not null"), ranking.top_popular(upto, 6), n=6)
        users = {r[0] for r in batch.select("user_id").distinct().collect()} - {None}
        for row in lists(whole.where(F.col("user_id").isin(*users))):
            shown.setdefault((k, row[0]), []).append(row)
        newest |= {u: k for u in users}
        got, want = set(lists(state.lists.read())), {r for u, j in newest.items() for r in shown.get((j, u), [])}
        assert got == want, (sorted(got - want, key=str)[:5], sorted(want - got, key=str)[:5])
        assert lists(state.all_lists()) == lists(whole)
        assert rows_of(state.views.read()) == rows_of(interactions.item_popularity(upto))
    assert len(newest) > len(users)  # some lists are from earlier batches


def test_a_replayed_batch_changes_nothing_and_a_restart_goes_on(spark, events, tmp_path):
    state = LiveRecommendations(spark, str(tmp_path), events, 6, buckets=8)
    state.add(events.where("event_id < 300"), 0)
    state.add(events.where("event_id >= 300"), 1)
    tables = ("users", "touches", "relation", "views", "lists")
    once = {t: rows_of(getattr(state, t).read()) for t in tables}
    again = LiveRecommendations(spark, str(tmp_path), events, 6, buckets=8)
    again.add(events.where("event_id >= 300"), 1)
    assert {t: rows_of(getattr(again, t).read()) for t in tables} == once


def test_a_stream_with_repeated_events(spark, events, tmp_path):
    path = str(tmp_path / "in")
    for a, b in ((0, 300), (250, 600)):
        events.where(F.col("event_id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
        state = LiveRecommendations(spark, str(tmp_path / "state"), source, 6, buckets=8)
        jobs.stream_update_recommendations(source, state, str(tmp_path / "cp"), None).start().awaitTermination()
    assert rows_of(state.relation.read().select("product_id", "related_id", "score")) == rows_of(interactions.cooccurrence_feedback(events))


def test_popular_items_of_a_model_follow_the_viewed_ones(spark, events, tmp_path):
    model = spark.createDataFrame([(90, 1), (1, 2), (91, 3)], "item_id long, rank int")
    state = LiveRecommendations(spark, str(tmp_path), events, 6, buckets=4, model_popular=model)
    state.add(events, 0)
    want = ranking.merge_popular(ranking.top_popular(events, 6), model, 6)
    assert rows_of(state.popular().select("item_id", "rank")) == rows_of(want.select("item_id", "rank"))


def test_bucket_table(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "k long, v string", ["k"], buckets=32)
    assert table.read().count() == 0 and table.versions() == []
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.upsert(frame([(i, "a" * 200) for i in range(2000)] + [(None, "n")]), 3)
    table.upsert(frame([(5, "b"), (None, "m"), (9000, "c")]), 4)
    assert table.read().count() == 2002 and table.read(3).count() == 2001
    now = {r.k: r.v for r in table.read().collect()}
    assert now[5] == "b" and now[None] == "m" and now[9000] == "c" and now[6] == "a" * 200
    # Three keys touch three buckets at most.
    assert table.bytes_written(4) < table.bytes_written(3) / 8
    assert sum(v == 4 for v in table.manifest(4).values()) <= 3
    table.upsert(frame([]), 5, gone=frame([(5, "")]).select("k"))
    assert table.read().count() == 2001 and table.rows_of(frame([(5, ""), (6, "")]), 6).count() == 1
    assert 3 not in table.vacuum(keep=1)  # most buckets are still those of version 3
    table.upsert(frame([(i, "z") for i in range(2000)] + [(None, "z"), (9000, "z")]), 6)
    assert 3 in table.vacuum(keep=1) and table.versions() == [6]
    assert {r.v for r in table.read().collect()} == {"z"}


def test_an_incomplete_version_is_not_seen(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "k long, v string", ["k"], buckets=4)
    table.upsert(spark.createDataFrame([(1, "a")], "k long, v string"), 0)
    # Files without a manifest: a batch that died half-way.
    spark.createDataFrame([(1, "x", 0)], "k long, v string, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "data/v1"))
    assert table.versions() == [0] and table.read().first().v == "a"
    table.upsert(spark.createDataFrame([(2, "b")], "k long, v string"), 1)
    assert {r.v for r in table.read().collect()} == {"a", "b"}


def test_lists_are_not_made_where_only_the_relation_is_kept(spark, events, tmp_path, monkeypatch):
    state = LiveRecommendations(spark, str(tmp_path), events, 6, buckets=4, keep_lists=False)
    made, lists_of = [], LiveRecommendations.lists_of
    monkeypatch.setattr(LiveRecommendations, "lists_of", lambda *args: made.append(1) or lists_of(*args))
    state.add(events.where("event_id < 300"), 0)
    state.add(events.where("event_id >= 300"), 1)
    assert not made and state.lists.versions() == []
    assert rows_of(state.relation.read().select("product_id", "related_id", "score")) == rows_of(interactions.cooccurrence_feedback(events))
    whole = update_recommendations(events.where("user_id is not null"), ranking.top_popular(events, 6), n=6)
    assert lists(state.all_lists()) == lists(whole)
