"""Streaming behaviour statistics against the batch operator at several moments."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import sessions
from shelfwise.plans import catalog
from shelfwise.streaming.behaviour import BehaviourWindow, stream_behaviour_window

EVENTS = "event_id long, user_id long, product_id long, event_type string, session_id string, ts timestamp"
BEGIN = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng, rows, at = random.Random(7), [], 0.0
    for i in range(900):
        at += rng.expovariate(1 / 40)
        user = 1 if rng.random() < 0.33 else rng.randint(2, 30)
        ts = BEGIN + timedelta(seconds=at - (rng.random() < 0.1) * rng.uniform(0, 300))
        rows.append((i, user, rng.randint(1, 9), rng.choice(["view", "add_to_cart", "purchase", "recommend_click", "rating"]), f"s{user}-{i // 300 if user % 2 else 0}", ts))
    rows += [(9000, None, 1, "view", "s1", BEGIN), (9001, 77, None, "view", "s1", BEGIN), (9002, 78, 1, "view", None, BEGIN), (9003, 79, 1, "view", "x", None)]
    return spark.createDataFrame(rows, EVENTS)


def plain(row):
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.asDict().items() if k != "as_of"}


def test_equals_the_batch_form_after_every_batch(spark, events, tmp_path):
    state = BehaviourWindow(spark, str(tmp_path), events, 30, 10, buckets=8)
    cuts = [0, 150, 300, 310, 700, 10_000]
    for k in range(len(cuts) - 1):
        state.add(events.where(F.col("event_id").between(cuts[k], cuts[k + 1] - 1)), k)
        upto = events.where(F.col("event_id") < cuts[k + 1])
        at = upto.agg(F.max("ts").cast("string")).first()[0]
        got = spark.read.parquet(f"{tmp_path}/summaries/batch={k}").first()
        assert plain(got) == plain(sessions.behaviour_window(upto, at, 30).first())
    # Cells of sessions that ended long ago are gone.
    assert state.cells.read().count() < sessions.session_cells(events).count() / 2


def test_a_replayed_batch_gives_its_row_again(spark, events, tmp_path):
    state = BehaviourWindow(spark, str(tmp_path), events, 30, buckets=4)
    state.add(events.where("event_id < 300"), 0)
    state.add(events.where("event_id >= 300"), 1)
    once = sorted(map(str, state.summaries().collect()))
    again = BehaviourWindow(spark, str(tmp_path), events, 30, buckets=4)
    again.add(events.where("event_id >= 300"), 1)
    assert sorted(map(str, again.summaries().collect())) == once and len(once) == 2


def test_as_a_stream_and_without_events(spark, events, tmp_path):
    path = str(tmp_path / "in")
    for a, b in ((0, 400), (400, 900)):
        events.where(F.col("event_id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    state = BehaviourWindow(spark, str(tmp_path / "state"), source, 30, buckets=4)
    state.add(events.limit(0), -1)
    stream_behaviour_window(source, state, str(tmp_path / "cp"), None).start().awaitTermination()
    assert state.summaries().count() == 2


def test_windows_by_slides_equal_windows_by_events(spark, events):
    baseline = spark.createDataFrame([("view", 5), ("purchase", 2), ("add_to_cart", 3)], "event_type string, n long")
    got = {r.start: (r.total, round(r.drift_score, 9)) for r in sessions.drift_timeline(events, baseline, 30, 5).collect()}
    kinds = events.where(F.col("event_type").isin(*sessions.DRIFT_TYPES))
    rows = kinds.groupBy(F.window("ts", "30 minutes", "5 minutes").alias("w")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in sessions.DRIFT_TYPES]).collect()
    share = {"view": 0.5, "purchase": 0.2, "add_to_cart": 0.3}
    want = {}
    for r in rows:
        total = sum(r[k] for k in sessions.DRIFT_TYPES)
        want[r.w.start] = (total, round(sum(abs(share.get(k, 0) - r[k] / total) for k in sessions.DRIFT_TYPES) / 4, 9))
    assert got == want
    with pytest.raises(ValueError):
        sessions.drift_timeline(events, baseline, 30, 7)


def test_a_large_batch_is_dealt_to_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 20_000)
    stream = catalog.ordered_stream(spark, spark.range(150_000).withColumnRenamed("id", "event_id"))
    seen = []

    def note(batch, version):
        r = batch.agg(F.min("event_id"), F.max("event_id"), F.count("*"), F.count_distinct("file")).first()
        seen.append(tuple(r))

    named = stream.withColumn("file", F.input_file_name())
    named.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, 49_999, 50_000, 3), (50_000, 99_999, 50_000, 3), (100_000, 149_999, 50_000, 3)]


def test_uneven_batches_have_the_same_number_of_files():
    # A stream counts files, so a batch of few rows must not leave one empty.
    assert catalog.files_per_batch([2_000_000, 3_000_000, 2_500_000]) == 12
    assert catalog.files_per_batch([9_000_000, 25_000, 10]) == 1
    assert catalog.files_per_batch([9_000_000, 9_000_000, 0]) == 1
