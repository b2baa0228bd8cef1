import pytest
from pyspark.sql import functions as F

from shelfwise import datasets
from shelfwise.operators import features, sessions
from shelfwise.plans import catalog
from shelfwise.sources import messages
from shelfwise.streaming import jobs


@pytest.fixture()
def stream(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    datasets.behaviour(spark, sf).orderBy("ts").coalesce(1).write.parquet(path)
    return lambda: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_live_sessions_end_at_the_batch_counts(spark, sf, stream):
    live = jobs.update_stream(jobs.live_sessions(stream(), gap_minutes=60 * 24 * 60), "session_id", spark, "live")
    got = {r["session_id"]: (r["events"], r["products"], r["views"]) for r in live.collect()}
    whole = sessions.session_stats(datasets.behaviour(spark, sf), 60 * 24 * 60)
    want = {r["session_id"]: (r["events"], r["products"], r["views"]) for r in whole.collect()}
    assert got == want


def test_idle_sessions_are_closed(spark, sf, tmp_path):
    """The second batch moves the watermark on; the third runs the timers of sessions idle since the first."""
    events = datasets.behaviour(spark, sf)
    path = str(tmp_path / "in")
    events.withColumn("day", F.to_date("ts")).repartitionByRange(5, "day").sortWithinPartitions("ts").drop("day").write.parquet(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.update_stream(jobs.live_sessions(source, gap_minutes=30), "session_id", spark, "closing")
    assert out.where("closed").count() > 0
    assert out.where("events < 1").count() == 0


def test_drift_of_sliding_windows(spark, sf, stream):
    events = datasets.behaviour(spark, sf)
    baseline = events.groupBy("event_type").agg(F.count("*").alias("n"))
    batch = {r["start"]: r["drift_score"] for r in sessions.drift_timeline(events, baseline, 600, 300).collect()}
    windows = sessions.drift_timeline(stream().withWatermark("ts", "10 minutes"), baseline, 600, 300)
    streamed = {r["start"]: r["drift_score"] for r in jobs.append_stream(windows, spark, "drift").collect()}
    assert streamed and all(batch[k] == pytest.approx(v) for k, v in streamed.items())


def test_user_features_over_several_batches(spark, sf, tmp_path):
    path = str(tmp_path / "in")
    datasets.behaviour(spark, sf).repartitionByRange(3, "event_id").write.parquet(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = jobs.user_table(spark, str(tmp_path / "table"), source)
    jobs.stream_user_features(source, table, str(tmp_path / "cp"), None).start().awaitTermination()
    got = {r["user_id"]: (r["view_count"], r["rating_count"], r["last_active"]) for r in table.read().collect()}
    want = features.user_event_features(datasets.behaviour(spark, sf)).collect()
    assert got == {r["user_id"]: (r["view_count"], r["rating_count"], r["last_active"]) for r in want}


def test_user_features_survive_restart_and_replay(spark, tmp_path):
    schema = "event_id INT, user_id INT, product_id INT, event_type STRING, rating DOUBLE, ts TIMESTAMP"
    path, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    for start in (0, 2):
        rows = spark.createDataFrame([(start + i, 1, 10 + start + i, "view", None, None) for i in range(2)], schema)
        rows.coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).parquet(path)
        jobs.stream_user_features(source, jobs.user_table(spark, table, source), checkpoint, None).start().awaitTermination()
    held = jobs.user_table(spark, table, source)
    assert held.read().first()["view_count"] == 4 and held.read().first()["recent_views"] == [13, 12, 11, 10]
    again = spark.read.parquet(path).where("event_id >= 2")
    last = held.versions()[-1]
    held.upsert(features.user_event_features(again, held.rows_of(again, last)), last)
    assert jobs.user_table(spark, table, source).read().first()["view_count"] == 4


def test_history_counts_an_event_once(spark, tmp_path):
    history = jobs.History(spark, str(tmp_path / "history"))
    rows = spark.range(4).withColumnRenamed("id", "event_id")
    history.add(rows, 0)
    assert history.add(rows, 1).count() == 4 and history.add(spark.range(9).withColumnRenamed("id", "event_id"), 2).count() == 9


def test_feedback_log_keeps_complete_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("u", "i", "click", 1.0), ("u", None, "click", 2.0)]
    spark.createDataFrame(rows, "user_id STRING, item_id STRING, event_type STRING, rating DOUBLE").write.parquet(source)
    stream = spark.readStream.schema("user_id STRING, item_id STRING, event_type STRING, rating DOUBLE").parquet(source)
    query = messages.feedback_event_log(stream, target, str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["item_id"] for r in spark.read.json(target).collect()] == ["i"]


def test_messages_written_as_a_stream(spark, tmp_path, stream):
    rows = stream().select("user_id", "product_id", "event_type", F.unix_millis("ts").alias("timestamp"))
    out = str(tmp_path / "out")
    query = messages.write_messages(rows, "product_event", str(tmp_path / "cp"), path=out).trigger(availableNow=True).start()
    query.awaitTermination()
    assert messages.parse_messages(spark.read.text(out), "product_event").where("ts is not null").count() == 1000


def test_session_stream_deals_its_events_to_several_files(spark, tmp_path, monkeypatch):
    events = spark.range(30000).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 7) AS ts", "id % 301 AS user_id", "'view' AS event_type",
        "CAST(id AS DOUBLE) AS value", "concat('{\"k\": ', id % 10, '}') AS props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    rows = catalog.QUERIES["stream_session_stats"](spark, str(tmp_path)).count()
    # No task writes or sorts all events.
    assert len(list((tmp_path / "stream").glob("part-*"))) > 1
    assert rows > 301
