import json

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import scalars
from shelfwise.operators import cleaning, coldstart, ensemble, features, quality, store
from shelfwise.sources import files, messages

NOW = "2024-02-01 00:00:00"


def test_read_reviews_by_suffix(spark, tmp_path):
    (tmp_path / "r.csv").write_text('asin,overall,reviewText\np1,5,"two\nlines"\np2,x,\n')
    (tmp_path / "r.json").write_text('{"asin": "p1", "overall": 4}\n{"asin": "p2", "overall": 2}\n')
    assert files.read_reviews(spark, str(tmp_path / "r.csv"), multi_line=True).count() == 2
    assert files.read_reviews(spark, str(tmp_path / "r.json"), nrows=1).count() == 1
    with pytest.raises(ValueError):
        files.read_reviews(spark, str(tmp_path / "r.xlsx"))


def test_write_table_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "x,y"), ("b", None)], "k STRING, v STRING")
    files.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        files.write_table(df, str(tmp_path / "t"), "pickle")


def test_versions_of_recommendations_live_side_by_side(spark, tmp_path):
    recs = spark.createDataFrame([(1, 2, 0.5)], "user_id INT, item_id INT, score DOUBLE")
    path = str(tmp_path / "recs")
    files.write_recommendations(recs, path, "v1", NOW)
    files.write_recommendations(recs.unionAll(recs), path, "v2", NOW)
    files.write_recommendations(recs, path, "v2", NOW)
    assert {tuple(r) for r in spark.read.parquet(path).groupBy("model_version").count().collect()} == {("v1", 1), ("v2", 1)}


def test_upsert_adds_overwrites_and_stamps(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k INT, v STRING, w STRING")
    changes = spark.createDataFrame([(2, None), (3, "c")], "k INT, v STRING")
    rows = {r["k"]: r for r in files.table_upsert(base, changes, "k", NOW).collect()}
    assert (rows[1]["v"], rows[1]["updated_at"]) == ("a", None)
    assert (rows[2]["v"], rows[2]["w"]) == (None, "y") and rows[2]["updated_at"] is not None
    assert (rows[3]["v"], rows[3]["w"]) == ("c", None)


def test_shards_match_the_digest(spark, tmp_path):
    import hashlib

    ids = [f"user_{i}" for i in range(40)]
    df = spark.createDataFrame([(u,) for u in ids], "user_id STRING")
    for n in (4, 7):
        for r in df.select("user_id", scalars.shard_id(F.col("user_id"), n).alias("s")).collect():
            assert r["s"] == int(hashlib.md5(r["user_id"].encode()).hexdigest(), 16) % n
    files.sharded_write(df, str(tmp_path / "s"))
    found = files.sharded_lookup(spark, str(tmp_path / "s"), df.limit(3))
    assert found.count() == 3
    assert files.map_shards(df, lambda part: part.agg(F.count("*").alias("n"))).agg(F.sum("n")).first()[0] == 40


def test_raw_reviews_are_cleaned(spark):
    raw = spark.createDataFrame(
        [("p1", "u1", "5", None, 0, 3), ("p2", "u2", "bad", "t", 86400, 1), (None, "u3", "4", "t", 5, 1)],
        "asin STRING, `Reviewer ID` STRING, overall STRING, reviewText STRING, unixReviewTime LONG, `Helpful Votes` INT")
    rows = cleaning.clean_reviews(raw, NOW).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["product_id"], r["user_id"], r["rating"], r["review_text"], r["summary"], r["votes"]) == ("p1", "u1", 5.0, "", "", 3)
    assert r["verified_purchase"] is False and r["review_date"].year == 1970
    with pytest.raises(ValueError):
        cleaning.clean_reviews(raw.drop("overall"))


def test_later_alias_wins(spark):
    df = spark.createDataFrame([("a", "b", "c")], "asin STRING, timestamp STRING, unixReviewTime STRING")
    assert cleaning.standardize_columns(df).first()["review_date"] == "c"


def test_bad_dates_become_null_and_missing_ones_now(spark):
    df = spark.createDataFrame([("p", "u", 1, "2020-05-06"), ("p", "u", 1, "soon")], "product_id STRING, user_id STRING, rating INT, review_date STRING")
    dates = sorted(str(r["review_date"]) for r in cleaning.clean_reviews(df).collect())
    assert dates == ["2020-05-06 00:00:00", "None"]
    assert cleaning.clean_reviews(df.drop("review_date"), NOW).first()["review_date"].year == 2024


def test_split_parts_cover_the_table(spark):
    df = spark.range(2000)
    parts = cleaning.split_train_val_test(df)
    sizes = {k: v.count() for k, v in parts.items()}
    assert sizes["train"] + sizes["validation"] + sizes["test"] == 2000 and sizes["sample"] == 1000
    assert abs(sizes["test"] - 400) < 80 and abs(sizes["validation"] - 400) < 80


def test_profiles_of_odd_columns(spark, running):
    df = spark.createDataFrame(
        [(1.0, None, "", 1), (1.0, None, "a", 1), (-4.0, None, None, 1)], "x DOUBLE, empty DOUBLE, t STRING, c INT")
    rows = {r["column_name"]: r for r in quality.numeric_profile(df).collect()}
    assert rows["empty"]["mean"] is None and rows["empty"]["outliers_count"] is None and rows["empty"]["zeros_count"] == 0
    assert rows["c"]["std"] == 0 and rows["c"]["outliers_count"] is None
    assert rows["x"]["median"] == 1.0 and rows["x"]["negative_count"] == 1
    t = quality.categorical_profile(df).first()
    assert (t["unique_count"], t["top_value"], t["top_value_count"], t["empty_count"]) == (3, "", 1, 1)
    assert quality.duplicate_rows(df.limit(0)).first()["duplicate_count"] == 0
    assert {r["column_name"]: round(r["missing_pct"]) for r in quality.missing_values(df).collect()} == {"x": 0, "empty": 100, "t": 33, "c": 0}


def test_quality_level(spark):
    df = spark.createDataFrame([("u", "p", 9, "2030-01-01", None)] * 2, "user_id STRING, product_id STRING, rating INT, d STRING, x INT")
    df = df.withColumn("review_date", F.col("d").cast("timestamp"))
    row = quality.quality_summary(
        quality.missing_values(df), quality.duplicate_rows(df), quality.consistency_check(df, NOW)).first()
    assert (row["issues_count"], row["quality_level"]) == (4, "Fair")
    assert [r[0] for r in quality.invalid_ratings(df).collect()] == [9]


def test_scalers_with_constant_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (None, 5), (3, 5)], "a INT, b INT")
    z = features.standard_scale(df, df, ["a", "b"]).collect()
    m = features.minmax_scale(df, df, ["a", "b"]).collect()
    assert [r["b_scaled"] for r in z] == [0.0] * 3 and [r["b_normalized"] for r in m] == [0.0] * 3
    assert m[1]["a_normalized"] == 0.0 and m[2]["a_normalized"] == 1.0


def test_unseen_labels_are_unknown(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("zoo",)], "c STRING")
    df = spark.createDataFrame([("a",), ("new",), (None,), ("zoo",)], "c STRING")
    assert [r["c_encoded"] for r in features.label_encode(fit, df, ["c"]).orderBy("c").collect()] == [2, 0, 2, 3]


EVENTS = "event_id INT, user_id INT, product_id INT, event_type STRING, rating DOUBLE, ts TIMESTAMP"


def test_features_continue_from_a_base(spark):
    rows = [(i, 1, i % 5, ("view", "purchase", "rating")[i % 3], float(i % 5 + 1), None) for i in range(30)]
    df = spark.createDataFrame(rows, EVENTS)
    early, late = df.where("event_id < 13"), df.where("event_id >= 13")
    whole = features.user_event_features(df, views=3).first()
    step = features.user_event_features(late, features.user_event_features(early, views=3), views=3).first()
    assert (whole["view_count"], whole["avg_rating"]) == (step["view_count"], pytest.approx(step["avg_rating"]))
    assert whole["recent_views"] == step["recent_views"]
    p = {r["product_id"]: r for r in features.product_event_features(late, features.product_event_features(early)).collect()}
    q = {r["product_id"]: r for r in features.product_event_features(df).collect()}
    assert {k: r["popularity"] for k, r in p.items()} == pytest.approx({k: r["popularity"] for k, r in q.items()})


@pytest.mark.parametrize("cut", [0, 2, 3, 17])
def test_products_return_after_they_fell_off(spark, cut):
    views = {1: [1, 2, 3, 1], 2: [5, 5, 6, 5, 7, 6, 5, 8, 5], None: [1, 4, 2, 1, 1]}
    rows = [(i * 3 + k, u, p, "view", None, None) for k, (u, l) in enumerate(views.items()) for i, p in enumerate(l)]
    want = {}
    for u, seen in views.items():
        for p in seen:
            if p not in want.setdefault(u, []):
                want[u] = [p, *want[u]][:2]
    df = spark.createDataFrame(rows, EVENTS)
    base = features.user_event_features(df.where(F.col("event_id") < cut), views=2) if cut else None
    out = features.user_event_features(df.where(F.col("event_id") >= cut), base, views=2).where("user_id is not null").collect()
    assert want[1] == [1, 3] and {r["user_id"]: r["recent_views"] for r in out} == {u: l for u, l in want.items() if u}


def test_messages(spark):
    raw = spark.createDataFrame(
        [(json.dumps({"user_id": "u", "product_id": "p", "event_type": "view", "timestamp": t}),)
         for t in (1700000000000, "2023-11-14T22:13:20", "soon")] + [("{}",), ("broken",)], "value STRING")
    parsed = messages.parse_messages(raw, "product_event")
    good, bad = messages.validate_messages(parsed, "product_event")
    assert good.count() == 3 and bad.count() == 2
    assert good.where("ts is not null").select("ts").distinct().count() == 1
    out = messages.to_messages(good.select("user_id", "product_id", "event_type"), "product_event").first()
    assert out["key"] == "u:p" and "timestamp" in json.loads(out["value"])


def store_rows(spark, rows):
    df = spark.createDataFrame(rows, "feature_type STRING, entity_id STRING, feature_name STRING, value STRING, at STRING")
    return df.withColumn("updated_at", F.col("at").cast("timestamp")).drop("at")


def test_feature_store(spark):
    rows = store_rows(spark, [
        ("user", "1", "views", "10", "2024-01-01"), ("user", "1", "views", "12", "2024-01-02"),
        ("user", "2", "name", '"x"', "2024-01-01"), ("product", "9", "views", "3", "2024-01-01")])
    held = store.set_features(None, rows)
    assert store.feature_stats(held).first()[0] == 3 and store.feature_stats(held, "user").first()[0] == 2
    one = {r["entity_id"]: r["views"] for r in store.get_features(held, "user", ["views"]).collect()}
    assert one == {"1": "12"}
    more = store.increment_features(held, spark.createDataFrame(
        [("user", "1", "views", 2.0), ("user", "1", "views", 1.0), ("user", "3", "views", 5.0)],
        "feature_type STRING, entity_id STRING, feature_name STRING, delta DOUBLE"), NOW)
    values = {(r["entity_id"], r["feature_name"]): r["value"] for r in more.where("feature_type = 'user'").collect()}
    assert values == {("1", "views"): "15.0", ("2", "name"): '"x"', ("3", "views"): "5.0"}
    assert store.delete_features(held, "user", "1").count() == 2
    assert store.delete_features(held, "user", "1", "other").count() == 3
    assert sorted(r[0] for r in store.list_entities(held, "user").collect()) == ["1", "2"]
    short = store.set_features(None, rows, ttl=3600)
    assert store.all_features(short, "user", "2024-01-02 00:30:00").count() == 1
    assert store.all_features(short, "user", "2024-01-02 02:00:00").count() == 0


def test_context_key_ignores_order(spark):
    df = spark.sql("select map('b','2','a','1') as x, map('a','1','b','2') as y, cast(null as map<string,string>) as z")
    r = df.select(store.context_key(F.col("x")), store.context_key(F.col("y")), store.context_key(F.col("z"))).first()
    assert r[0] == r[1] == "a:1:b:2" and r[2] == ""


def cold(spark):
    ratings = spark.createDataFrame(
        [(u, i, "f" if u % 2 else "m") for u in range(12) for i in range(6) if i <= u % 6 or u % 2], "user_id INT, product_id INT, user_gender STRING")
    items = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(8)], "item_id INT, category STRING")
    return ratings, items


def test_cold_start_chain(spark):
    ratings, items = cold(spark)
    clusters = spark.createDataFrame([(0, 7, 1), (1, 6, 1)], "cluster INT, item_id INT, rank INT")
    tables = coldstart.refresh_cold_start(ratings, items, clusters, minimum=3)
    users = spark.createDataFrame([(1, "f", ["odd"]), (2, None, []), (3, "x", ["none"])], "user_id INT, user_gender STRING, preferred_categories ARRAY<STRING>")
    for n in (3, 8, 20):
        out = {}
        for r in coldstart.cold_start_recommend(users, tables, n=n).orderBy("rank").collect():
            out.setdefault(r["user_id"], []).append(r["item_id"])
        for mine in out.values():
            assert len(mine) == len(set(mine)) == min(n, 8)
    first = coldstart.cold_start_category(users, tables["category"], 2).where("user_id = 1").orderBy("rank").collect()
    assert all(r["item_id"] % 2 == 1 for r in first) and len(first) == 2
    assert coldstart.cold_start_category(users, tables["category"].limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        coldstart.cold_start_recommend(users, tables, ["wishes"])


def test_flat_scores_count_half(spark):
    scores = spark.createDataFrame([(1, 5, "mf", 2.0), (1, 6, "mf", 2.0)], "user_id INT, item_id INT, model STRING, score DOUBLE")
    assert [r["score"] for r in ensemble.ensemble_minmax(scores).collect()] == pytest.approx([0.1, 0.1])
