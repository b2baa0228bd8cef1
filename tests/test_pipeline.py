"""The stored feature pipeline and the whole preprocessing run."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import cleaning, features
from shelfwise.operators.pipeline import FeaturePipeline
from shelfwise.plans.preprocess import preprocess

SCHEMA = "product_id long, title string, category string, price double, votes long"


@pytest.fixture(scope="module")
def rows():
    return [(i, f"red shoe {i % 7} of leather" if i % 3 else "blue hat wool", ["a", "b", None][i % 3], float(i), i % 5) for i in range(60)]


def test_new_rows_get_the_features_of_the_fit(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    FeaturePipeline(spark, str(tmp_path), min_df=0.05).fit(df, "product_id")
    again = FeaturePipeline(spark, str(tmp_path), min_df=0.05)
    new = spark.createDataFrame([(900, "red hat of stone", "z", 30.0, None), (901, None, "b", None, 2)], SCHEMA)
    got = {r.product_id: r for r in again.transform(new).collect()}
    want = {r.product_id: r for r in features.minmax_scale(df, features.standard_scale(df, features.label_encode(df, new, ["category"]), ["price", "votes"]), ["price", "votes"]).collect()}
    for i in (900, 901):
        for c in ("category_encoded", "price_scaled", "votes_scaled", "price_normalized", "votes_normalized"):
            assert got[i][c] == pytest.approx(want[i][c])
    weights = {(r.product_id, r.term): r.weight for r in again.text_weights(new, "product_id", "title").collect()}
    assert {t for _, t in weights} == {"red", "hat"} and sum(w * w for w in weights.values()) == pytest.approx(1)
    own = {tuple(r) for r in again.text_weights(df, "product_id", "title").select("product_id", "term", F.round("weight", 9)).collect()}
    direct = features.tfidf_features(df, df, "product_id", "title", min_df=0.05).select("product_id", "term", F.round("weight", 9))
    assert own == {tuple(r) for r in direct.collect()}


def test_ngrams_need_successive_words(spark):
    df = spark.createDataFrame([(1, "aa rare1 bb aa bb"), (2, "aa bb rare2 cc"), (3, "aa cc bb aa"), (3, "bb aa"), (4, None)], "k long, t string")
    got = {(r.k, r.term): r.weight for r in features.tfidf_features(df, df, "k", "t", min_df=0.4, max_df=1.0, stop_words=[]).collect()}
    assert {t for _, t in got} == {"aa", "bb", "cc", "aa bb", "bb aa"}
    assert (1, "aa bb") in got and (2, "aa bb") in got and (3, "aa bb") not in got


def test_the_run_equals_its_steps(spark, tmp_path):
    raw = spark.createDataFrame([(u, p, str((u + p) % 5 + 1), "text") for u in range(12) for p in range(10) if (u * p) % 7 != 3], "reviewer_id long, asin long, overall string, reviewText string")
    parts = preprocess(raw, str(tmp_path), min_user=8, min_product=9, small=7, now="2024-01-01")
    clean = cleaning.clean_reviews(raw, "2024-01-01")
    kept = cleaning.filter_min_activity(clean, 8, 9)
    key = lambda df: {(r.user_id, r.product_id) for r in df.collect()}
    whole = [key(parts[n]) for n in ("train", "validation", "test")]
    assert set().union(*whole) == key(kept) and sum(map(len, whole)) == kept.count()
    assert len(key(parts["sample"])) == 7 and key(parts["sample"]) <= key(kept)
    again = preprocess(raw, str(tmp_path / "again"), min_user=8, min_product=9, small=7, now="2024-01-01")
    assert all(key(again[n]) == key(parts[n]) for n in parts)
    few = preprocess(raw, str(tmp_path / "few"), sample_size=20, min_user=8, min_product=9, now="2024-01-01")
    assert sum(few[n].count() for n in ("train", "validation", "test")) == 20
