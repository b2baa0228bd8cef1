"""Queries against their SQL twins on the smallest tables. SHELFWISE_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

CORE = [
    "entry", "clean_reviews", "text_features", "temporal_features", "tfidf_features", "label_encode", "filter_min_activity",
    "exclude_seen", "sample_negatives", "cooccurrence_feedback", "cooccurrence_realtime", "pairwise_jaccard_models",
    "product_features", "user_event_features", "numeric_profile", "categorical_profile", "quality_summary", "feedback_stats",
    "evaluate_topk", "precision_recall_ndcg", "recs_distribution", "model_success_weights", "top_n_per_user",
    "popularity_by_category", "latest_per_key", "fill_from_popular", "graph_normalize", "content_user_profiles",
    "similar_products", "filter_candidates", "ensemble_weighted_rank", "hybrid_rank_blend", "ensemble_minmax",
    "cold_start_recommend", "recommend_or_cold_start", "recs_snapshot", "get_features", "session_stats", "behaviour_window",
    "drift_detect", "stream_session_stats", "stream_product_features",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("SHELFWISE_ALL") else CORE


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, engine, name):
    df = entry.entry(spark) if name == "entry" else entry.queries()[name](spark, sf)
    name = "behaviour_recommendations" if name == "entry" else name
    cursor = engine.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())
