import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import interactions, ranking
from shelfwise.plans.recommend import behaviour_recommendations, update_recommendations


def events(n=150, users=4, products=9, seed=2):
    rnd = random.Random(seed)
    return [
        (i, 0 if i % 3 == 0 else rnd.randrange(users), rnd.randrange(products),
         rnd.choice(["view", "view", "purchase", "rating"]), rnd.choice(["s1", "s2", "default", None]))
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id INT, user_id INT, product_id INT, event_type STRING, session_id STRING")


def feedback_loop(rows):
    seen, score = {}, {}
    for _, u, p, _, session in rows:
        seen.setdefault(u, set()).add(p)
        weight = 2.0 if session not in (None, "default") else 1.0
        for a in seen[u]:
            for b in seen[u]:
                if a != b:
                    score[a, b] = score.get((a, b), 0) + weight
    return seen, score


def realtime_loop(rows):
    seen, score = {}, {}
    for _, u, p, _, session in rows:
        seen.setdefault(u, set()).add(p)
        if session:
            for q in seen[u] - {p}:
                score[p, q] = score.get((p, q), 0) + 1
                score[q, p] = score.get((q, p), 0) + 1
    return score


def as_dict(df):
    return {(r["product_id"], r["related_id"]): r["score"] for r in df.collect()}


def test_cooccurrence_feedback(spark, running):
    rows = events()
    assert as_dict(interactions.cooccurrence_feedback(frame(spark, rows))) == feedback_loop(rows)[1]


@pytest.mark.parametrize("block", [2, 64])
def test_cooccurrence_realtime(spark, block, running, monkeypatch):
    monkeypatch.setattr(interactions, "RANK_BLOCK", block)
    rows = events(products=14)
    assert as_dict(interactions.cooccurrence_realtime(frame(spark, rows))) == realtime_loop(rows)


def test_single_product_has_no_relation(spark):
    rows = [(0, 1, 5, "view", "s"), (1, 1, 5, "view", "s")]
    assert as_dict(interactions.cooccurrence_feedback(frame(spark, rows))) == {}
    assert as_dict(interactions.cooccurrence_realtime(frame(spark, rows))) == {}


def update_loop(rows, n, max_seen):
    seen, score = feedback_loop(rows)
    views = {}
    for _, _, p, kind, _ in rows:
        if kind == "view":
            views[p] = views.get(p, 0) + 1
    popular = sorted(views, key=lambda p: (-views[p], p))[:n]
    lists = {}
    for u, mine in seen.items():
        if len(mine) > max_seen:
            continue
        total = {}
        for a in mine:
            for (x, b), s in score.items():
                if x == a and b not in mine:
                    total[b] = total.get(b, 0) + s
        top = sorted(total, key=lambda b: (-total[b], b))[:n]
        top += [p for p in popular if p not in mine and p not in top][: n - len(top)]
        if top:
            lists[u] = top
    return lists


@pytest.mark.parametrize("n,max_seen", [(4, 1000), (12, 6)])
def test_update_recommendations(spark, n, max_seen):
    rows = events(n=60, users=6, products=16, seed=9)
    out = update_recommendations(frame(spark, rows), n=n, max_seen=max_seen).orderBy("rank").collect()
    got = {}
    for r in out:
        got.setdefault(r["user_id"], []).append(r["item_id"])
        assert r["score"] == pytest.approx(1 - 0.01 * (r["rank"] - 1))
    assert got == update_loop(rows, n, max_seen)


def ratings(spark):
    pairs = [(u, i) for u in range(5) for i in range(12) if (u * 7 + i * 5) % 4] + [(9, i) for i in range(12)]
    return pairs, spark.createDataFrame([(u, i, 1.0) for u, i in pairs], "user_id INT, item_id INT, rating DOUBLE")


@pytest.mark.parametrize("n", [2, 6])
def test_sample_negatives_per_user(spark, n):
    pairs, df = ratings(spark)
    seen = {}
    for u, i in pairs:
        seen.setdefault(u, set()).add(i)
    drawn = {}
    for r in interactions.sample_negatives(df, n).collect():
        drawn.setdefault(r["user_id"], []).append(r["item_id"])
    for u, mine in seen.items():
        left = 12 - len(mine)
        assert len(drawn[u]) == n
        if left:
            assert not set(drawn[u]) & mine
            assert left < n or len(set(drawn[u])) == n
    again = interactions.sample_negatives(df.repartition(7), n)
    first = interactions.sample_negatives(df, n)
    assert first.exceptAll(again).count() == 0


def test_sample_negatives_per_row(spark, running):
    pairs, df = ratings(spark)
    rows = interactions.sample_negatives(df, 1, "row").collect()
    assert len(rows) == len(pairs)
    assert not {(r["user_id"], r["item_id"]) for r in rows if r["user_id"] != 9} & set(pairs)


def test_unseen_items(spark):
    pairs, df = ratings(spark)
    got = {(r[0], r[1]) for r in interactions.unseen_items(df, df, df).collect()}
    assert got == {(u, i) for u in {p[0] for p in pairs} for i in range(12)} - set(pairs)


def test_fill_skips_seen_and_listed(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "user_id INT, item_id INT, rank INT")
    popular = spark.createDataFrame([(i, r + 1) for r, i in enumerate([11, 20, 21, 10, 22, 23])], "item_id INT, rank INT")
    seen = spark.createDataFrame([(1, 20), (2, 22)], "user_id INT, item_id INT")
    users = spark.createDataFrame([(2,)], "user_id INT")
    out = ranking.fill_from_popular(recs, popular, seen, 4, users).orderBy("user_id", "rank").collect()
    assert [(r[0], r[1], r[2]) for r in out] == [
        (1, 10, 1), (1, 11, 2), (1, 21, 3), (1, 22, 4), (2, 11, 1), (2, 20, 2), (2, 21, 3), (2, 10, 4)]


def test_merge_popular_keeps_order_and_bound(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "item_id INT, rank INT")
    b = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4)], "item_id INT, rank INT")
    out = ranking.merge_popular(a, b, 2).orderBy("rank").collect()
    assert [r["item_id"] for r in out] == [1, 2, 3, 4]


def test_merge_popular_keeps_every_event_item(spark):
    a = spark.range(1500).selectExpr("cast(id as int) as item_id", "cast(id + 1 as int) as rank")
    b = spark.range(3000).selectExpr("cast(id + 5000 as int) as item_id", "cast(id + 1 as int) as rank")
    out = ranking.merge_popular(a, b, 1500)
    assert out.count() == 3000 and out.agg(F.max("rank")).first()[0] == 3000
    assert ranking.merge_popular(a, b, 10).count() == 1500


def test_filter_keeps_all_and_fills_with_fitting_items(spark):
    from shelfwise.operators import matching

    rows = [(1, i, 1.0 / i, "s", "m") for i in range(1, 9)] + [(2, 100, 1.0, "s", "m")]
    found = spark.createDataFrame(rows, "user_id INT, item_id INT, score DOUBLE, stage STRING, model STRING")
    items = spark.createDataFrame([(i, i < 50) for i in [*range(1, 9), 20, 21, 60, 100]], "item_id INT, ok BOOLEAN")
    popular = spark.createDataFrame([(60, 1), (20, 2), (21, 3)], "item_id INT, rank INT")
    out = matching.filter_candidates(found, items, F.col("ok"), popular, minimum=3).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.item_id) for r in out] == [(1, i) for i in range(1, 9)] + [(2, 20), (2, 21)]
    assert out[0].score == 1.0 and out[0].model == "m" and out[-1].score is None
    cut = matching.filter_candidates(found, items, F.col("ok"), popular, 3, limit=4)
    assert cut.where("user_id = 1").count() == 4


def test_behaviour_lists_hold_active_products_only(spark, sf):
    from shelfwise import datasets
    from shelfwise.operators import cleaning

    events = datasets.behaviour(spark, sf)
    active = cleaning.filter_min_activity(events, 60, 11)
    out = behaviour_recommendations(events, 20, 60, 11)
    left = out.join(active.select("product_id").distinct(), F.col("item_id") == F.col("product_id"), "left_anti")
    assert out.count() > 0 and left.count() == 0
