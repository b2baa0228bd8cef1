import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise import scale
from shelfwise.operators import ensemble, evaluation, features, matching


def hot_rows(n=400, keys=6, seed=1):
    """(key, seq, value) rows; key 0 holds half of them."""
    rnd = random.Random(seed)
    return [(0 if i % 2 else rnd.randrange(keys), i, rnd.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("chunks", [1, 2, 16, 1024])
def test_running_sum_with_hot_key(spark, chunks):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k INT, seq INT, v INT")
    got = {
        r["seq"]: r["s"]
        for r in scale.running_sum(df, ["k"], [F.col("seq")], F.col("v"), "s", chunks=chunks).collect()
    }
    sums, want = {}, {}
    for k, seq, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[seq] = sums[k]
    assert got == want


def test_running_sum_without_keys_and_with_ties_in_first_column(spark, running):
    rows = [(i % 3, i) for i in range(100)]
    df = spark.createDataFrame(rows, "a INT, b INT")
    got = {(r["a"], r["b"]): r["n"] for r in scale.positions(df, [], [F.col("a"), F.col("b")], "n").collect()}
    assert got == {row: i + 1 for i, row in enumerate(sorted(rows))}


def test_running_sum_of_nothing(spark, running):
    df = spark.createDataFrame([], "k INT, seq INT, v INT")
    assert scale.running_sum(df, ["k"], [F.col("seq")], F.col("v"), "s").count() == 0


def test_dense_index_of_texts(spark, running):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("é",), ("",)], "w STRING")
    assert {r["w"]: r["i"] for r in scale.dense_index(df, "w", "i").collect()} == {"": 0, "a": 1, "b": 2, "é": 3}


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_within_splits_hot_keys(spark, block):
    rows = [(1, i, i * 10) for i in range(20)] + [(2, i, i) for i in range(3)] + [(3, 7, 7)]
    df = spark.createDataFrame(rows, "k INT, item INT, w INT")
    got = sorted(tuple(r) for r in scale.pairs_within(df, "k", "item", ["w"], block=block).collect())
    want = sorted((k, i, j, a, b) for k, i, a in rows for l, j, b in rows if k == l and i < j)
    assert got == want


def test_top_n_plan_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "user_id INT, item_id INT, score DOUBLE")
    plan = scale.top_n(df, ["user_id"], [F.desc("score"), F.col("item_id")], 5)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def vectors(spark, name, n, dim=6, seed=0):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} INT, features ARRAY<DOUBLE>")


@pytest.mark.parametrize("block", [4, 1000])
@pytest.mark.parametrize("cosine", [False, True])
def test_block_scores(spark, block, cosine):
    a, users = vectors(spark, "user_id", 11, seed=1)
    b, items = vectors(spark, "item_id", 17, seed=2)
    if cosine:
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
    s = a @ b.T
    every = {(r[0], r[1]): r[2] for r in matching.block_scores(users, items, block=block, query_block=3, cosine=cosine).collect()}
    assert len(every) == s.size and all(abs(s[k] - v) < 1e-9 for k, v in every.items())
    top = matching.block_scores(users, items, n=3, block=block, query_block=5, cosine=cosine).collect()
    for r in top:
        assert r["item_id"] == np.argsort(-s[r["user_id"]])[r["rank"] - 1]
    assert len(top) == 33


def test_score_ties_go_to_the_lower_item(spark):
    one = spark.createDataFrame([(1, [1.0])], "user_id INT, features ARRAY<DOUBLE>")
    items = spark.createDataFrame([(i, [1.0]) for i in (5, 3, 9, 4)], "item_id INT, features ARRAY<DOUBLE>")
    got = [r["item_id"] for r in matching.block_scores(one, items, n=2, block=2).orderBy("rank").collect()]
    assert got == [3, 4]


@pytest.mark.parametrize("block", [3, 512])
def test_user_similarity(spark, block, monkeypatch):
    monkeypatch.setattr(evaluation, "LIST_BLOCK", block)
    rnd = random.Random(3)
    sets = {u: frozenset([0] + rnd.sample(range(1, 30), 3)) for u in range(14)}
    sets[20] = sets[21] = sets[22] = frozenset([0, 1, 2])
    sets[30] = frozenset([99])
    recs = spark.createDataFrame([(u, i) for u, l in sets.items() for i in l], "user_id INT, item_id INT")
    want = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b
    }
    got = {(r[0], r[1]): r[2] for r in evaluation.pairwise_jaccard(recs).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})
    row = evaluation.personalization(recs).first()
    assert row["users"] == len(sets)
    assert row["personalization"] == pytest.approx(1 - sum(want.values()) / len(want))


def test_weight_fold_equals_the_loop(spark, running, monkeypatch):
    monkeypatch.setattr(ensemble, "FOLD_BLOCK", 4)
    rnd = random.Random(5)
    kinds = ["click", "purchase", "rating", "view_time"]
    rows = [(i, rnd.choice([1, 1, 1, 2]), rnd.choice("ab"), rnd.choice(kinds), float(rnd.randint(1, 5))) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id INT, user_id INT, model STRING, event_type STRING, value DOUBLE")
    want = {}
    for _, u, m, kind, value in rows:
        if kind == "view_time":
            continue
        step = {"click": 0.01, "purchase": 0.03}.get(kind, (value - 3) / 2 * 0.02)
        want[u, m] = max(0.1, min(1.0, want.get((u, m), {"a": 0.99}.get(m, 0.5)) + step))
    got = {(r[0], r[1]): r[2] for r in ensemble.user_model_weights(df, {"a": 0.99}).collect()}
    assert got == pytest.approx(want)


def test_null_keys_are_keys(spark, running):
    rows = [(None if i % 3 else 1, i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "k INT, seq INT, v INT")
    got = sorted(r["s"] for r in scale.running_sum(df, ["k"], [F.col("seq")], F.col("v"), "s").where("k is null").collect())
    assert got == list(range(1, 27))


def test_samples_and_pages(spark, running):
    from shelfwise.operators import cleaning

    df = spark.createDataFrame([(i % 40,) for i in range(100)], "k INT")
    first = sorted(r[0] for r in cleaning.sample_rows(df, 30).collect())
    assert len(first) == 30 and first == sorted(r[0] for r in cleaning.sample_rows(df.repartition(5), 30).collect())
    assert [r[0] for r in scale.first_rows(df.distinct(), [F.col("k")], 5, 10).collect()] == [10, 11, 12, 13, 14]
    assert cleaning.sample_rows(df, 500).count() == 100


@pytest.mark.parametrize("share,most,at_once,met", [(16, 1024, 1 << 18, 1 << 20), (2, 1, 7, 5), (1000, 3, 40, 1), (1, 0, 1, 3)])
def test_list_counts_equal_set_sizes(monkeypatch, share, most, at_once, met):
    for name, value in (("DENSE_SHARE", share), ("DENSE_ITEMS", most), ("COUNTS_AT_ONCE", at_once), ("MET_AT_ONCE", met)):
        monkeypatch.setattr(evaluation, name, value)
    rnd = random.Random(7)
    left, right = ([rnd.sample(range(30), rnd.randrange(0, 9)) + ([99] if rnd.random() < 0.7 else []) for _ in range(n)] for n in (23, 17))
    got = np.concatenate([c for _, c in evaluation._list_counts(*(pa.array([[str(x) for x in items] for items in side], pa.list_(pa.string())) for side in (left, right)))])
    assert got.tolist() == [[len(set(a) & set(b)) for b in right] for a in left]


@pytest.mark.parametrize("block,small", [(8192, 256), (5, 2)])
def test_pairs_of_lists_never_leave_their_task(spark, monkeypatch, block, small):
    monkeypatch.setattr(evaluation, "LIST_BLOCK", block)
    monkeypatch.setattr(evaluation, "SMALL_BLOCK", small)
    rnd = random.Random(3)
    rows = [(f"u{u}", rnd.randrange(12)) for u in range(40) for _ in range(rnd.randrange(1, 5))] + [(None, 1), ("none", None)]
    recs = spark.createDataFrame(rows, "user_id STRING, item_id INT")
    pairs = evaluation.pairwise_jaccard(recs)
    # Pairs are neither shuffled nor joined with sizes: one stage makes and returns them.
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    sets = {u: {i for v, i in rows if v == u and i is not None} for u, _ in rows if u}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r[0], r[1]): r[2] for r in pairs.collect()} == pytest.approx(want)
    # The null user counts as a user.
    users = [u for u in sets if sets[u]]
    row = evaluation.personalization(recs).first()
    assert row["users"] == len(users) + 1
    equal = any(sets[u] == {1} for u in users)
    assert equal or row["personalization"] == pytest.approx(1 - sum(want.values()) / ((len(users) + 1) * len(users) / 2))


def test_all_pairs_of_one_item_block_are_scored_by_several_tasks(spark):
    users = spark.range(1024).selectExpr("id AS user_id", "array(double(id), 1D) AS features")
    items = spark.range(5).selectExpr("id AS item_id", "array(1D, double(id)) AS features")
    got = matching.score_all_pairs(users, items).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["user_id"], r["item_id"]): r["score"] for r in got} == {(u, i): float(u + i) for u in range(1024) for i in range(5)}
    assert len(got) == 5120 and len({r["task"] for r in got}) > 1


def test_running_sum_cuts_only_large_keys(spark, monkeypatch):
    monkeypatch.setattr(scale, "CHUNK_ROWS", 9)
    cut, with_chunk = [], scale.with_chunk

    def counted(df, order, out, chunks):
        cut.append((df.count(), chunks))
        return with_chunk(df, order, out, chunks)

    monkeypatch.setattr(scale, "with_chunk", counted)
    # A null key and key 0 are large, the others hold 9 rows or fewer.
    keys = [None] * 20 + [0] * 30 + [k for k in range(1, 8) for _ in range(k + 2)]
    rows = [(k, i * 7919 % 1009, i % 5) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k INT, seq INT, v INT")
    got = {(r["k"], r["seq"]): r["s"] for r in scale.running_sum(df, ["k"], [F.col("seq")], F.col("v"), "s").collect()}
    assert got == {(k, seq): sum(v for l, at, v in rows if l == k and at <= seq) for k, seq, _ in rows}
    assert sorted(cut) == [(len(rows) - 50, 1), (50, 6)]
    cut.clear()
    small = df.where("k > 0")
    assert scale.running_sum(small, ["k"], [F.col("seq")], F.col("v"), "s").columns == ["k", "seq", "v", "s"]
    assert cut == [(len(rows) - 50, 1)]


def test_terms_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(features, "TASK_ROWS", 100)
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 31))) for i in range(60)], "k INT, t STRING")
    words = features.words_of(texts, "k", "t", [])
    frequent = words.select(F.explode("w").alias("word")).distinct()
    # 1,800 words for 4 shuffle partitions.
    counts = features.terms(words, "k", (1, 2), frequent)
    assert counts.rdd.getNumPartitions() == 18
    got = {(r.k, r.term): r.tf for r in counts.collect()}
    for i in (1, 7, 59):
        own = [f"w{(i * k) % 13}" for k in range(1, 31)]
        grams = own + [f"{a} {b}" for a, b in zip(own, own[1:])]
        assert {t: n for (k, t), n in got.items() if k == i} == {t: grams.count(t) for t in grams}
    weights = features.tfidf_features(texts, texts, "k", "t", stop_words=[])
    assert weights.rdd.getNumPartitions() > 8
    lengths = weights.groupBy("k").agg(F.sum(F.col("weight") * F.col("weight")).alias("l")).collect()
    assert lengths and all(abs(r.l - 1) < 1e-9 for r in lengths)
