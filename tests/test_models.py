import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import bandit, factors, graph, matching
from shelfwise.plans import catalog


def pairs():
    return [(u, i) for u in range(5) for i in range(7) if (u * 3 + i * 2) % 4 != 1] + [(0, 0)]


def matrix(rows):
    a = np.zeros((5, 7))
    for u, i in rows:
        a[u, i] += 1
    full = np.block([[np.zeros((5, 5)), a], [a.T, np.zeros((7, 7))]])
    d = full.sum(axis=1)
    return full / np.sqrt(np.outer(d, d))


def names():
    return [f"u:{u}" for u in range(5)] + [f"i:{i}" for i in range(7)]


def to_matrix(df, dim):
    got = {r["node"]: r["features"] for r in df.collect()}
    return np.array([got.get(n, [0.0] * dim) for n in names()])


def table(spark, m):
    return spark.createDataFrame(
        [(n, [float(x) for x in row]) for n, row in zip(names(), m)], "node STRING, features ARRAY<DOUBLE>"
    )


def test_graph_propagation(spark):
    edges = graph.graph_normalize(spark.createDataFrame(pairs(), "user_id INT, item_id INT"))
    start = np.random.default_rng(0).normal(size=(12, 3))
    a = matrix(pairs())
    want = sum(np.linalg.matrix_power(a, k) @ start for k in range(4)) / 4
    assert to_matrix(graph.graph_propagate(table(spark, start), edges, 3), 3) == pytest.approx(want)


def test_training_gradient_equals_finite_differences(spark):
    edges = graph.graph_normalize(spark.createDataFrame(pairs(), "user_id INT, item_id INT"))
    a = matrix(pairs())
    p = sum(np.linalg.matrix_power(a, k) for k in range(3)) / 3
    triples = [(0, 0, 3), (1, 2, 5), (4, 6, 1)]
    start = np.random.default_rng(1).normal(size=(12, 2))

    def loss(e):
        v = p @ e
        gaps = [v[u] @ (v[5 + i] - v[5 + j]) for u, i, j in triples]
        return np.mean(np.log1p(np.exp(-np.array(gaps))))

    frame = spark.createDataFrame([(f"u:{u}", f"i:{i}", f"i:{j}") for u, i, j in triples], "u STRING, p STRING, q STRING")
    propagated = graph.graph_propagate(table(spark, start), edges, 2)
    got = to_matrix(graph.graph_propagate(graph.bpr_gradient(propagated, frame, 2), edges, 2, 2), 2)
    want = np.zeros_like(start)
    for x in np.ndindex(*start.shape):
        h = np.zeros_like(start)
        h[x] = 1e-6
        want[x] = (loss(start + h) - loss(start - h)) / 2e-6
    assert got == pytest.approx(want, abs=1e-7)


def test_lightgcn_fit_gives_a_vector_per_id(spark):
    rows = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u, i in pairs()], "user_id INT, item_id INT, rating DOUBLE")
    u, i = graph.lightgcn_fit(rows, dim=3, layers=1, epochs=1, lr=0.05, validation=rows)
    assert u.count() == 5 and i.count() == 7
    assert matching.recommend(u, i, 2).count() == 10


def test_lightgcn_orders_held_out_pairs(spark):
    """Users touch most items of their own half; of the pairs never seen, those of the own half come first."""
    every = [(u, i) for u in range(16) for i in range(16)]
    seen = [(u, i) for u, i in every if u % 2 == i % 2 and (3 * u + 5 * i) % 7 not in (0, 1)]
    rows = spark.createDataFrame([(u, i, 1.0 if (u + i) % 8 == 0 else 5.0) for u, i in seen], "user_id INT, item_id INT, rating DOUBLE")
    u, i = graph.lightgcn_fit(rows, dim=8, layers=2, epochs=2, batches=2)
    x, y = ({r[0]: np.array(r[1]) for r in df.collect()} for df in (u, i))
    left = [p for p in every if p not in seen]
    good = [x[a] @ y[b] for a, b in left if a % 2 == b % 2]
    bad = [x[a] @ y[b] for a, b in left if a % 2 != b % 2]
    assert np.mean([g > b for g in good for b in bad]) > 0.7


def test_blocks_of_nodes_propagate_and_descend_as_single_edges_do(spark, tmp_path):
    """Vectors sent per block, in cells that are dense, sparse or in parts, give the sums of vectors sent per edge."""
    rng = np.random.default_rng(8)
    seen = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 300), rng.integers(0, 30, 300) ** 2 // 30, strict=True)})
    rows = spark.createDataFrame(seen, "user_id LONG, item_id LONG")
    graph.edge_weights(rows).write.parquet(f"{tmp_path}/weights")
    weights = spark.read.parquet(f"{tmp_path}/weights")
    triples = graph.bpr_triples(rows.withColumn("rating", (F.col("user_id") + F.col("item_id")) % 3.0), 1)
    triples.withColumn("batch", F.lit(0)).write.parquet(f"{tmp_path}/triples")
    triples = spark.read.parquet(f"{tmp_path}/triples")
    n = triples.count()
    for size in (4, 1000):
        blocks = graph.NodeBlocks(weights, 3, size)
        assert (min(blocks.blocks) > 1) == (size == 4)
        edges = blocks.located(blocks.located(weights, "user_id", 0, "ub", "up"), "item_id", 1, "ib", "ip").withColumnRenamed("weight", "w")
        start = graph.initial_vectors(blocks.nodes(), 3)
        moved = blocks.propagated(blocks.summed(start.join(blocks.nodes(), "node")), blocks.cells(edges), 2)
        slopes = blocks.gradient(moved, graph._triple_cells(triples, blocks).drop("batch"), n)
        want = graph.graph_propagate(start, graph.graph_normalize(rows), 2, 3)
        for mine, theirs in ((moved, want), (slopes, graph.bpr_gradient(want, triples.drop("batch"), 3))):
            theirs = {r["node"]: r["features"] for r in theirs.collect()}
            mine = {r["node"]: r["features"] for r in blocks.rows(mine).collect() if r["node"] in theirs or any(r["features"])}
            assert mine.keys() == theirs.keys()
            assert all(mine[k] == pytest.approx(theirs[k], abs=1e-12) for k in mine)


def test_linucb_equals_rank_one_updates(spark):
    rng = np.random.default_rng(4)
    log = [(int(rng.integers(3)), rng.normal(size=4), float(rng.normal())) for _ in range(60)]
    inverse = {a: np.eye(4) for a in range(3)}
    b = {a: np.zeros(4) for a in range(3)}
    for arm, x, reward in log:
        v = inverse[arm] @ x
        inverse[arm] = inverse[arm] - np.outer(v, v) / (1 + x @ v)
        b[arm] = b[arm] + reward * x
    df = spark.createDataFrame([(a, x.tolist(), r) for a, x, r in log], "arm INT, context ARRAY<DOUBLE>, reward DOUBLE")
    fitted = bandit.linucb_fit(df, 4)
    for row in fitted.collect():
        assert row["theta"] == pytest.approx(inverse[row["arm"]] @ b[row["arm"]])
        assert np.array(row["a_inv"]) == pytest.approx(inverse[row["arm"]])
    for row in bandit.linucb_select(df.drop("arm"), fitted, 0.5).collect():
        x = np.array(row["context"])
        ucb = [inverse[a] @ b[a] @ x + 0.5 * np.sqrt(x @ inverse[a] @ x) for a in range(3)]
        assert row["arm"] == int(np.argmax(ucb)) and row["ucb"] == pytest.approx(max(ucb))


def test_content_factors_equal_a_local_decomposition(spark):
    ids = ["ab1", "bb2", "c3a", "11a", "ca2", "b3c"]
    chars = sorted(set("".join(ids)))
    tf = np.array([[w.count(c) for c in chars] for w in ids], dtype=float)
    idf = np.log((1 + len(ids)) / (1 + (tf > 0).sum(axis=0))) + 1
    m = tf * idf
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    _, _, vt = np.linalg.svd(m)
    want = np.abs(m @ vt[:2].T)
    df = spark.createDataFrame([(w,) for w in ids], "item_id STRING")
    got = {r["item_id"]: r["features"] for r in factors.content_factors(df, components=2).collect()}
    assert np.abs(np.array([got[w] for w in ids])) == pytest.approx(want, abs=1e-6)


def test_content_factors_of_a_wide_alphabet_keep_the_leading_energy(spark):
    rng = np.random.default_rng(6)
    letters = [chr(0x4E00 + i) for i in range(80)]
    shares = 0.8 ** np.arange(80)
    ids = ["".join(rng.choice(letters, 12, p=shares / shares.sum())) + letters[i % 80] + str(i) for i in range(400)]
    chars = sorted(set("".join(ids)))
    tf = np.array([[w.count(c) for c in chars] for w in ids], dtype=float)
    m = tf * (np.log((1 + len(ids)) / (1 + (tf > 0).sum(axis=0))) + 1)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    values = np.linalg.svd(m, compute_uv=False)
    df = spark.createDataFrame([(w,) for w in ids], "item_id STRING")
    got = np.array([r["features"] for r in factors.content_factors(df, components=5, spare=40).collect()])
    assert got.shape == (400, 5)
    assert (got**2).sum(axis=0) == pytest.approx(values[:5] ** 2, rel=1e-3)


def test_factor_models_reproduce_a_simple_taste(spark):
    rows = [(u, i, 5.0 if u % 2 == i % 2 else 1.0) for u in range(8) for i in range(8) if (u + 3 * i) % 5]
    df = spark.createDataFrame(rows, "user_id INT, item_id INT, rating DOUBLE")
    u, i = factors.mf_fit(df, rank=3, max_iter=8)
    top = factors.mf_recommend(u, i, 4).collect()
    assert sum(r["user_id"] % 2 == r["item_id"] % 2 for r in top) / len(top) > 0.9


def test_clusters_hold_their_nearest_items(spark):
    rows = [(i, [float(i // 10) * 100, float(i % 10)]) for i in range(30)]
    df = spark.createDataFrame(rows, "item_id INT, features ARRAY<DOUBLE>")
    out = factors.item_clusters(df, clusters=3).collect()
    assert {r["cluster"] for r in out} <= {0, 1, 2}
    assert sorted(r["item_id"] for r in out) == list(range(30))
    for c in {r["cluster"] for r in out}:
        own = sorted((r["rank"], r["distance"]) for r in out if r["cluster"] == c)
        assert [k for k, _ in own] == list(range(1, len(own) + 1)) and [d for _, d in own] == sorted(d for _, d in own)


def test_unknown_users_get_the_mean_vector(spark):
    uf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "user_id INT, features ARRAY<DOUBLE>")
    items = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "item_id INT, features ARRAY<DOUBLE>")
    users = spark.createDataFrame([(1,), (3,)], "user_id INT")
    best = {r["user_id"]: r["item_id"] for r in matching.generate_candidates(users, uf, items, limit=1).collect()}
    assert best == {1: 7, 3: 8}


@pytest.mark.parametrize("module, name", [(graph, "lightgcn_fit"), (factors, "ncf_gmf_fit")])
def test_registered_queries_train_with_the_operators_defaults(spark, sf, monkeypatch, module, name):
    class Called(Exception):
        pass

    def called(*args, **options):
        raise Called(len(args), options)

    monkeypatch.setattr(module, name, called)
    with pytest.raises(Called) as caught:
        getattr(catalog, name)(spark, sf)
    assert caught.value.args == (1, {})


def test_products_of_the_layer_are_not_written(spark, monkeypatch):
    rows = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(20) if (u + i) % 3], "user_id INT, item_id INT, rating DOUBLE")
    names, cut = [], factors.cut_lineage

    def counted(df, name):
        names.append(name)
        return cut(df, name)

    monkeypatch.setattr(factors, "cut_lineage", counted)
    u, i, weights, intercept = factors.ncf_gmf_fit(rows, dim=3, max_iter=2)
    assert "products" not in names and len(weights) == 3
    scored = factors.ncf_gmf_score(rows.select("user_id", "item_id"), u, i, weights, intercept).collect()
    fu, fi = ({r[0]: np.array(r["features"], float) for r in df.collect()} for df in (u, i))
    assert len(scored) == rows.count()
    for r in scored:
        assert r.score == pytest.approx(fu[r.user_id] * fi[r.item_id] @ np.array(weights) + intercept, abs=1e-12)


def test_blocks_of_the_solver_grow_with_the_ratings(spark, monkeypatch):
    rows = [(u, i, 5.0 if u % 2 == i % 2 else 1.0) for u in range(30) for i in range(20) if (u + 3 * i) % 5]
    df = spark.createDataFrame(rows, "user_id INT, item_id INT, rating DOUBLE")
    made, solver = [], factors.ALS

    def kept(**options):
        made.append(solver(**options))
        return made[-1]

    monkeypatch.setattr(factors, "ALS", kept)
    monkeypatch.setattr(factors, "BLOCK_VALUES", len(rows) * 3 // 12)
    u, i = factors.mf_fit(df, rank=3, max_iter=8)
    assert made[0].getNumUserBlocks() == made[0].getNumItemBlocks() == 12 and made[0].getCheckpointInterval() == 1
    top = factors.mf_recommend(u, i, 4).collect()
    assert sum(r["user_id"] % 2 == r["item_id"] % 2 for r in top) / len(top) > 0.9


def test_only_the_rows_of_a_profile_meet_their_vectors(spark, monkeypatch):
    rows = [(1, 7, 5.0), (1, 8, 2.0), (2, 7, 1.0), (2, 8, None), (3, 9, 5.0), (None, 7, 4.0), (None, 8, 1.0), (4, 5, 5.0), (4, 7, 1.0)]
    ratings = spark.createDataFrame(rows, "user_id INT, item_id INT, rating DOUBLE")
    items = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 3.0]), (5, None)], "item_id INT, features ARRAY<DOUBLE>")
    met, add = [], factors.sum_vectors

    def counted(df, *args):
        met.append(df.count())
        return add(df, *args)

    monkeypatch.setattr(factors, "sum_vectors", counted)
    got = {r["user_id"]: r["features"] for r in factors.content_user_profiles(ratings, items).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.5, 1.5], None: [1.0, 0.0], 4: [0.0, 0.0]} and met == [2, 4]
