import numpy as np
import pytest

from shelfwise.operators import bandit
from shelfwise.streaming.bandit import OnlineBandit, stream_linucb

LOG = "arm long, context array<double>, reward double"


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        arm = 0 if rng.random() < 0.33 else int(rng.integers(1, 40))
        x = rng.normal(0, 1, 4)
        rows.append((arm, [float(v) for v in x], float(x[arm % 4] + rng.normal(0, 0.1))))
    return rows


def plain(log):
    fitted = {}
    for arm in {a for a, _, _ in log}:
        x = np.array([c for a, c, _ in log if a == arm])
        y = np.array([r for a, _, r in log if a == arm])
        inverse = np.linalg.inv(np.eye(4) + x.T @ x)
        fitted[arm] = inverse @ (x.T @ y), inverse
    return fitted


def choose(fitted, x, alpha):
    bounds = [(-(t @ x + alpha * np.sqrt(x @ i @ x)), a) for a, (t, i) in fitted.items()]
    return min(bounds)


@pytest.mark.parametrize("block", [512, 7, 1])
def test_arms_are_chosen_as_in_a_plain_loop(spark, log, block):
    arms = bandit.linucb_fit(spark.createDataFrame(log, LOG), 4)
    contexts = [(i, c) for i, (_, c, _) in enumerate(log[:150])] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [1.0]), (903, [0.0] * 4)]
    got = {r.id: (r.arm, r.ucb) for r in bandit.linucb_select(spark.createDataFrame(contexts, "id long, context array<double>"), arms, 0.3, block).collect()}
    assert len(got) == len(contexts) and got[900] == got[901] == got[902] == (None, None)
    fitted = plain(log)
    for i, c in contexts[:150]:
        neg, arm = choose(fitted, np.array(c), 0.3)
        assert got[i][0] == arm and got[i][1] == pytest.approx(-neg)
    assert got[903] == (0, 0.0)  # all bounds are equal


def test_without_arms_or_contexts(spark, log):
    arms = bandit.linucb_fit(spark.createDataFrame(log, LOG), 4)
    none = arms.limit(0)
    contexts = spark.createDataFrame([(1, [1.0] * 4)], "id long, context array<double>")
    assert [(r.id, r.arm) for r in bandit.linucb_select(contexts, none).collect()] == [(1, None)]
    assert bandit.linucb_select(contexts.limit(0), arms).count() == 0


def test_a_stream_fits_the_arms_of_the_whole_log(spark, log, tmp_path):
    df = spark.createDataFrame(log, LOG)
    path = str(tmp_path / "in")
    state = OnlineBandit(spark, str(tmp_path / "state"), df, 4, buckets=8)
    for a, b in ((0, 300), (300, 310), (310, 700)):
        spark.createDataFrame(log[a:b], LOG).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(LOG).parquet(path)
        stream_linucb(source, state, str(tmp_path / "cp"), None).start().awaitTermination()
    fitted = plain(log)
    got = {r.arm: (np.array(r.theta), np.array(r.a_inv)) for r in state.arms.read().collect()}
    assert set(got) == set(fitted)
    for arm, (theta, inverse) in fitted.items():
        assert np.allclose(got[arm][0], theta) and np.allclose(got[arm][1], inverse)
    # The small batch touched a few buckets only, and comes out the same again.
    touched = {a for a, _, _ in log[300:310]}
    assert sum(v == 1 for v in state.arms.manifest(1).values()) <= len(touched)
    again = OnlineBandit(spark, str(tmp_path / "state"), df, 4, buckets=8)
    again.add(spark.createDataFrame(log[310:], LOG), 2)
    replayed = {r.arm: np.array(r.theta) for r in again.arms.read().collect()}
    assert set(replayed) == set(got) and all(np.allclose(replayed[a], got[a][0]) for a in got)
