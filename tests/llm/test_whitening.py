import math

import numpy as np
import pytest

from shelfwise.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, d):
    """(ids, integer vectors, fit list)."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
              if v is not None and len(v) == d and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    return usable, np.array(sorted({tuple(x) for _, x in usable}), dtype=np.int64)


def check(rows, got, d, most=16):
    usable, fit = plain(rows, d)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes.T[::-1]
    k = min(most, int((values > 1e-9 * values.sum()).sum()))
    assert len(got) == k * len(usable)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(round(r.whitened, 9))
        assert r.n == n and r.identity_error <= 1e-8
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-7)
    signs = {}
    for i, x in usable:
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        own = by[i, dev]
        assert sorted(own) == list(range(1, k + 1))
        for c in range(k):
            z = float((np.array(x) - sums / n) @ axes[c] / math.sqrt(values[c]))
            near = [s for s in (1, -1) if any(abs(s * z - w) < 1e-5 * max(1, abs(z)) for w in own[c + 1])]
            assert near
            if abs(z) > 1e-3:
                assert signs.setdefault(c, near) == near


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (240, 20)) * np.geomspace(4, 0.05, 20)
    dense = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    return dense + [(500 + i, dense[3][1]) for i in range(120)]


def test_equals_plain_eigenvectors(spark, rows):
    odd = [(900, None), (901, [1.0, None] * 10), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, []), (905, [1.0] * 3), (906, [1e30] * 20), (None, [0.5] * 20)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], SCHEMA).selectExpr("*", "'y' as x", "1 as n", "2 as part", "3 as component")
    got = whitening.whiten(whitening.integer_vectors(df.repartition(7))).collect()
    check(rows + [odd[-1]], got, 20)


def test_far_mean_and_near_dependent_columns(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 3, (400, 6))
    v[:, 5] = v[:, 0] + v[:, 1] + rng.normal(0, 0.02, 400)
    v += 50_000
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], SCHEMA)
    check(rows, whitening.whiten(whitening.integer_vectors(df)).collect(), 6)


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0, 2, (90, 5)) * 64) / 64
    v[:, 2], v[:, 4] = 1.0, v[:, 0] - v[:, 1]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = whitening.whiten(whitening.integer_vectors(spark.createDataFrame([(i, x, 1) for i, x in rows], SCHEMA))).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(rows, got, 5)


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = whitening.whiten(whitening.integer_vectors(empty))
    assert out.count() == 0 and "identity_error" in out.columns
    same = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(9)], SCHEMA)
    assert whitening.whiten(whitening.integer_vectors(same)).count() == 0


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(2, np.array([0, 0]), np.zeros((0, 2)), np.zeros(0), 0.0)
    out = whitening.deviations(np.array([[2**40, 1], [2**29, 3]]), model)
    assert out.to_pylist() == [None, 4 * 2**58 + 36]


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.op12_embedding_whitening(spark, sf).collect(), 64)
