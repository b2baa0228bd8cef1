import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 20 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in usable if c != q))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.fixture
def rows():
    rng = np.random.default_rng(5)
    dense = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(130)]
    dense[7:30] = [(i, dense[3][1]) for i in range(7, 30)]
    sparse = [(200 + i, [0.5 if j == i % 8 else 0.0 for j in range(8)]) for i in range(60)]
    odd = [(400, None), (401, [1.0, None, 0.5]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, []), (420, [0.0] * 8), (440, [1.0, 2.0])]
    return dense + sparse + odd


@pytest.mark.parametrize("sizes", [None, (4, 30)])
def test_equals_plain_search(spark, rows, sizes):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 as v", "'y' as x", "1 as rank")
    out = topk.search(topk.integer_vectors(df), F.col("vec_id") % 20 == 0, 20, sizes)
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, 20)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(20, [1.0], 1), (3, [2.0], 1)], SCHEMA)
    assert [tuple(r) for r in topk.search(topk.integer_vectors(one), F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 3, 64 * 128)]
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.search(topk.integer_vectors(empty), F.col("vec_id") % 20 == 0).count() == 0


def test_large_weights_keep_exact_scores(spark):
    rows = [(i, [3e7 + i, -3e7], 1) for i in (20, 21, 22)]
    out = topk.search(topk.integer_vectors(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") == 20).collect()
    assert [tuple(r) for r in out] == plain([(i, v) for i, v, _ in rows], 20)


def test_many_rows_with_the_id_of_a_query_leave_its_list_whole(spark):
    rows = [(20, [2.0, 1.0])] * 30 + [(100 + 20 * i + 1, [0.01 * i, 0.5]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    out = {tuple(r) for r in topk.search(topk.integer_vectors(df), F.col("vec_id") == 20).collect()}
    c_ids, c = np.array([i for i, _ in rows]), np.array([[math.floor(64 * float(np.float32(x))) for x in v] for _, v in rows])
    ids, found, _ = topk.block_top(np.array([20]), c[:1], c_ids, c, 20)
    best = sorted(((-int(x @ c[0]), int(i)) for i, x in zip(c_ids, c, strict=True) if i != 20))[:20]
    assert list(found) == [i for _, i in best] and set(ids) == {20}
    assert {v for _, _, v, _ in out} <= {i for _, i in best} and len(out) == 20
