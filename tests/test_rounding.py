"""Rounding of the queries' floating columns."""

import math
import random

from pyspark.sql import functions as F

from shelfwise.plans.catalog import nearest_decimal


def test_same_as_round_for_odd_values(spark):
    rng = random.Random(3)
    values = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 1e300, -1e300, 5e-324, 2.0**40, 2.0**53 + 2]
    for _ in range(3000):
        n = rng.randrange(-(10**9), 10**9)
        # Ties in six and twelve decimals, their neighbours, and values of all sizes.
        values += [(n + 0.5) / 10**6, (n + 0.5) / 10**12, n / 10**7, math.nextafter((n + 0.5) / 10**6, math.inf), rng.gauss(0, 1) * 10.0 ** rng.randrange(-15, 15)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    text = lambda c: (c + F.lit(0.0)).cast("string")
    for places in (6, 12):
        row = df.where(~text(nearest_decimal(F.col("x"), places)).eqNullSafe(text(F.round("x", places)))).first()
        assert row is None, row


def test_few_values_go_through_text(spark):
    """All but the values near a tie are rounded without ``F.round``, which takes most of the time of large results."""
    df = spark.range(1000).select((F.col("id") / 7).alias("x"))
    near = F.abs(F.abs(F.col("x") * 1e6 - F.rint(F.col("x") * 1e6)) - 0.5) <= 0.001
    assert df.where(near).count() == 0
    plan = nearest_decimal(F.col("x"), 6)._jc.toString()
    assert plan.startswith("CASE WHEN") and plan.count("round(") == 1
