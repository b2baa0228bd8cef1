"""Data-quality profiles, each one aggregate over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import running_sum
from ..session import cut_lineage


def _percent(part, whole):
    return F.when(whole > 0, part * 100.0 / whole)


def _long(df: DataFrame, cols: Sequence[str], type_name: str) -> DataFrame:
    """(column_name, value) rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).cast(type_name).alias("v")) for c in cols])
    return df.select(F.explode(entries).alias("e")).select(F.col("e.n").alias("column_name"), F.col("e.v").alias("value"))


def missing_values(df: DataFrame) -> DataFrame:
    """Per column: share of nulls in percent."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), _percent(F.col(f"_{i}"), F.col("_rows")).alias("missing_pct"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.inline(entries))


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows, and their percentage.

    Rows are grouped by 128 bits of hash, so that long texts stay where they are.
    """
    columns = [F.col(c) for c in (subset or df.columns)]
    # The hash skips nulls, so their places are hashed too.
    parts = [*columns, *[c.isNull() for c in columns]]
    groups = df.groupBy(F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
        _percent(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.sum("n")).alias("duplicate_percentage"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: range, centre, spread, zeros, negatives and |z| > 3 outliers.

    Works on (column, value, count) rows, so repeated values are counted before
    the shuffle. The median comes from running counts cut into chunks, never
    from one task holding a column.
    """
    counted = _long(df, cols or numeric_columns(df), "double").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    values = cut_lineage(counted, "values")
    present = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    n, v = F.col("n"), F.col("value")
    mean = F.sum(v * n) / F.sum(n)
    basic = values.groupBy("column_name").agg(F.sum("n").alias("rows"))
    moments = present.groupBy("column_name").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        mean.alias("mean"),
        F.sum("n").alias("present"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros_count"),
        F.sum(F.when(v < 0, n).otherwise(0)).alias("negative_count"),
    )
    # One row per column: as many rows as the table is wide, so they can be broadcast.
    centred = present.join(F.broadcast(moments.select("column_name", "mean", "present")), "column_name")
    spread = centred.groupBy("column_name").agg(
        F.sqrt(
            F.sum(F.pow(v - F.col("mean"), 2) * n) / F.nullif(F.max("present") - 1, F.lit(0))
        ).alias("std")
    )
    stats = moments.join(spread, "column_name")
    outliers = (
        present.join(F.broadcast(stats.select("column_name", "mean", "std")), "column_name")
        .groupBy("column_name")
        .agg(F.sum(F.when(F.abs((v - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))) > 3, n).otherwise(0)).alias("outliers"))
    )
    upto = running_sum(present, ["column_name"], [v], n, "upto").join(
        F.broadcast(moments.select("column_name", "present")), "column_name"
    )
    low, high = F.floor((F.col("present") + 1) / 2), F.floor(F.col("present") / 2) + 1

    def holds(position):
        return (F.col("upto") - n < position) & (position <= F.col("upto"))

    medians = (
        upto.where(holds(low) | holds(high))
        .groupBy("column_name")
        .agg((F.max(F.when(holds(low), v)) / 2 + F.max(F.when(holds(high), v)) / 2).alias("median"))
    )
    spread_ok = F.col("std") > 0
    rows = F.col("rows")
    return (
        basic.join(stats, "column_name", "left")
        .join(outliers, "column_name", "left")
        .join(medians, "column_name", "left")
        .select(
            "column_name",
            "min",
            "max",
            "mean",
            "median",
            "std",
            F.coalesce("zeros_count", F.lit(0)).alias("zeros_count"),
            _percent(F.coalesce("zeros_count", F.lit(0)), rows).alias("zeros_percentage"),
            F.coalesce("negative_count", F.lit(0)).alias("negative_count"),
            _percent(F.coalesce("negative_count", F.lit(0)), rows).alias("negative_percentage"),
            F.when(spread_ok, F.col("outliers")).alias("outliers_count"),
            F.when(spread_ok, _percent(F.col("outliers"), rows)).alias("outliers_percentage"),
        )
    )


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per other column: distinct values, mode, largest count, empty texts and id-like flags.

    Values are counted by 128 bits of hash, so long texts are neither shuffled nor
    written; only the modes are looked up as texts.
    """
    names = cols or categorical_columns(df)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    value = F.col("value")
    digest = [F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"), value.isNull().alias("missing")]
    rows = _long(df, names, "string").select("column_name", "value", *digest)
    empty = (value == "") & F.col("column_name").isin(*text)
    counts = cut_lineage(
        rows.groupBy("column_name", "h1", "h2", "missing").agg(F.count("*").alias("n"), F.count_if(empty).alias("empty")), "values"
    )
    n = F.col("n")
    # One row per column, safe to broadcast.
    best = F.broadcast(counts.where(~F.col("missing")).groupBy("column_name").agg(F.max("n").alias("best")))
    # The smallest of the values with that count. Where every value is single, all are among them, and no join is needed.
    held = rows.where(~F.col("missing")).join(best, "column_name")
    winners = counts.join(best, "column_name").where((n == F.col("best")) & (n > 1) & ~F.col("missing")).select("column_name", "h1", "h2")
    tied = held.where("best > 1").join(winners, ["column_name", "h1", "h2"], "left_semi")
    mode = held.where("best = 1").select("column_name", "value").unionByName(tied.select("column_name", "value")).groupBy("column_name").agg(
        F.min("value").alias("top_value")
    )
    summary = counts.groupBy("column_name").agg(
        F.count("*").alias("unique_count"),
        F.max("n").alias("top_value_count"),
        F.sum("n").alias("rows"),
        F.sum("empty").alias("empty_count"),
    )
    return summary.join(mode, "column_name", "left").select(
        "column_name",
        "unique_count",
        _percent(F.col("unique_count"), F.col("rows")).alias("unique_percentage"),
        "top_value",
        "top_value_count",
        _percent(F.col("top_value_count"), F.col("rows")).alias("top_value_percentage"),
        "empty_count",
        (F.col("unique_count") == 1).alias("single_value"),
        ((F.col("unique_count") == F.col("rows")) & (F.col("rows") > 10)).alias("all_unique"),
    )


def _id_missing(df: DataFrame, col: str):
    return F.col(col).isNull() | (F.col(col).cast("string") == "")


def consistency_check(df: DataFrame, now: str) -> DataFrame:
    """One row: ratings outside 1..5, dates after ``now`` and empty ids, as counts and percentages.

    The distinct bad ratings come from ``invalid_ratings``: there may be many.
    """
    rows = F.count("*")
    checks = {
        "invalid_rating": (F.col("rating") < 1) | (F.col("rating") > 5),
        "future_date": F.col("review_date") > F.lit(now).cast("timestamp"),
        "empty_user_id": _id_missing(df, "user_id"),
        "empty_product_id": _id_missing(df, "product_id"),
    }
    parts = []
    for name, bad in checks.items():
        parts += [F.count_if(bad).alias(f"{name}_count"), _percent(F.count_if(bad), rows).alias(f"{name}_percentage")]
    return df.agg(*parts)


def invalid_ratings(df: DataFrame) -> DataFrame:
    """Distinct ratings outside 1..5."""
    return df.where((F.col("rating") < 1) | (F.col("rating") > 5)).select("rating").distinct()


def relationship_check(df: DataFrame) -> DataFrame:
    """One row: text length of the worst against the best ratings, verified against other ratings."""
    length = F.length(F.coalesce("review_text", F.lit("")))
    means = df.agg(
        F.avg(F.when(F.col("rating") == 1, length)).alias("low_rating_length"),
        F.avg(F.when(F.col("rating") == 5, length)).alias("high_rating_length"),
        F.avg(F.when(F.col("verified_purchase"), F.col("rating"))).alias("verified_mean"),
        F.avg(F.when(~F.col("verified_purchase"), F.col("rating"))).alias("unverified_mean"),
    )
    difference = F.col("verified_mean") - F.col("unverified_mean")
    ratio = F.when(F.col("high_rating_length") > 0, F.col("low_rating_length") / F.col("high_rating_length"))
    return means.withColumns(
        {"length_ratio": ratio, "difference": difference, "large_difference": F.abs(difference) > 0.5}
    )


def temporal_profile(df: DataFrame) -> DataFrame:
    """One row: date range and how evenly the months that have rows are filled."""
    month = F.date_trunc("month", F.col("review_date"))
    months = (
        df.where(F.col("review_date").isNotNull())
        .groupBy(month.alias("month"))
        .agg(F.count("*").alias("n"), F.min("review_date").alias("lo"), F.max("review_date").alias("hi"))
    )
    wide = months.agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count("*").alias("months_count"),
        F.avg("n").alias("mean_monthly"),
        F.max("n").alias("max_monthly"),
        F.min("n").alias("min_monthly"),
    )
    several = F.col("months_count") > 1
    spike = F.col("max_monthly") / F.col("mean_monthly")
    return wide.where(F.col("lo").isNotNull()).select(
        F.date_format("lo", "yyyy-MM-dd").alias("min_date"),
        F.date_format("hi", "yyyy-MM-dd").alias("max_date"),
        F.floor((F.unix_timestamp("hi") - F.unix_timestamp("lo")) / 86400).alias("days"),
        "months_count",
        *[F.when(several, F.col(c)).alias(c) for c in ("mean_monthly", "max_monthly", "min_monthly")],
        F.when(several, spike).alias("spike_ratio"),
        F.when(several, spike > 3).alias("has_spikes"),
    )


def quality_summary(missing: DataFrame, duplicates: DataFrame, consistency: DataFrame) -> DataFrame:
    """One row: number of issues and the level they amount to."""
    high = missing.agg(
        F.count_if(F.col("missing_pct") > 0).alias("columns_with_missing"),
        F.count_if(F.col("missing_pct") > 20).alias("columns_high_missing"),
    )
    dup = duplicates.select((F.col("duplicate_percentage") > 5).cast("int").alias("d")).scalar()
    flags = consistency.select(
        F.struct(
            (F.col("invalid_rating_count") > 0).cast("int").alias("r"),
            (F.col("future_date_count") > 0).cast("int").alias("f"),
            ((F.col("empty_user_id_count") > 0) | (F.col("empty_product_id_count") > 0)).cast("int").alias("e"),
        ).alias("s")
    ).scalar()
    issues = F.col("columns_high_missing") + F.col("d") + F.col("s.r") + F.col("s.f") + F.col("s.e")
    return (
        high.withColumn("d", F.coalesce(dup, F.lit(0)))
        .withColumn("s", flags)
        .withColumn("issues_count", issues)
        .withColumn(
            "quality_level",
            F.when(F.col("issues_count") == 0, "Excellent")
            .when(F.col("issues_count") <= 2, "Good")
            .when(F.col("issues_count") <= 5, "Fair")
            .otherwise("Poor"),
        )
        .drop("d", "s")
    )
