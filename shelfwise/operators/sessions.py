"""Sessions, behaviour statistics and drift over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# The kinds a session counts, and those compared for drift.
SESSION_COUNTS = {
    "views": "view",
    "add_to_carts": "add_to_cart",
    "purchases": "purchase",
    "recommend_clicks": "recommend_click",
}
DRIFT_TYPES = ("view", "add_to_cart", "purchase", "recommend_click")


SUMS = ("events", *SESSION_COUNTS)


def session_cells(events: DataFrame) -> DataFrame:
    """Events added up per (session id, minute, product): first and last moment, first user, counts.

    Cells of parts of a table add up to those of the whole with ``merge_cells``.
    """
    rows = events.where(
        F.col("user_id").isNotNull()
        & F.col("product_id").isNotNull()
        & F.col("event_type").isNotNull()
        & F.col("session_id").isNotNull()
    ).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("session_id", F.floor(F.col("us") / 60_000_000).alias("minute"), "product_id").agg(
        F.min("us").alias("lo"),
        F.max("us").alias("hi"),
        F.count("*").alias("events"),
        F.min_by("user_id", "us").alias("user_id"),
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in SESSION_COUNTS.items()],
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """One row per cell of several tables of cells."""
    return cells.groupBy("session_id", "minute", "product_id").agg(
        F.min_by("user_id", "lo").alias("user_id"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in SUMS]
    )


def sessions_of(cells: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(session_id, start, user_id, hi, products, counts): a session id's cells without a pause longer than the gap, in microseconds."""
    gap = gap_minutes * 60_000_000
    minutes = cells.groupBy("session_id", "minute").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = W.partitionBy("session_id").orderBy("minute")
    starts = F.when(F.col("lo") - F.lag("hi").over(order) <= gap, F.lit(None)).otherwise(F.col("lo"))
    placed = (
        minutes.withColumn("start", starts)
        .withColumn("start", F.last("start", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .select("session_id", "minute", "start")
    )
    per_product = (
        cells.join(placed, ["session_id", "minute"])
        .groupBy("session_id", "start", "product_id")
        .agg(
            F.min_by("user_id", "lo").alias("user_id"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            *[F.sum(c).alias(c) for c in SUMS],
        )
    )
    return per_product.groupBy("session_id", "start").agg(
        F.min_by("user_id", "lo").alias("user_id"),
        F.max("hi").alias("hi"),
        F.count("*").alias("products"),
        *[F.sum(c).alias(c) for c in SUMS],
    )


def session_stats(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """One row per session: a session id's events with no pause longer than the gap.

    Events are first added up per (session id, minute, product) and per minute,
    so the ordered step sees minutes, not events, of a busy session id; rows of
    one minute are never split because the gap is longer.
    """
    return sessions_of(session_cells(events), gap_minutes).select(
        "session_id",
        "user_id",
        F.timestamp_micros("start").alias("start_time"),
        F.timestamp_micros("hi").alias("last_time"),
        "events",
        "products",
        *SESSION_COUNTS,
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def behaviour_summary(sessions: DataFrame, active_users: Column) -> DataFrame:
    """One row of totals, averages and rates over sessions; no row without any."""
    totals = sessions.agg(
        F.count("*").alias("active_sessions"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in SESSION_COUNTS],
        F.coalesce(F.sum("products"), F.lit(0)).alias("_products"),
    )
    n = F.col("active_sessions")
    return (
        totals.where(n > 0)
        .withColumns(
            {
                "active_users": active_users,
                "avg_session_length": F.col("total_events") / n,
                "avg_session_products": F.col("_products") / n,
                "view_to_cart_rate": _rate(F.col("total_add_to_carts"), F.col("total_views")),
                "cart_to_purchase_rate": _rate(F.col("total_purchases"), F.col("total_add_to_carts")),
                "recommendation_click_rate": _rate(F.col("total_recommend_clicks"), F.col("total_views")),
            }
        )
        .drop("_products")
    )


def behaviour_window(events: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Behaviour statistics at a moment: sessions whose last event is at most ``minutes`` old, whole counts.

    Active users are those with an event inside the window.
    """
    upto = events.where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    start = F.timestamp_micros(F.unix_micros(F.lit(as_of).cast("timestamp")) - minutes * 60_000_000)
    # Only sessions seen inside the window can be active, so the history of the others is left out first.
    seen = upto.where(F.col("ts") >= start).select(F.col("session_id").alias("_seen")).distinct()
    theirs = upto.join(seen, F.col("session_id").eqNullSafe(F.col("_seen")), "left_semi")
    active = session_stats(theirs, minutes).where(F.col("last_time") >= start)
    users = upto.where(F.col("ts") >= start).agg(F.count_distinct("user_id")).scalar()
    return behaviour_summary(active, users)


def type_shares(counts: DataFrame) -> DataFrame:
    """One row with the share of each compared kind, from (event_type, n) rows."""
    total = F.sum(F.when(F.col("event_type").isin(*DRIFT_TYPES), F.col("n")).otherwise(0))
    return counts.agg(
        F.struct(
            *[
                (F.sum(F.when(F.col("event_type") == k, F.col("n")).otherwise(0)) / F.greatest(F.lit(1), total)).alias(k)
                for k in DRIFT_TYPES
            ]
        ).alias("shares"),
        F.coalesce(total, F.lit(0)).alias("total"),
    )


def drift_detect(
    events: DataFrame, baseline: DataFrame, as_of: str, minutes: int = 60, threshold: float = 0.2
) -> DataFrame:
    """One row: mean absolute difference of the kinds' shares between the window and ``baseline`` (event_type, n)."""
    end = F.lit(as_of).cast("timestamp")
    start = F.timestamp_micros(F.unix_micros(end) - minutes * 60_000_000)
    recent = events.where((F.col("ts") >= start) & (F.col("ts") <= end))
    current = type_shares(recent.groupBy("event_type").agg(F.count("*").alias("n")))
    reference = type_shares(baseline).select("shares").scalar()
    return _drift(current.withColumn("reference", reference).where(F.col("total") > 0), threshold)


def _drift(df: DataFrame, threshold: float) -> DataFrame:
    gaps = [F.abs(F.col(f"reference.{k}") - F.col(f"shares.{k}")) for k in DRIFT_TYPES]
    score = sum(gaps[1:], gaps[0]) / len(gaps)
    return df.withColumn("drift_score", score).select(
        *[c for c in df.columns if c not in ("shares", "reference")],
        "drift_score",
        (F.col("drift_score") > threshold).alias("alert"),
    )


def drift_timeline(events: DataFrame, baseline: DataFrame, minutes: int = 60, slide: int = 1, threshold: float = 0.2) -> DataFrame:
    """Drift of every sliding window; works on tables and, with a watermark, on streams.

    Events are counted per slide first, and windows add up slides: a row stands in
    ``minutes / slide`` windows for a slide's events together, not for each event.
    """
    if minutes % slide:
        raise ValueError("a window is a whole number of slides")
    kind = F.col("event_type")
    per_slide = (
        events.where(kind.isin(*DRIFT_TYPES))
        .groupBy(F.window("ts", f"{slide} minutes").alias("s"))
        .agg(F.count("*").alias("total"), *[F.count_if(kind == k).alias(k) for k in DRIFT_TYPES])
    )
    counted = (
        per_slide.withColumn("at", F.window_time("s"))
        .groupBy(F.window("at", f"{minutes} minutes", f"{slide} minutes").alias("w"))
        .agg(*[F.sum(c).alias(c) for c in ("total", *DRIFT_TYPES)])
    )
    # Shares of the baseline are numbers by the time a stream starts.
    reference = type_shares(baseline).select("shares").first()["shares"]
    shares = F.struct(*[(F.col(k) / F.col("total")).alias(k) for k in DRIFT_TYPES])
    fixed = F.struct(*[F.lit(float(reference[k])).alias(k) for k in DRIFT_TYPES])
    rows = counted.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", shares.alias("shares"), fixed.alias("reference")
    )
    return _drift(rows, threshold)
