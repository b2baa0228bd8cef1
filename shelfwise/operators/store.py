"""Feature-store tables and stored recommendation lists.

A feature store is a table (feature_type, entity_id, feature_name, value,
updated_at, expires_at) with JSON text values; a maintenance step returns the
next snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest_per_key

KEY = ["feature_type", "entity_id", "feature_name"]

# Lifetimes of stored lists in seconds.
LIST_TTL = 3600
COLD_START_TTL = 1800


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _alive(now: str | None) -> Column:
    if now is None:
        return F.lit(True)
    return F.col("expires_at").isNull() | (F.col("expires_at") > _at(now))


def set_features(store: DataFrame | None, rows: DataFrame, ttl: int | None = None) -> DataFrame:
    """Next snapshot: the newest value per key. ``rows`` are (type, entity, name, value, updated_at)."""
    expires = F.lit(None).cast("timestamp") if ttl is None else F.timestamp_micros(
        F.unix_micros("updated_at") + ttl * 1_000_000
    )
    fresh = rows.select(*KEY, "value", "updated_at", expires.alias("expires_at"))
    everything = fresh if store is None else store.select(fresh.columns).unionByName(fresh)
    return latest_per_key(everything, KEY, ["updated_at", "value"])


def get_features(store: DataFrame, feature_type: str, names: Sequence[str], now: str | None = None) -> DataFrame:
    """One row per entity with a text column per named feature; null if absent or expired."""
    alive = store.where((F.col("feature_type") == feature_type) & F.col("feature_name").isin(*names) & _alive(now))
    return alive.groupBy("entity_id").agg(
        *[F.max_by(F.when(F.col("feature_name") == n, F.col("value")), F.when(F.col("feature_name") == n, F.col("updated_at"))).alias(n) for n in names]
    )


def all_features(store: DataFrame, feature_type: str, now: str | None = None) -> DataFrame:
    """One row per entity with all its live features as a map."""
    alive = store.where((F.col("feature_type") == feature_type) & _alive(now))
    return latest_per_key(alive, KEY, ["updated_at", "value"]).groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_name", "value")))).alias("features")
    )


def set_vector(store: DataFrame | None, rows: DataFrame, ttl: int | None = None) -> DataFrame:
    """Store ``vector`` arrays as JSON text."""
    return set_features(store, rows.withColumn("value", F.to_json("vector")), ttl)


def get_vector(store: DataFrame, feature_type: str, name: str, now: str | None = None) -> DataFrame:
    """(entity_id, vector ARRAY<FLOAT>)."""
    alive = store.where((F.col("feature_type") == feature_type) & (F.col("feature_name") == name) & _alive(now))
    return alive.select("entity_id", F.from_json("value", "array<float>").alias("vector"))


def increment_features(store: DataFrame, deltas: DataFrame, now: str) -> DataFrame:
    """Next snapshot with the deltas added to the numeric values; a missing value counts as 0.

    Deltas are summed per key before the join, so the join moves one row per key.
    """
    sums = deltas.groupBy(*KEY).agg(F.sum("delta").alias("_delta"))
    old = store.select(*KEY, "value", "updated_at", "expires_at")
    changed = F.col("_delta").isNotNull()
    total = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) + F.col("_delta")
    return old.join(sums, KEY, "full_outer").select(
        *KEY,
        F.when(changed, total.cast("string")).otherwise(F.col("value")).alias("value"),
        F.when(changed, _at(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        "expires_at",
    )


def delete_features(store: DataFrame, feature_type: str, entity_id: str, name: str | None = None) -> DataFrame:
    """Next snapshot without one feature, or without any feature, of an entity."""
    match = (F.col("feature_type") == feature_type) & (F.col("entity_id") == entity_id)
    if name is not None:
        match &= F.col("feature_name") == name
    return store.where(~match)


def feature_stats(store: DataFrame, feature_type: str | None = None) -> DataFrame:
    rows = store if feature_type is None else store.where(F.col("feature_type") == feature_type)
    return rows.agg(F.count("*").alias("feature_count"))


def list_entities(store: DataFrame, feature_type: str, pattern: str = ".*") -> DataFrame:
    """Distinct entities of a type whose whole id matches the regular expression."""
    return (
        store.where((F.col("feature_type") == feature_type) & F.col("entity_id").rlike(f"^(?:{pattern})$"))
        .select("entity_id")
        .distinct()
    )


# ---------------------------------------------------------------- stored lists


def context_key(context: Column) -> Column:
    """Text of a context map that does not depend on the order of its entries."""
    entries = F.transform(F.array_sort(F.map_entries(context)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.coalesce(F.array_join(entries, ":"), F.lit(""))


def recs_snapshot(log: DataFrame, now: str) -> DataFrame:
    """The newest list per (user, model, context, limit), if it has not expired.

    ``log`` rows hold the list in any further columns, ``created_at``, and
    ``cold_start``, which halves the lifetime.
    """
    ttl = F.when(F.col("cold_start"), COLD_START_TTL).otherwise(LIST_TTL)
    keyed = log.withColumn("expires_at", F.timestamp_micros(F.unix_micros("created_at") + ttl.cast("long") * 1_000_000))
    rest = [c for c in log.columns if c not in ("user_id", "model", "context", "limit", "created_at")]
    newest = latest_per_key(keyed, ["user_id", "model", "context", "limit"], ["created_at", *rest])
    return newest.where(F.col("expires_at") > _at(now))


def recs_invalidate(snapshot: DataFrame, user=None, model: str | None = None) -> DataFrame:
    """Next snapshot without the lists of a user, of a model, of both together, or of anyone."""
    match = F.lit(True)
    if user is not None:
        match &= F.col("user_id") == user
    if model is not None:
        match &= F.col("model") == model
    return snapshot.where(~match)


def recs_snapshot_stats(snapshot: DataFrame) -> DataFrame:
    """Stored lists per model."""
    return snapshot.groupBy("model").agg(F.count("*").alias("entries"))
