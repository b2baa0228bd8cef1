"""Batch readers, writers and keyed table maintenance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import shard_id
from ..scale import first_rows


def read_reviews(
    spark: SparkSession, path: str, nrows: int | None = None, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """Read a CSV, JSON-lines or Parquet file, chosen by suffix; ``nrows`` is the caller's row cap.

    ``multi_line`` is for CSV fields with line breaks; each file is then one task.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "csv":
        df = reader.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    elif suffix in ("json", "jsonl"):
        df = reader.json(path)
    elif suffix == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported file format: {path}")
    return df if nrows is None else df.limit(nrows)


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write CSV (with header) or Parquet, replacing what was there."""
    if format not in ("csv", "parquet"):
        raise ValueError(f"unsupported output format: {format}")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).csv(path) if format == "csv" else writer.parquet(path)


def to_recommendations(recs: DataFrame, model_version: str, created_at: str) -> DataFrame:
    """Rows of the recommendations table for freshly made lists; nothing clicked or bought yet."""
    return recs.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("item_id").cast("string").alias("product_id"),
        F.col("score").cast("decimal(10,6)").alias("score"),
        F.lit(model_version).alias("model_version"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("served_at"),
        F.lit(False).alias("clicked"),
        F.lit(False).alias("purchased"),
    )


def write_recommendations(recs: DataFrame, path: str, model_version: str, created_at: str) -> None:
    """Store lists under their model version; other versions stay untouched."""
    rows = to_recommendations(recs, model_version, created_at)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_version")
        .parquet(path)
    )


def write_factors(factors: DataFrame, path: str) -> None:
    """Store (id, features) rows."""
    factors.write.mode("overwrite").parquet(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_page(df: DataFrame, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` .. ``skip + limit`` in the order of a unique key."""
    return first_rows(df, [F.col(key)], limit, skip)


def table_upsert(base: DataFrame, changes: DataFrame, key: str, now: str) -> DataFrame:
    """New snapshot: changed columns overwrite, new keys are added, touched rows get ``updated_at``.

    ``changes`` holds at most one row per key and any subset of the columns.
    """
    stamp = F.lit(now).cast("timestamp")
    changed = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = base.join(new, key, "full_outer")
    touched = F.col("_new").isNotNull()
    columns = []
    for c in base.columns:
        if c in changed:
            columns.append(F.when(touched, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c != "updated_at":
            columns.append(F.col(c))
    before = F.col("updated_at") if "updated_at" in base.columns else F.lit(None).cast("timestamp")
    return joined.select(*columns, F.when(touched, stamp).otherwise(before).alias("updated_at"))


def table_delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """New snapshot without the given keys."""
    return base.join(keys.select(key), key, "left_anti")


def sharded_write(df: DataFrame, path: str, n: int = 4, col: str = "user_id") -> None:
    """Append rows below one folder per shard.

    A shard holds 1/n of the users but, with a hot user, far more than 1/n of
    the rows; several tasks therefore write to each shard folder.
    """
    rows = df.withColumn("shard", shard_id(F.col(col), n))
    rows.write.mode("append").partitionBy("shard").parquet(path)


def sharded_lookup(spark: SparkSession, path: str, users: DataFrame, n: int = 4, col: str = "user_id") -> DataFrame:
    """Rows of the given users.

    The users' shard numbers, at most ``n``, are read first and become a filter on
    the folders, so that the other shards are not opened.
    """
    wanted = users.select(col).distinct().withColumn("shard", shard_id(F.col(col), n))
    shards = [r[0] for r in wanted.select("shard").distinct().where("shard is not null").limit(n).collect()]
    return spark.read.parquet(path).where(F.col("shard").isin(shards)).join(wanted, ["shard", col], "left_semi")


def map_shards(df: DataFrame, fn: Callable[[DataFrame], DataFrame], n: int = 4, col: str = "user_id") -> DataFrame:
    """Union of ``fn(rows of shard i)`` over all shards."""
    rows = df.withColumn("shard", shard_id(F.col(col), n))
    result = None
    for shard in range(n):
        part = fn(rows.where(F.col("shard") == shard))
        result = part if result is None else result.unionByName(part)
    return result
