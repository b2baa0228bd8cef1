"""Column helpers, stored tables and connected components shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import shared_path

# The white space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_spaces(text: Column) -> Column:
    """The text with every white-space character of the word rule as a space."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none if it is null."""
    return F.array_remove(F.split(only_spaces(F.coalesce(text, F.lit(""))), " "), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read back; lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads: everything made from them is stored itself by now."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go.

    Spark deletes them when the driver's garbage is collected, which a driver with
    little to do puts off; so it is asked to.
    """
    spark._jvm.java.lang.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(id, root) for every end of an edge: ids have the same root if and only if edges connect them.

    Every round hooks each vertex to its smallest neighbour and contracts the
    graph. Ids must have no order of their own (hashes), so that a chain shrinks
    by a constant factor per round. Only the vertices still in the game are
    joined; minima are combined before the shuffle, so a hub costs one row per
    task.
    """
    lo, hi = F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")
    live = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").select(lo, hi).distinct(), name)
    labels = None
    while True:
        both = live.select(F.col("lo").alias("id"), F.col("hi").alias("to")).union(
            live.select(F.col("hi").alias("id"), F.col("lo").alias("to"))
        )
        hook = stored(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("root")), name)
        before = live
        if labels is not None and hook.isEmpty():
            discard(hook, live)
            return labels
        live = stored(
            live.join(hook.select(F.col("id").alias("lo"), F.col("root").alias("x")), "lo")
            .join(hook.select(F.col("id").alias("hi"), F.col("root").alias("y")), "hi")
            .where("x <> y")
            .select(lo, hi)
            .distinct(),
            name,
        )
        discard(before)
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("id").alias("root"), F.col("root").alias("next"))
            older = labels
            labels = stored(
                labels.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")), name
            )
            discard(older, hook)
        if live.isEmpty():
            discard(live)
            return labels


def sainte_lague(parties: DataFrame, keys: Sequence[str], by: Sequence[Column], value: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the party's share of ``seats`` by the highest quotients value / (2k + 1) within ``keys``.

    ``seats`` is the same for all parties of a key. Only quotients that may be on
    either side of the last seat are listed: with S parties that is about 4 S
    rows, however many seats there are. Ties go to the first party in ``by``.
    """
    from pyspark.sql import Window as W

    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    v, n = F.col(value).cast("double"), F.col(seats).cast("double")
    per = F.when(F.col("_total") > 0, v / F.col("_total")).otherwise(F.lit(0.0))
    bounds = (
        parties.withColumn("_total", F.sum(v).over(group))
        .withColumn("_half", F.count(F.lit(1)).over(group) / 2.0)
        .withColumn("_lo", F.greatest(F.lit(0).cast("long"), F.floor(per * (n - F.col("_half")) + 0.5) - 1))
        .withColumn("_hi", F.greatest(F.col("_lo"), F.floor(per * (n + F.col("_half")) + 0.5) + 1))
        .withColumn("_left", F.col(seats) - F.sum("_lo").over(group))
        .withColumn("_party", F.row_number().over(group.orderBy(*by)))
    )
    open_seats = bounds.select(*parties.columns, "_lo", "_left", "_party", F.explode(F.sequence("_lo", "_hi")).alias("_k"))
    ranked = open_seats.withColumn(
        "_rank", F.row_number().over(group.orderBy((v / (2.0 * F.col("_k") + 1.0)).desc(), "_party", "_k"))
    )
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & (v > 0), 1).otherwise(0))
    return ranked.groupBy(*parties.columns, "_lo", "_party").agg(won.alias("_won")).select(
        *parties.columns, (F.col("_lo") + F.col("_won")).cast("long").alias(out)
    )
