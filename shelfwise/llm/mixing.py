"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt out in blocks of equal size. The sources get whole numbers of
blocks by the highest quotients of their targets, the shards of a source by the
highest quotients of their sizes; a shard then fills its quota with whole passes
over its documents and the leading blocks of a seeded order.

Defined results: a null text has size 0 and gives 0 words; a null source is a
source of its own and comes last; repeated rows count each; an empty table, or
one without words, takes nothing; other columns are passed over. A null doc_id
takes part under the name "null". A source's taken words differ from its target
by less than about one block a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import fresh, sainte_lague, stored, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 16
SEED = "mix"


def order_key(doc_id: Column) -> Column:
    """The seeded place of a document."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def shard_of(key: Column, shards: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), shards)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, total, weight, target): one row per source.

    Targets share the sum of all sizes by weight; a source stops at ``repeats``
    times its size and the rest is shared anew. In the order of limit per weight
    the stopped sources come first, so running sums find the final share at once.
    """
    everything = W.partitionBy(F.lit(0))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("_n", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("_cap", repeats * F.col("source_size"))
    )
    before = everything.orderBy(F.col("_cap") / F.col("weight"), "_n").rowsBetween(W.unboundedPreceding, -1)
    every_weight = F.sum("weight").over(everything)
    cap_before = F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight_before = F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = (F.col("total") - cap_before) / (every_weight - weight_before)
    stopped = sources.withColumn("_stopped", F.col("_cap") < share * F.col("weight"))
    of_stopped = lambda c: F.coalesce(F.sum(F.when(F.col("_stopped"), F.col(c))).over(everything), F.lit(0))
    rest = (F.col("total") - of_stopped("_cap")) / (F.sum("weight").over(everything) - of_stopped("weight"))
    target = F.when(F.col("_stopped"), F.col("_cap").cast("double")).otherwise(rest * F.col("weight"))
    return stopped.select("source", "source_size", "n_docs", "total", "weight", target.alias("target"))


def shard_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """The sources with targets and shard counts, and per (source, shard) the words to take."""
    targets = source_targets(sizes, weights, repeats).withColumn("blocks", F.floor(F.col("total") / BLOCK_WORDS))
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_docs") / SHARD_DOCS), F.lit(1))
    sources = stored(
        sainte_lague(targets, [], [F.col("source").asc_nulls_last()], "target", "blocks", "quota").withColumn("shards", shards.cast("long")),
        "sources",
    )
    key = order_key(F.col("doc_id"))
    of = sources.select(F.col("source").alias("_source"), "shards", "quota")
    parts = (
        sizes.join(of, sizes["source"].eqNullSafe(F.col("_source")))
        .select("source", "quota", shard_of(key, F.col("shards")).alias("shard"), "size")
        .groupBy("source", "quota", "shard")
        .agg(F.sum("size").alias("shard_size"))
    )
    # The quota of a source is a column of its shards; null sources group as one.
    quotas = sainte_lague(parts, ["source"], [F.col("shard")], "shard_size", "quota", "shard_quota")
    take = F.least(F.col("shard_quota") * BLOCK_WORDS, repeats * F.col("shard_size"))
    return sources, stored(quotas.select("source", "shard", "shard_size", take.alias("take")), "shards")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard: one row per document.

    A window orders one shard, which is bounded in words and in documents.
    """
    sizes = stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    sources, shards = shard_plan(sizes, weights, repeats)
    of = sources.select(F.col("source").alias("_source"), "source_size", "target", "shards")
    placed = (
        sizes.join(of, sizes["source"].eqNullSafe(F.col("_source")))
        .withColumn("key", order_key(F.col("doc_id")))
        .withColumn("shard", shard_of(F.col("key"), F.col("shards")))
        .drop("_source")
    )
    before = W.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    quota = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "take")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("take") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("take") - F.col("passes") * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return (
        placed.join(quota, placed["source"].eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
        .withColumn("passes", passes)
        .select(
            "doc_id", "source", "size", "source_size", "target", "key", "shard", "shards", "passes",
            part.cast("long").alias("part"),
            (F.col("passes") * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents as often as the mix takes them, with all columns.

    Every shard has one document at most that a pass ends in; its last copy holds
    the leading words only, joined by spaces. No texts are joined to rows: each
    shard hands its documents the place where its last pass ends.
    """
    key, shard, of, source, shards, passes, end, n_words, copy = (
        fresh(docs, c) for c in ("_key", "_shard", "_of", "_source", "_shards", "_passes", "_end", "_words", "_copy")
    )
    mixed = stored(mix(docs, weights, repeats), "mixed")
    at_end = F.when(F.col("part") > 0, F.struct("key", "doc_id", "size", "part"))
    ends = stored(
        mixed.groupBy("source", "shard").agg(F.max("passes").alias(passes), F.max("shards").alias(shards), F.max(at_end).alias(end)),
        "ends",
    )
    counts = ends.groupBy("source").agg(F.max(shards).alias(shards)).withColumnRenamed("source", source)
    ends = ends.select(F.col("source").alias(source), F.col("shard").alias(of), passes, end)
    dealt = (
        docs.join(counts, docs["source"].eqNullSafe(F.col(source)))
        .drop(source)
        .withColumn(key, order_key(F.col("doc_id")))
        .withColumn(shard, shard_of(F.col(key), F.col(shards)))
    )
    placed = dealt.join(ends, dealt["source"].eqNullSafe(F.col(source)) & (F.col(shard) == F.col(of))).withColumn(
        n_words, F.size(words(F.col("text"))).cast("long")
    )
    place = F.struct(F.col(key).alias("key"), F.col("doc_id").alias("doc_id"), F.col(n_words).alias("size"))
    last = F.struct(*[F.col(end)[c].alias(c) for c in ("key", "doc_id", "size")])
    part = F.when(F.col(end).isNull() | (place > last), F.lit(0)).when(place < last, F.col(n_words)).otherwise(F.col(end)["part"])
    copies = F.col(passes) + F.when(part > 0, 1).otherwise(0)
    is_part = (F.col(copy) > F.col(passes)) & (part < F.col(n_words))
    cut = F.array_join(F.slice(words(F.col("text")), 1, part.cast("int")), " ")
    return (
        placed.where(copies > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))))
        .withColumn("text", F.when(is_part, cut).otherwise(F.col("text")))
        .select(*docs.columns)
    )
