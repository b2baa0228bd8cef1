"""Relations between users, items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from ..scale import dense_index, pairs_within, running_sum
from ..session import cut_lineage

RANK_BLOCK = 64


def user_item_ratings(reviews: DataFrame) -> DataFrame:
    return reviews.select("user_id", "product_id", "rating")


def item_popularity(events: DataFrame) -> DataFrame:
    """View events per product."""
    return events.where(F.col("event_type") == "view").groupBy("product_id").agg(F.count("*").alias("view_count"))


def user_activity(events: DataFrame) -> DataFrame:
    """Events and purchases per user."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "purchase").alias("purchase_count")
    )


def seen_products(events: DataFrame) -> DataFrame:
    """Distinct (user, product) pairs."""
    return events.select("user_id", "product_id").distinct()


def suffix_weight_sum(events: DataFrame) -> DataFrame:
    """Add ``suffix_weight``: session weight of this and all later events of the user.

    An event counts 2 with a session and 1 without one or with 'default'.
    """
    in_session = F.col("session_id").isNotNull() & (F.col("session_id") != "default")
    weight = F.when(in_session, F.lit(2)).otherwise(F.lit(1)).cast("long")
    return running_sum(events, ["user_id"], [-F.col("event_id")], weight, "suffix_weight")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of (a_product_id, b_product_id, score)."""
    ends = F.array(
        F.struct(F.col("a_product_id").alias("product_id"), F.col("b_product_id").alias("related_id")),
        F.struct(F.col("b_product_id").alias("product_id"), F.col("a_product_id").alias("related_id")),
    )
    return pairs.select(F.explode(ends).alias("e"), "score").select("e.product_id", "e.related_id", "score")


def cooccurrence_feedback(events: DataFrame) -> DataFrame:
    """(product_id, related_id, score), both directions.

    Every event adds its session weight to every pair of products its user has
    touched so far. A pair of one user therefore gains the weight of all events
    from the later of the two first touches on, which is the smaller of the two
    products' suffix weights. Pairs are summed map-side before they are shuffled.
    """
    touches = (
        suffix_weight_sum(events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull()))
        .groupBy("user_id", "product_id")
        .agg(F.max("suffix_weight").alias("suffix"))
    )
    touches = cut_lineage(touches, "touches")
    pairs = (
        pairs_within(touches, "user_id", "product_id", ["suffix"])
        .groupBy("a_product_id", "b_product_id")
        .agg(F.sum(F.least("a_suffix", "b_suffix")).cast("double").alias("score"))
    )
    return mirrored(pairs)


def cooccurrence_realtime(events: DataFrame) -> DataFrame:
    """(product_id, related_id, score), both directions: one per session event and other product touched before it.

    A pair gains 1 for every session event on either product that comes at or
    after the first touch of the other. Products are numbered per user by first
    touch; an event then counts toward all products numbered up to the highest
    number reached so far. Those step functions are cut into ranges of
    ``RANK_BLOCK`` numbers, so the join below is an equality on (user, block) and
    a hot user spreads over many tasks.
    """
    rows = events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    first = rows.groupBy("user_id", "product_id").agg(F.min("event_id").alias("seq"))
    marks = first.select("user_id", "product_id", "seq", F.lit(0).alias("kind"))
    hits = rows.where(F.col("session_id").isNotNull()).select(
        "user_id", "product_id", F.col("event_id").alias("seq"), F.lit(1).alias("kind")
    )
    is_mark = F.when(F.col("kind") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    numbered = running_sum(marks.unionByName(hits), ["user_id"], [F.col("seq"), F.col("kind")], is_mark, "number")
    numbered = cut_lineage(numbered, "numbered")
    touched = numbered.where(F.col("kind") == 0).select(
        "user_id", F.col("product_id").alias("other_id"), "number", F.floor(F.col("number") / RANK_BLOCK).alias("block")
    )
    steps = (
        numbered.where(F.col("kind") == 1).groupBy("user_id", "product_id", "number").agg(F.count("*").alias("n"))
    )
    # At most one row per product of the user in this window: steps are counted by number.
    falling = W.partitionBy("user_id", "product_id").orderBy(F.desc("number"))
    rising = W.partitionBy("user_id", "product_id").orderBy("number")
    spans = (
        steps.withColumn("gain", F.sum("n").over(falling.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("above", F.coalesce(F.lag("number").over(rising), F.lit(0)))
        .withColumn(
            "block",
            F.explode(
                F.sequence(F.floor((F.col("above") + 1) / RANK_BLOCK), F.floor(F.col("number") / RANK_BLOCK))
            ),
        )
        .select("user_id", "product_id", "block", "above", F.col("number").alias("upto"), "gain")
    )
    gains = spans.join(touched, ["user_id", "block"]).where(
        (F.col("number") > F.col("above"))
        & (F.col("number") <= F.col("upto"))
        & (F.col("other_id") != F.col("product_id"))
    )
    pairs = gains.groupBy(
        F.least("product_id", "other_id").alias("a_product_id"), F.greatest("product_id", "other_id").alias("b_product_id")
    ).agg(F.sum("gain").cast("double").alias("score"))
    return mirrored(pairs)


def related_candidates(seen: DataFrame, related: DataFrame) -> DataFrame:
    """(user_id, item_id, score): relation scores of a user's products, summed per related product."""
    return (
        seen.join(related, "product_id")
        .groupBy("user_id", F.col("related_id").alias("item_id"))
        .agg(F.sum("score").alias("score"))
    )


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates the user has not touched; ``seen`` holds (user_id, item_id)."""
    return candidates.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def hits(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recommended items among the first ``k`` that are relevant to the user."""
    return recs.where(F.col("rank") <= k).join(
        relevant.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi"
    )


def unseen_counts(users: DataFrame, catalogue: DataFrame, seen: DataFrame) -> DataFrame:
    """Number of catalogue items each user has not touched."""
    items = catalogue.select("item_id").distinct()
    total = items.agg(F.count("*")).scalar()
    known = (
        seen.select("user_id", "item_id")
        .distinct()
        .join(items, "item_id", "left_semi")
        .groupBy("user_id")
        .agg(F.count("*").alias("seen"))
    )
    return (
        users.select("user_id")
        .distinct()
        .join(known, "user_id", "left")
        .select("user_id", (total - F.coalesce("seen", F.lit(0))).alias("unseen"))
    )


def unseen_items(users: DataFrame, catalogue: DataFrame, seen: DataFrame) -> DataFrame:
    """(user_id, item_id) for every catalogue item the user has not touched.

    Lists each user's unseen positions and names them by ``nth_unseen``, so only
    rows of the result are made.
    """
    index = dense_index(catalogue, "item_id", "idx")
    known = seen.select("user_id", "item_id").distinct().join(index, "item_id").select("user_id", "idx")
    listed = (
        unseen_counts(users, catalogue, seen)
        .where(F.col("unseen") > 0)
        .select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("unseen") - 1)).alias("nth"))
        .select("user_id", F.col("nth").alias("draw_id"), "nth")
    )
    return nth_unseen(listed, known).join(index, "idx").select("user_id", "item_id")


def nth_unseen(draws: DataFrame, seen_index: DataFrame, written: bool = False) -> DataFrame:
    """Turn the 0-based position among a user's unseen items into a catalogue index.

    ``draws`` is (user_id, draw_id, nth), ``seen_index`` the distinct (user_id, idx)
    a user has touched. The j-th seen index (from 0) precedes position r exactly
    when idx - j <= r, so one running count over draws and seen indexes in that
    order answers every draw; the work is linear in both. ``written`` says that
    ``seen_index`` is read from a written table.
    """
    seen = (
        running_sum(seen_index, ["user_id"], [F.col("idx")], F.lit(1).cast("long"), "j", written=written)
        .select(
            "user_id",
            F.lit(None).cast("long").alias("draw_id"),
            (F.col("idx") - (F.col("j") - 1)).alias("nth"),
            F.lit(0).alias("kind"),
            F.col("idx").alias("tie"),
        )
    )
    wanted = draws.select("user_id", "draw_id", "nth", F.lit(1).alias("kind"), F.col("draw_id").alias("tie"))
    merged = running_sum(
        seen.unionByName(wanted),
        ["user_id"],
        [F.col("nth"), F.col("kind"), F.col("tie")],
        F.when(F.col("kind") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"),
        "before",
    )
    return merged.where(F.col("kind") == 1).select("user_id", "draw_id", (F.col("nth") + F.col("before")).alias("idx"))


def sample_negatives(positives: DataFrame, n: int = 4, per: str = "user", seed: int = 42) -> DataFrame:
    """Items the user has not touched, as (user_id, item_id) rows.

    per='user': ``n`` distinct ones per user, one from each of ``n`` equal strips
    of the unseen items; with repeats if fewer than ``n`` are left, and from the
    whole catalogue if none is.
    per='row': ``n`` per distinct positive pair, repeats allowed.
    """
    # Written once: the index and the pairs' places in it read it.
    pairs = cut_lineage(positives.select("user_id", "item_id").distinct(), "pairs")
    index = dense_index(pairs, "item_id", "idx")
    total = index.agg(F.count("*")).scalar()
    indexed = cut_lineage(pairs.join(index, "item_id"), "indexed")
    per_user = (
        indexed.groupBy("user_id")
        .agg(F.count("*").alias("s"))
        .withColumn("total", total)
        .withColumn("unseen", F.col("total") - F.col("s"))
    )
    if per == "user":
        slots = per_user.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
            "draw_id", F.col("k").cast("long")
        )
        u = hash_uniform(F.col("user_id"), F.col("k"), seed=seed)
        strip = F.when(
            F.col("unseen") >= n, (F.col("k") + u) * F.col("unseen") / n
        ).otherwise(u * F.col("unseen"))
    elif per == "row":
        slots = (
            indexed.join(per_user.drop("s"), "user_id")
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("draw_id", F.col("idx") * n + F.col("k"))
        )
        u = hash_uniform(F.col("user_id"), F.col("item_id"), F.col("k"), seed=seed)
        strip = u * F.col("unseen")
    else:
        raise ValueError("per must be 'user' or 'row'")
    slots = slots.withColumn("u", u).withColumn("nth", F.floor(strip).cast("long"))
    drawn = nth_unseen(
        slots.where(F.col("unseen") > 0).select("user_id", "draw_id", F.least("nth", F.col("unseen") - 1).alias("nth")),
        indexed.select("user_id", "idx"),
        written=True,
    )
    anything = slots.where(F.col("unseen") == 0).select(
        "user_id", "draw_id", F.floor(F.col("u") * F.col("total")).cast("long").alias("idx")
    )
    return drawn.unionByName(anything).join(index, "idx").select("user_id", "item_id", "draw_id")


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both tables, matched by column name."""
    return a.unionByName(b)


def with_negatives(positives: DataFrame, n: int = 4, per: str = "user", seed: int = 42) -> DataFrame:
    """(user_id, item_id, rating): the positives followed by sampled negatives rated 0."""
    negatives = sample_negatives(positives, n, per, seed)
    return append_rows(
        positives.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")),
        negatives.select("user_id", "item_id", F.lit(0.0).alias("rating")),
    )


def map_ids(df: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """Attach ``user_idx`` and ``item_idx``; rows with an unknown user or item fall out."""
    return df.join(user_map, "user_id").join(item_map, "item_id")


def entity_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join along a declared foreign key."""
    return left.join(right, key, how)


def score_pairs(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Dot product of the factors of each listed (user_id, item_id)."""
    from ..functions.scalars import dot

    u = user_factors.select("user_id", F.col("features").alias("_u"))
    i = item_factors.select("item_id", F.col("features").alias("_i"))
    return pairs.join(u, "user_id").join(i, "item_id").withColumn("score", dot(F.col("_u"), F.col("_i"))).drop("_u", "_i")
