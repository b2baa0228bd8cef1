"""Feature tables and fitted encoders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.ml.feature import StopWordsRemover

from ..scale import dense_index, top_n
from ..session import cut_lineage

UNKNOWN = "unknown"
# Words or terms that a task puts in order.
TASK_ROWS = 1 << 20


def _review_aggregates() -> list[Column]:
    # The median's state is one counter per distinct rating, merged map-side, so
    # it stays small however many reviews a product or user has.
    verified = F.count_if(F.coalesce("verified_purchase", F.lit(False)))
    return [
        F.avg("rating").alias("rating_mean"),
        F.median("rating").alias("rating_median"),
        F.stddev_samp("rating").alias("rating_std"),
        F.count("rating").alias("rating_count"),
        F.sum("votes").alias("votes_sum"),
        F.avg("votes").alias("votes_mean"),
        F.max("votes").alias("votes_max"),
        verified.alias("verified_purchase_count"),
        (verified / F.nullif(F.count("rating"), F.lit(0))).alias("verified_purchase_ratio"),
    ]


def product_features(reviews: DataFrame) -> DataFrame:
    """Rating, vote and verified-purchase statistics per product."""
    return reviews.groupBy("product_id").agg(*_review_aggregates())


def user_features(reviews: DataFrame) -> DataFrame:
    """The same per user, plus how far the user's mean lies from everyone's."""
    overall = reviews.agg(F.avg("rating")).scalar()
    return (
        reviews.groupBy("user_id")
        .agg(*_review_aggregates())
        .withColumn("rating_bias", F.col("rating_mean") - overall)
    )


def attach_verified_counts(reviews: DataFrame, key: str) -> DataFrame:
    """Reviews and verified reviews per key; a key without verified ones gets 0."""
    return reviews.groupBy(key).agg(
        F.count("*").alias("reviews"),
        F.count_if(F.coalesce("verified_purchase", F.lit(False))).alias("verified_purchase_count"),
    )


def label_codes(fit: DataFrame, col: str) -> DataFrame:
    """(label, code): the sorted distinct labels, 'unknown' among them."""
    labels = fit.select(F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN)).alias("label"))
    with_unknown = labels.unionByName(fit.sparkSession.createDataFrame([(UNKNOWN,)], "label STRING"))
    return dense_index(with_unknown, "label", "code")


def label_encode(fit: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_encoded``; labels not seen when fitting get the code of 'unknown'."""
    for col in cols:
        codes = label_codes(fit, col)
        unknown = codes.where(F.col("label") == UNKNOWN).select("code").scalar()
        key = F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN))
        df = (
            df.withColumn("_label", key)
            .join(codes.withColumnsRenamed({"label": "_label", "code": "_code"}), "_label", "left")
            .withColumn(f"{col}_encoded", F.coalesce("_code", unknown))
            .drop("_label", "_code")
        )
    return df


def standard_scale(fit: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_scaled``: distance from the fitted mean in population deviations; null counts as 0."""
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in cols}
    stats = fit.agg(
        F.struct(
            *[F.avg(x).alias(f"m_{c}") for c, x in filled.items()],
            *[F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items()],
        )
    ).scalar()
    out = df.withColumn("_fit", stats)
    for c, x in filled.items():
        spread = F.col(f"_fit.s_{c}")
        out = out.withColumn(
            f"{c}_scaled", (x - F.col(f"_fit.m_{c}")) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
        )
    return out.drop("_fit")


def minmax_scale(fit: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_normalized``: position between the fitted minimum and maximum; null counts as 0."""
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in cols}
    stats = fit.agg(
        F.struct(
            *[F.min(x).alias(f"lo_{c}") for c, x in filled.items()],
            *[F.max(x).alias(f"hi_{c}") for c, x in filled.items()],
        )
    ).scalar()
    out = df.withColumn("_fit", stats)
    for c, x in filled.items():
        width = F.col(f"_fit.hi_{c}") - F.col(f"_fit.lo_{c}")
        out = out.withColumn(
            f"{c}_normalized", (x - F.col(f"_fit.lo_{c}")) / F.when(width == 0, F.lit(1)).otherwise(width)
        )
    return out.drop("_fit")


def normalize_ratings(ratings: DataFrame, train: DataFrame | None = None, epsilon: float = 0.0) -> DataFrame:
    """Add ``normalized_rating`` on the training rows' scale; ``epsilon`` widens the divisor."""
    bounds = (ratings if train is None else train).agg(
        F.struct(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    ).scalar()
    width = F.col("_b.hi") - F.col("_b.lo") + F.lit(epsilon)
    return (
        ratings.withColumn("_b", bounds)
        .withColumn("normalized_rating", (F.col("rating") - F.col("_b.lo")) / F.nullif(width, F.lit(0)))
        .drop("_b")
    )


def words_of(df: DataFrame, key: str, col: str, stop_words: Sequence[str]) -> DataFrame:
    """(key, _row, w): the lower-cased words of two or more letters or digits without stop words, written.

    A table of less than a file split per shuffle partition is dealt by key first: it may
    be a single row group, which one task would read alone.
    """
    words = F.filter(
        F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1),
        lambda w: ~w.isin(*stop_words) if stop_words else F.lit(True),
    )
    texts = df.select(key, col)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < parts * split:
        texts = texts.repartition(parts, key)
    return cut_lineage(texts.select(key, F.monotonically_increasing_id().alias("_row"), words.alias("w")), "words")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Dealt by key to as many tasks as ``rows`` ask for, so a task's memory does not grow with the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // TASK_ROWS)), key)


def terms(texts: DataFrame, key: str, ngrams: tuple[int, int], frequent: DataFrame) -> DataFrame:
    """(key, term, tf): counts of the n-grams of successive words that are all ``frequent``.

    A term is in no more texts than each of its words, so others cannot reach the
    frequency either; most n-grams are never made.
    """
    words = texts.agg(F.sum(F.size("w"))).first()[0] or 0
    rows = dealt(texts.select(key, "_row", F.posexplode("w").alias("pos", "word")).join(frequent, "word", "left_semi"), key, words)
    order = W.partitionBy(key, "_row").orderBy("pos")
    ahead = {f"_w{k}": F.lead("word", k).over(order) for k in range(1, ngrams[1])}
    ahead |= {f"_p{k}": F.lead("pos", k).over(order) for k in range(1, ngrams[1])}
    grams = []
    for n in range(ngrams[0], ngrams[1] + 1):
        run = F.concat_ws(" ", "word", *[f"_w{k}" for k in range(1, n)])
        grams.append(run if n == 1 else F.when(F.col(f"_p{n - 1}") == F.col("pos") + n - 1, run))
    listed = rows.withColumns(ahead) if ahead else rows
    return listed.select(key, F.explode(F.array_compact(F.array(*grams))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf_features(
    fit: DataFrame,
    df: DataFrame,
    key: str,
    col: str,
    min_df: float = 0.01,
    max_df: float = 0.85,
    ngrams: tuple[int, int] = (1, 2),
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Sparse unit vectors as (key, term, weight) rows: tf times ln((1+n)/(1+df))+1, scaled to length one.

    Terms must occur in at least a ``min_df`` share of the texts. There are at most
    (distinct terms per text) / min_df of those, so the vocabulary is normally
    small enough to be sent to the counts, which then need no shuffle by term. Words
    are counted first, and only runs of words that reach the share become terms.
    """
    stop = english_stop_words() if stop_words is None else list(stop_words)
    total = fit.agg(F.count("*")).scalar()
    texts = words_of(df, key, col, stop)
    fit_texts = texts if fit is df else words_of(fit, key, col, stop)
    frequent = cut_lineage(frequent_words(fit_texts, total, min_df), "frequent")
    # Written once: the vocabulary, the weights and the norms all read the counts.
    counts = cut_lineage(terms(texts, key, ngrams, frequent), "terms")
    fitted = counts if fit is df else terms(fit_texts, key, ngrams, frequent)
    vocabulary = cut_lineage(term_weights(fitted, total, min_df, max_df), "vocabulary")
    return unit_weights(counts, vocabulary, key, counts.count())


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def frequent_words(texts: DataFrame, total: Column, min_df: float) -> DataFrame:
    """(word) that a ``min_df`` share of the texts hold. Rows that share a key count once each: never fewer than the texts with the word."""
    single = texts.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return single.where(F.col("df") >= min_df * total).select("word")


def term_weights(fitted: DataFrame, total: Column, min_df: float, max_df: float) -> DataFrame:
    """(term, idf) of the terms whose share of the texts lies between the bounds."""
    return (
        fitted.groupBy("term")
        .agg(F.count("*").alias("df"))
        .withColumn("n", total)
        .where((F.col("df") >= min_df * F.col("n")) & (F.col("df") <= max_df * F.col("n")))
        .select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    )


def unit_weights(counts: DataFrame, vocabulary: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """(key, term, weight): counts times the vocabulary's weights, scaled to length one per key.

    ``rows`` is the number of counts, if they do not lie by key yet.
    """
    weighted = counts.join(vocabulary, "term").select(
        key, "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    if rows is not None:
        weighted = dealt(weighted, key, rows)
    # One text's terms per window.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return weighted.withColumn("norm", norm).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


# ---------------------------------------------------------------- behaviour events


def product_event_features(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Views, purchases, ratings and popularity per product, added to earlier totals if given."""
    rated = F.col("event_type") == "rating"
    fresh = events.groupBy("product_id").agg(
        F.count_if(F.col("event_type") == "view").alias("view_count"),
        F.count_if(F.col("event_type") == "purchase").alias("purchase_count"),
        F.count_if(rated).alias("rating_count"),
        F.coalesce(F.sum(F.when(rated, F.coalesce("rating", F.lit(0.0)))), F.lit(0.0)).alias("rating_sum"),
    )
    if base is not None:
        old = base.select(
            "product_id",
            "view_count",
            "purchase_count",
            "rating_count",
            (F.col("avg_rating") * F.col("rating_count")).alias("rating_sum"),
        )
        fresh = fresh.unionByName(old).groupBy("product_id").agg(
            *[F.sum(c).alias(c) for c in ("view_count", "purchase_count", "rating_count", "rating_sum")]
        )
    average = F.when(F.col("rating_count") > 0, F.col("rating_sum") / F.col("rating_count")).otherwise(0.0)
    popularity = F.col("view_count") + 10 * F.col("purchase_count") + 5 * F.col("rating_sum")
    return fresh.select(
        "product_id", "view_count", "purchase_count", "rating_count", average.alias("avg_rating"), popularity.alias("popularity")
    )


def recent_products(events: DataFrame, event_type: str, n: int, out: str, base: DataFrame | None = None) -> DataFrame:
    """Per user the last ``n`` products of one kind, newest first, going on from the lists in ``base``.

    A product enters in front when it is not listed, and the last one falls off; a
    product that has fallen off may come back. What is listed depends on every
    earlier event, so a user's events are read in order as a stream: a task keeps one
    list, never a user's events.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("user_id", "product_id", "event_id")}
    none = F.array().cast(f"array<{kinds['product_id']}>")
    rows = events.where((F.col("event_type") == event_type) & F.col("product_id").isNotNull()).select(
        "user_id", F.lit(1).alias("_part"), "event_id", "product_id", none.alias("_list")
    )
    if base is not None:
        held = base.select(
            "user_id", F.lit(0).alias("_part"), F.lit(None).cast(kinds["event_id"]).alias("event_id"),
            F.lit(None).cast(kinds["product_id"]).alias("product_id"), F.coalesce(F.col(out), none).alias("_list"),
        )
        rows = rows.unionByName(held)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, listed, started = None, [], False
        types = None
        for batch in batches:
            types = types or (batch.schema.field("user_id").type, batch.schema.field("_list").type)
            done = []
            for u, part, product, items in zip(*(batch.column(c).to_pylist() for c in ("user_id", "_part", "product_id", "_list")), strict=True):
                if not started or u != user:
                    if started:
                        done.append((user, listed))
                    user, listed, started = u, [], True
                if part == 0:
                    listed = list(items)[:n]
                elif product not in listed:
                    listed = [product, *listed][:n]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["user_id", out])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([user], types[0]), pa.array([listed], types[1])], names=["user_id", out])

    in_order = rows.repartition("user_id").sortWithinPartitions("user_id", "_part", "event_id")
    return in_order.mapInArrow(follow, f"user_id {kinds['user_id']}, {out} array<{kinds['product_id']}>")


def user_event_features(events: DataFrame, base: DataFrame | None = None, views: int = 20, purchases: int = 50) -> DataFrame:
    """Counts, average rating, last activity and recent product lists per user, continuing earlier features if given."""
    rated = F.col("event_type") == "rating"
    counts = events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("view_count"),
        F.count_if(F.col("event_type") == "purchase").alias("purchase_count"),
        F.count_if(rated).alias("rating_count"),
        F.coalesce(F.sum(F.when(rated, F.coalesce("rating", F.lit(0.0)))), F.lit(0.0)).alias("rating_sum"),
        F.max("ts").alias("last_active"),
    )
    if base is not None:
        old = base.select(
            "user_id",
            "view_count",
            "purchase_count",
            "rating_count",
            (F.col("avg_rating") * F.col("rating_count")).alias("rating_sum"),
            "last_active",
        )
        counts = counts.unionByName(old).groupBy("user_id").agg(
            *[F.sum(c).alias(c) for c in ("view_count", "purchase_count", "rating_count", "rating_sum")],
            F.max("last_active").alias("last_active"),
        )
    result = counts.select(
        "user_id",
        "view_count",
        "purchase_count",
        "rating_count",
        F.when(F.col("rating_count") > 0, F.col("rating_sum") / F.col("rating_count")).otherwise(0.0).alias("avg_rating"),
        "last_active",
    )
    for kind, n, out in (("view", views, "recent_views"), ("purchase", purchases, "purchased_products")):
        result = result.join(recent_products(events, kind, n, out, base), "user_id", "left").withColumn(out, F.coalesce(out, F.array()))
    return result


def event_type_metrics(events: DataFrame) -> DataFrame:
    """Metric rows with the number of events of each kind."""
    return (
        events.groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type"))
        .agg(F.count("*").alias("n"))
        .select(
            F.concat(F.lit("feature_events_"), F.col("event_type")).alias("metric_name"),
            F.col("n").cast("double").alias("metric_value"),
        )
    )


def feedback_stats(events: DataFrame, n: int = 10) -> DataFrame:
    """(section, key, value) rows: totals, events by kind, most viewed products, users with most products."""
    totals = events.agg(
        F.count_distinct("user_id").alias("users_count"),
        F.count_distinct(F.when(F.col("event_type") == "view", F.col("product_id"))).alias("products_count"),
        F.count("*").alias("total_events"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("total").alias("section"), F.lit(c).alias("key"), F.col(c).alias("value"))
                    for c in ("users_count", "products_count", "total_events")
                ]
            )
        )
    )

    def section(name, df, key, value):
        return df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).alias("value"))

    kinds = events.groupBy("event_type").agg(F.count("*").alias("value"))
    views = events.where(F.col("event_type") == "view").groupBy("product_id").agg(F.count("*").alias("value"))
    pairs = events.select("user_id", "product_id").distinct().groupBy("user_id").agg(F.count("*").alias("value"))
    return (
        totals.unionByName(section("event_type", kinds, "event_type", "value"))
        .unionByName(section("top_product", views.orderBy(F.desc("value"), "product_id").limit(n), "product_id", "value"))
        .unionByName(section("top_user", pairs.orderBy(F.desc("value"), "user_id").limit(n), "user_id", "value"))
    )


def metrics_rows(df: DataFrame, tags: dict[str, str], timestamp: str | None = None) -> DataFrame:
    """One metric row per numeric column of each row."""
    names = df.columns
    entries = F.array(
        *[F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("metric_value")) for c in names]
    )
    tag_map = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]) if tags else F.lit(None).cast("map<string,string>")
    moment = F.current_timestamp() if timestamp is None else F.lit(timestamp).cast("timestamp")
    return df.select(F.inline(entries)).select(
        "metric_name",
        "metric_value",
        tag_map.alias("tags"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        moment.alias("timestamp"),
    )
