"""URL filter: rules on host and path first, gradient-boosted trees on lexical features for the rest.

A rule fits its host and all subdomains if the url's path starts with the rule's path;
the longest fitting rule wins. Urls that a rule judges, or a table of labelled urls,
train the trees; these judge every other url by its lengths, depths, share of digits,
entropy, counts of parameters, and the share of blocked urls among the labelled ones
with the same host or the same last labels of the host (shrunk towards the share of
all, and without the labels of the url's own fold when it trains).

Everything runs on DataFrame functions and Spark ML. The trees are fitted on about
``SAMPLE`` labelled urls of each verdict, dealt by hash; the shares come from all.

Defined results: host and path of a null url, or one without ``://``, are empty and no
rule fits; a path that is empty starts with no rule's path but an empty one; two
fitting rules of one length give the one with the longer host, then ``block``; null
rules, hosts, paths or labels are passed over; equal urls have equal verdicts, and
train as one url (``block`` if its labels differ); without any label the method allows,
with labels of one verdict it gives that verdict; an empty table gives an empty result;
other columns are kept, except those that the result adds.

The rules of one host stand together in one row of the rule table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, stored

SAMPLE = 20_000
TREES = 20
DEPTH = 4
SHRINK = 10.0
FOLDS = 5
SEED = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIXES = {"host_share": "host", "domain_share": "substring_index(host, '.', -2)", "top_share": "substring_index(host, '.', -1)"}
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "hyphens",
    "entropy", "host_entropy", "parameters", "fragment", "secure", *SUFFIXES, "host_labels",
)


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows of a short list of rules."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS rules(verdict, host, path)")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Different urls (url, host, path) with ``rule`` and its ``ruled`` verdict, both null where no rule fits."""
    usable = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").select("verdict", "host", "path")
    # Only suffixes with as many labels as some rule's host can meet a rule.
    labels = usable.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    by_host = usable.groupBy(F.col("host").alias("suffix")).agg(
        F.collect_set(F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("own"), F.col("verdict").alias("ruled"), F.col("path").alias("start"))).alias("rules")
    )
    depth = F.least(F.lit(labels), F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)
    each = urls.withColumn("i", F.explode(F.sequence(F.lit(1), depth))).withColumn("suffix", F.expr("substring_index(host, '.', -i)"))
    met = each.join(by_host, "suffix", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])))
    winner = F.max(F.when(best.isNotNull(), F.struct(best.alias("best"), F.col("suffix")))).alias("winner")
    return met.groupBy("url", "host", "path").agg(winner).select(
        "url", "host", "path", F.concat("winner.suffix", "winner.best.start").alias("rule"), F.col("winner.best.ruled").alias("ruled")
    )


def entropy(text: Column) -> Column:
    """Bits per character of a text's own distribution of characters."""
    n = F.length(text)
    each = lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double")
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s + let(each(c), lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0)))
    return F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0)


def lexical_features(urls: DataFrame) -> DataFrame:
    """Urls (url, host, path, ...) with every feature that the url alone gives."""
    text = F.coalesce("url", F.lit(""))
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(F.length(c), F.lit(1))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    return urls.select(
        "*",
        F.length(text).cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.length(query).cast("double").alias("query_length"), (count(F.col("host"), ".") + 1).alias("host_depth"), count(F.col("path"), "/").alias("path_depth"),
        digits(text).alias("digit_ratio"), digits(F.col("host")).alias("host_digit_ratio"), count(F.col("host"), "-").alias("hyphens"),
        entropy(text).alias("entropy"), entropy(F.col("host")).alias("host_entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1).alias("parameters"),
        F.contains(text, F.lit("#")).cast("double").alias("fragment"), F.startswith(text, F.lit("https:")).cast("double").alias("secure"),
    )


def with_shares(urls: DataFrame, labelled: DataFrame, share: float, trains: bool) -> DataFrame:
    """Add the shrunk shares of blocked urls per suffix; a url that trains takes them from the other folds only.

    Leaving out just the url's own label would let a tree read the label off the difference.
    """
    fold = F.pmod(F.xxhash64("url", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")
    per_fold = lambda value: F.array(*[F.sum(F.when(F.col("fold") == f, value).otherwise(0.0)) for f in range(FOLDS)])
    whole = lambda c: F.coalesce(F.aggregate(c, F.lit(0.0), lambda s, x: s + x) - (F.get(c, F.col("fold")) if trains else 0.0), F.lit(0.0))
    for name, suffix in SUFFIXES.items():
        stats = labelled.withColumn("fold", fold).groupBy(F.expr(suffix).alias("suffix")).agg(
            per_fold(F.col("label")).alias("blocked"), per_fold(F.lit(1.0)).alias("known")
        )
        met = urls.withColumn("suffix", F.expr(suffix)).withColumn("fold", fold).join(stats, "suffix", "left")
        value = (whole(F.col("blocked")) + SHRINK * share) / (whole(F.col("known")) + SHRINK)
        extra = [whole(F.col("known")).alias("host_labels")] if name == "host_share" else []
        urls = met.select(*urls.columns, value.alias(name), *extra)
    return urls


def balanced(labelled: DataFrame, counts: dict[float, int], most: int) -> DataFrame:
    """About ``most`` urls of each verdict, chosen by hash; all, if there are fewer."""
    parts = 1 << 30
    limit = F.when(F.col("label") == 1.0, F.lit(int(parts * min(1.0, most / counts[1.0])))).otherwise(F.lit(int(parts * min(1.0, most / counts[0.0]))))
    return labelled.where(F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(parts)) < limit)


class UrlModel:
    """Trees with the labelled urls that their suffix shares come from."""

    def __init__(self, labelled: DataFrame, most: int = SAMPLE, trees: int = TREES, depth: int = DEPTH):
        """Fit on (url, host, path, label): label 1.0 is block."""
        self.labelled = labelled
        self.counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
        self.trees = None
        if len(self.counts) == 2:
            self.share = self.counts[1.0] / sum(self.counts.values())
            train = with_shares(lexical_features(balanced(labelled, self.counts, most)), labelled, self.share, trains=True)
            # A fixed order makes reruns alike.
            train = stored(train.repartition(8, "url").sortWithinPartitions("url"), "url_features")
            gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=SEED)
            self.trees = gbt.fit(self.vectors(train))

    @staticmethod
    def vectors(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def blocked(self, urls: DataFrame) -> DataFrame:
        """(url, host, path, ...) with ``p_block``."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(1.0 if set(self.counts) == {1.0} else 0.0))
        rows = self.vectors(with_shares(lexical_features(urls), self.labelled, self.share, trains=False))
        return self.trees.transform(rows).select(*urls.columns, vector_to_array("probability")[1].alias("p_block"))


def parted(pages: DataFrame) -> DataFrame:
    """The different urls of a table with host and path."""
    return pages.select("url").distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None, most: int = SAMPLE) -> DataFrame:
    """Pages with host, path, rule, verdict and p_block (null where a rule judges).

    ``labels`` (url, verdict) trains the trees; without it, the urls that rules judge do.
    """
    ruled = stored(with_rules(parted(pages), rules), "ruled_urls")
    if labels is None:
        known = ruled.where("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double")).drop("rule", "ruled")
    else:
        verdicts = labels.where("url IS NOT NULL AND verdict IN ('allow', 'block')").groupBy("url").agg(F.max((F.col("verdict") == "block").cast("double")).alias("label"))
        known = stored(verdicts.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label"), "known_urls")
    model = UrlModel(known, most)
    by_rule = ruled.where("ruled IS NOT NULL").select("url", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    open_urls = model.blocked(ruled.where("ruled IS NULL").select("url", "host", "path"))
    by_model = open_urls.select("url", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("p_block") > 0.5, "block").otherwise("allow").alias("verdict"), "p_block")
    key = fresh(pages, "judged_url")
    judged = by_rule.unionByName(by_model).withColumnRenamed("url", key)
    kept = pages.select(*[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "p_block")])
    return kept.join(judged, kept["url"].eqNullSafe(judged[key]), "left").drop(key)
