"""Host-level quality rules.

Each document is measured on its own; rule failures are added up per host, the
hosts' failure rates are shrunk with a beta prior fitted to all hosts, and the
host's verdict goes back to its documents.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows are judged one by one and count each; an empty
table gives an empty result; other columns are passed over. With fewer than two
hosts, or hosts that differ no more than chance, the prior is as strong as
``MAX_PRIOR`` documents around the common rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, let, only_spaces, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_HOST_RATE = 0.5
MAX_PRIOR = 1e6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(word_list: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more, the first one included.

    Windows are compared by 64-bit hashes within one text. Texts without a
    repeated window stop after the distinct count; the others sort the windows, so
    long texts cost n log n.
    """

    def from_hashes(h: Column) -> Column:
        n = F.greatest(F.size(h) - 2, F.lit(0))
        two = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
        return let(F.zip_with(two, F.slice(h, 3, n), lambda ab, c: F.xxhash64(ab, c)), from_windows)

    def from_windows(windows: Column) -> Column:
        in_order = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, let(in_order, from_sorted)).otherwise(F.lit(0))

    def from_sorted(s: Column) -> Column:
        def start(e: Column, i: Column) -> Column:
            here = e.getField("h")
            return F.when(
                (here == F.get(s, i - 1).getField("h")) | (here == F.get(s, i + 1).getField("h")), e.getField("i")
            )

        return let(F.sort_array(F.filter(F.transform(s, start), lambda x: x.isNotNull())), covered)

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), from_hashes)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" " + BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measures(text: Column) -> Column:
    """Struct of the counts of a text."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeats")))
    plain = F.length(text)
    return let(
        of_words,
        lambda w: F.struct(
            w.getField("n").cast("long").alias("n_words"),
            F.length(without(only_spaces(text), " ")).cast("long").alias("word_chars"),
            (plain - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            repeated_lines(text).cast("long").alias("n_dup_lines"),
            w.getField("repeats").cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed(m: Column) -> Column:
    n = m.getField("n_words")
    return (n < MIN_WORDS) | (100 * m.getField("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def any_failed(m: Column) -> Column:
    """One of the rules fails: the base rules or too many symbols."""
    return base_failed(m) | (100 * m.getField("n_symbols") > MAX_SYMBOL_PERCENT * m.getField("word_chars"))


def host_verdicts(failures: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected) of rows (host, failed).

    The prior's mean is the common failure rate m; its weight comes from the
    variance between hosts beyond m (1 - m) / n, by the method of moments.
    """
    hosts = stored(
        failures.groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
        ),
        "hosts",
    )
    n, own = F.col("n_docs"), F.col("n_failed") / F.col("n_docs")
    sums = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("hosts"), F.sum(n * own * own).alias("sq")
    )
    mean = F.col("f") / F.col("n")
    chance = mean * (1 - mean)
    between = F.col("sq") / F.col("n") - mean * mean - chance * (F.col("hosts") - 1) / F.col("n")
    weight = F.when(between > chance / MAX_PRIOR, chance / between).otherwise(F.lit(MAX_PRIOR))
    prior = sums.select(F.struct(mean.alias("mean"), weight.alias("weight"))).scalar()
    rate = (F.col("n_failed") + prior["mean"] * prior["weight"]) / (n + prior["weight"])
    return stored(hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > MAX_HOST_RATE), "verdicts")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rate, kept: one row per document."""
    m = measures(F.col("text"))
    measured = stored(docs.select("doc_id", F.col("source").alias("host"), m.alias("m")), "measures")
    verdicts = host_verdicts(measured.select("host", any_failed(F.col("m")).alias("failed")))
    verdicts = verdicts.select(F.col("host").alias("of_host"), F.col("rate").alias("host_rate"), "rejected")
    failed = base_failed(F.col("m"))
    return measured.join(verdicts, F.col("host").eqNullSafe(F.col("of_host"))).select(
        "doc_id", "host", *[F.col("m")[c].alias(c) for c in COUNTS],
        failed.alias("base_failed"), "host_rate", (~failed & ~F.col("rejected")).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass their own base rules and come from a host that is not rejected; all columns.

    Texts are measured once, and written with their two flags; they are never
    shuffled. The table of verdicts is small or large as the number of hosts.
    """
    failed, host = fresh(docs, "_failed"), fresh(docs, "_host")
    flags = let(measures(F.col("text")), lambda m: F.struct(base_failed(m).alias("base"), any_failed(m).alias("any")))
    held = stored(docs.withColumn(failed, flags), "measured")
    failures = held.select(F.col("source").alias("host"), F.col(failed)["any"].alias("failed"))
    rejected = host_verdicts(failures).where("rejected").select(F.col("host").alias(host))
    good = held.where(~F.col(failed)["base"]).drop(failed)
    return good.join(rejected, good["source"].eqNullSafe(F.col(host)), "left_anti")
