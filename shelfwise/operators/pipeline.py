"""Fitted feature tables that are stored once and applied to new rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features

# The columns a review table is fitted on where it has them.
TEXTS = ("review_text", "summary", "title", "description")
LABELS = ("category", "subcategory", "brand")
NUMBERS = ("rating", "price", "votes")


@dataclass
class FeaturePipeline:
    """Label codes, number ranges and term weights below a folder.

    ``fit`` writes them; an object with the same path and columns reads them, so new rows
    get the features of the fit, in another session as well. Labels that the fit has not
    seen count as unknown, terms that it has not kept get no weight.
    """

    spark: SparkSession
    path: str
    texts: Sequence[str] = TEXTS
    labels: Sequence[str] = LABELS
    numbers: Sequence[str] = NUMBERS
    min_df: float = 0.01
    max_df: float = 0.85
    ngrams: tuple[int, int] = (1, 2)
    stop_words: Sequence[str] | None = None

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path.rstrip('/')}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path.rstrip('/')}/{name}")

    def _stop(self) -> list[str]:
        return features.english_stop_words() if self.stop_words is None else list(self.stop_words)

    def fit(self, df: DataFrame, key: str) -> FeaturePipeline:
        """Fit on the columns that the table has; ``key`` names a text."""
        for c in self.present(df, self.labels):
            self._write(features.label_codes(df, c), f"labels/{c}")
        numbers = self.present(df, self.numbers)
        if numbers:
            x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers}
            stats = [
                F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("spread"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(c) for c, v in x.items()
            ]
            self._write(df.agg(*stats), "numbers")
        for c in self.present(df, self.texts):
            total = df.agg(F.count("*")).scalar()
            texts = features.words_of(df, key, c, self._stop())
            self._write(features.frequent_words(texts, total, self.min_df), f"words/{c}")
            fitted = features.terms(texts, key, self.ngrams, self._read(f"words/{c}"))
            self._write(features.term_weights(fitted, total, self.min_df, self.max_df), f"terms/{c}")
        return self

    @staticmethod
    def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if c in df.columns]

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``<label>_encoded``, ``<number>_scaled`` and ``<number>_normalized``."""
        for c in self.present(df, self.labels):
            codes = self._read(f"labels/{c}")
            unknown = codes.where(F.col("label") == features.UNKNOWN).select("code").scalar()
            named = codes.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            df = (
                df.withColumn("_label", F.coalesce(F.col(c).cast("string"), F.lit(features.UNKNOWN)))
                .join(named, "_label", "left")
                .withColumn(f"{c}_encoded", F.coalesce("_code", unknown))
                .drop("_label", "_code")
            )
        numbers = self.present(df, self.numbers)
        if numbers:
            fitted = self._read("numbers")
            df = df.withColumn("_fit", fitted.select(F.struct(*fitted.columns)).scalar())
            for c in numbers:
                x, of = F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col("_fit")[c]
                width = of["hi"] - of["lo"]
                df = df.withColumns({
                    f"{c}_scaled": (x - of["mean"]) / F.when(of["spread"] == 0, 1.0).otherwise(of["spread"]),
                    f"{c}_normalized": (x - of["lo"]) / F.when(width == 0, 1.0).otherwise(width),
                })
            df = df.drop("_fit")
        return df

    def text_weights(self, df: DataFrame, key: str, col: str) -> DataFrame:
        """(key, term, weight): sparse unit vectors of new texts over the fitted vocabulary."""
        texts = features.words_of(df, key, col, self._stop())
        counts = features.terms(texts, key, self.ngrams, self._read(f"words/{col}"))
        return features.unit_weights(counts, self._read(f"terms/{col}"), key)
