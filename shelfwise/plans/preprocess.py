"""The whole way from raw review files to the tables that models are trained and tested on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import cleaning
from ..session import cut_lineage


def preprocess(
    raw: DataFrame, out: str, sample_size: int | None = None, min_user: int = 5, min_product: int = 5, test: float = 0.2, validation: float = 0.25,
    seed: int = 42, small: int = 1000, now: str | None = None, columns: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Clean, filter, sample and split raw reviews; writes ``train``, ``validation``, ``test`` and ``sample`` below ``out``.

    The filters see all rows; ``sample_size`` then takes that many of the rest, and
    ``small`` rows are kept beside the parts for trying things out. Sampling and
    splitting go by a hash of the row, so a run that is repeated gives the same tables.
    """
    clean = cleaning.clean_reviews(raw, now)
    wanted = clean if columns is None else clean.select(*columns)
    # The hash of a row follows the order of its columns.
    kept = cleaning.filter_min_activity(wanted, min_user, min_product).select(*wanted.columns)
    rows = kept if sample_size is None else cleaning.sample_rows(kept, sample_size, seed)
    # Read by four writers.
    parts = cleaning.split_train_val_test(cut_lineage(rows, "preprocessed"), test, validation, seed, small)
    spark, base = raw.sparkSession, out.rstrip("/")
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{base}/{name}")
    return {name: spark.read.schema(part.schema).parquet(f"{base}/{name}") for name, part in parts.items()}
