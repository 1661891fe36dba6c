"""Result documents and where they go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What names a result's window.
KEYS = ("window_start", "window_end")


def result_documents(results: DataFrame, query: str, return_type: str = "") -> DataFrame:
    """One document a window: results (array of its rows), window_start, window_end, query, return_type.

    A document is what a window's consumer reads at once; use result_rows for results without a bound.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in results.columns if c not in KEYS])
    grouped = results.groupBy(*KEYS).agg(F.sort_array(F.collect_list(row)).alias("results"))
    return grouped.select("results", *KEYS, F.lit(query).alias("query"), F.lit(return_type).alias("return_type"))


def result_rows(results: DataFrame, query: str, return_type: str = "", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The keys, query, return_type, result (JSON): one row a result."""
    row = F.struct(*[F.col(f"`{c}`") for c in results.columns if c not in keys])
    return results.select(*keys, F.lit(query).alias("query"), F.lit(return_type).alias("return_type"), F.to_json(row).alias("result"))


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select(F.to_json(F.struct("*")).alias("value"))


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch's rows under their own partition, so that a batch that runs again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
