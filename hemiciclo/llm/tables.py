"""Reading of the tables the llm queries share, and the rows that count."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.session import checkpointed, table

__all__ = ["below_cutoff", "buffered", "checkpointed", "one_per_key", "sliced", "table", "whole"]


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each non-null key: rows that came twice count once.

    The copies have the same content; should they differ, the smallest row stands.
    """
    row = F.struct(*columns)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in columns))


def buffered(batches: Iterable[pa.RecordBatch], rows: int, text_bytes: int = 1 << 62) -> Iterator[pa.Table]:
    """The batches of a task in tables of about so many rows or bytes, whichever comes first."""
    kept: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        # a batch of a few huge texts is cut, so that the limit in bytes holds
        step = max(1, min(batch.num_rows, int(batch.num_rows * text_bytes / max(1, batch.nbytes)))) if batch.num_rows else 1
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            kept.append(part)
            n += part.num_rows
            size += part.nbytes
            if n >= rows or size >= text_bytes:
                yield pa.Table.from_batches(kept)
                kept, n, size = [], 0, 0
    if kept:
        yield pa.Table.from_batches(kept)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, for work that makes many rows of each."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def below_cutoff(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """About n rows of df (up to 1.2 n), the same ones at every run: those whose hash of `by` lies below a cutoff made from the count. All rows, if they aren't more."""
    total = df.count()
    if total <= n:
        return df
    cutoff = int((1 << 40) * min(1.0, (1.1 * n) / total))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < cutoff)


def whole(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, name).select(*columns)
