"""The row-limited job and the read, process, write job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.operators.ordered import in_segments, running_totals

DEFAULT_ROWS = 1_000


def first_rows(df: DataFrame, key: Sequence[str], num_rows: int = DEFAULT_ROWS) -> DataFrame:
    """The first ``num_rows`` rows by ``key``, which tells all rows apart.

    The keys alone are numbered in segments, which finds the last key that is still in; the rows up to it are then a
    filter, which reaches the scan for a single key.  No task sees more than its share, however many rows are wanted.
    """
    order = [F.asc(k) for k in key]
    numbered = running_totals(in_segments(df.select(*key), order), order, {"_row": ("sum", F.lit(1))})
    last = numbered.filter(F.col("_row") == num_rows).select(*key).first()
    if last is None:  # there are not even so many
        return df
    if len(key) == 1:
        return df.filter(F.col(key[0]).isNull() | (F.col(key[0]) <= F.lit(last[0])))
    return df.filter(F.struct(*key) <= F.struct(*(F.lit(last[k]).alias(k) for k in key)))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` partitioned by ``by``.

    The rebalance hint gathers each value's rows into few files and splits values that hold much of the data.
    """
    df.hint("rebalance", by).write.mode("errorifexists").partitionBy(by).parquet(path)


def totals_by(df: DataFrame, group: Sequence[str], amount: Column) -> DataFrame:
    """``group, n, total, average``."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(amount), 2).alias("total"),
        F.round(F.avg(amount), 6).alias("average"),
    )
