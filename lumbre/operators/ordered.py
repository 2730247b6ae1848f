"""Running totals over an order, without putting an unbounded group into one task.

A window that runs over a whole key (or over the whole table) is one task per key, however large the key is.
Here rows are range-partitioned by key *and* order, so a large key spans many partitions ("segments").  Totals
then run within each segment, and each segment starts from the totals of the segments before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.storage import cut_lineage

SEGMENT = "_segment"
AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_segments(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), segments: int | None = None) -> DataFrame:
    """``df`` cut into about equal ranges of ``keys`` and ``order``, numbered in ``_segment``.

    The result is written to the shared folder: range bounds come from a sample, and everything computed from the
    segments has to see the same ones, also after an executor is lost.
    """
    count = segments or shuffle_partitions(df)
    placed = df.repartitionByRange(count, *(F.col(k) for k in keys), *order)
    return cut_lineage(placed.withColumn(SEGMENT, F.spark_partition_id()))


def running_totals(
    placed: DataFrame,
    order: Sequence[Column],
    totals: Mapping[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    whole: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds one column per entry of ``totals`` (name -> ("sum" | "max" | "min", column)), running in ``order``.

    ``whole`` adds sums over all rows of the key (name -> column).  ``placed`` comes from ``in_segments`` with the
    same keys and order; the order must be total within a key.
    """
    whole = whole or {}
    per_segment = placed.groupBy(SEGMENT, *keys).agg(
        *(AGGREGATES[kind](value).alias(name) for name, (kind, value) in totals.items()),
        *(F.sum(value).alias(name) for name, value in whole.items()),
    )
    of_key = W.partitionBy(*keys)
    earlier = of_key.orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    # Only keys that lie in several segments matter here.  A segment shares at most its first and its last key with
    # others, so this is at most two rows per segment.
    carried = (
        per_segment.select(
            F.col(SEGMENT).alias("_at"),
            *(F.col(k).alias(f"_key_{k}") for k in keys),
            F.count(F.lit(1)).over(of_key).alias("_parts"),
            *(AGGREGATES[kind](name).over(earlier).alias(f"_carried_{name}") for name, (kind, _) in totals.items()),
            *(F.sum(name).over(of_key).alias(f"_carried_{name}") for name in whole),
        )
        .filter("_parts > 1")
        .drop("_parts")
    )
    same = F.col(SEGMENT) == F.col("_at")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    in_segment = W.partitionBy(SEGMENT, *keys)
    within = in_segment.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)

    def running(name: str, kind: str, value: Column) -> Column:
        own, before = AGGREGATES[kind](value).over(within), F.col(f"_carried_{name}")
        if kind == "sum":
            return F.coalesce(own + before, own, before)  # null only where no value has been seen yet
        return (F.greatest if kind == "max" else F.least)(own, before)

    columns = [c for c in placed.columns if c != SEGMENT]
    return placed.join(F.broadcast(carried), same, "left").select(
        *columns,
        *(running(name, kind, value).alias(name) for name, (kind, value) in totals.items()),
        *(
            F.coalesce(F.col(f"_carried_{name}"), F.sum(value).over(in_segment)).alias(name)
            for name, value in whole.items()
        ),
    )


def percentiles(df: DataFrame, value: str, shares: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """``keys..., names of shares...``: exact percentiles per key, of the values that are not null.

    The percentile is the smallest value with at least that share of the values at or below it.  Equal values are
    counted before anything is ordered, and a key with very many values is ordered in segments.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.asc(value)]
    placed = in_segments(counted, order, keys)
    ranked = running_totals(placed, order, {"_upto": ("sum", F.col("_n"))}, keys, {"_all": F.col("_n")})

    def at(share: float) -> Column:
        rank = F.ceil(F.lit(share) * F.col("_all"))
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col(value)))

    return ranked.groupBy(*keys).agg(*(at(share).alias(name) for name, share in shares.items()))
