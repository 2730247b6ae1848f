"""Gapless ranks within keys, also where one key holds most of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.operators.ordered import shuffle_partitions
from lumbre.storage import cut_lineage


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str, name: str = "ranks") -> DataFrame:
    """``df`` with ``into``: the place of each row within its keys, from 0 and without gaps, as a long.

    Rows are range-partitioned by keys and order, so a large key lies in many partitions.  Each partition numbers its
    rows as it writes them; how many rows of a key lie in the partitions before it is a sum over one row per partition
    and key.  These sums are broadcast: there are at most as many as partitions plus distinct keys, so ``keys`` must
    be few (shards, lengths), whatever the number of rows.  Equal rows get different ranks; null keys are a key.
    """
    columns = [F.col(k) for k in keys]
    placed = df.repartitionByRange(shuffle_partitions(df), *columns, *order).sortWithinPartitions(*columns, *order)
    # The number is 2**33 times the partition plus the place in it; the written table keeps it as it is.
    written = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    segment = F.shiftright("_at", 33).alias("_segment")
    parts = written.groupBy(segment, *columns).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        F.col("_segment").alias("_of"),
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.shiftright("_at", 33) == F.col("_of")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    rank = (F.col("_at") + F.col("_shift")).alias(into)
    return written.join(F.broadcast(starts), same).select(*df.columns, rank)
