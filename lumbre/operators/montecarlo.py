"""Monte-Carlo estimate of Pi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES_PER_SLICE = 100_000


def pi_from_points(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row ``samples, inside, pi`` from points of the square [-1, 1] x [-1, 1]."""
    inside = F.count(F.when(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1, 1))
    samples = F.count(F.lit(1))
    return points.select(x.alias("x"), y.alias("y")).agg(
        samples.alias("samples"), inside.alias("inside"), (4.0 * inside / samples).alias("pi")
    )


def monte_carlo_pi(spark: SparkSession, slices: int = 100, seed: int | None = None) -> DataFrame:
    """Pi from ``slices`` tasks of 100,000 random points each; only two numbers per task are shuffled."""
    points = spark.range(0, slices * SAMPLES_PER_SLICE, 1, slices)

    def side(offset: int) -> Column:
        return (F.rand() if seed is None else F.rand(seed + offset)) * 2 - 1

    return pi_from_points(points, side(0), side(1))
