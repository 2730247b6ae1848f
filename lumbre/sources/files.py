"""Text lines, edge lists and labelled sparse vectors from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``line``."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream that picks up new files."""
    return spark.readStream.text(path).select(F.col("value").alias("line"))


def edges_from_lines(lines: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` from the first two whitespace-separated fields of every line.

    Lines without a second field hold no link and are left out.
    """
    fields = F.split("line", r"\s+", 3)
    links = lines.select(F.get(fields, F.lit(0)).alias("src"), F.get(fields, F.lit(1)).alias("dst"))
    return links.filter("dst <> ''").distinct()


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """``label, features``.  Give the number of features to spare a pass over the file."""
    reader = spark.read.format("libsvm")
    if features:
        reader = reader.option("numFeatures", str(features))
    return reader.load(path)
