"""Word count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.functions.text import space_tokens


def text_lines(df: DataFrame, text: str, *ids: str) -> DataFrame:
    """``ids, line_no, line``: the lines of a text column, numbered from 0."""
    return df.select(*ids, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def words(lines: DataFrame) -> DataFrame:
    """``word``: one row per token of the ``line`` column."""
    return lines.select(F.explode(space_tokens(F.col("line"))).alias("word"))


def word_count(lines: DataFrame) -> DataFrame:
    """``word, n``; counts are partial per task before the shuffle, so frequent words do not pile up."""
    return words(lines).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
