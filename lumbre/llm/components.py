"""Connected components of links, by rounds of hooking every node to the smallest node it can see."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.storage import cut_lineage


def _smallest(links: DataFrame) -> DataFrame:
    """``links`` (``a, b``) with ``m``: the smallest of a and all its b."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def _far(links: DataFrame) -> DataFrame:
    """Every node ties its greater neighbours to the smallest node it knows."""
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.select(F.inline(F.array(F.struct("a", "b"), turned)))
    return _smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _near(links: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them; links come as ``a > b``."""
    return _smallest(links).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, and none that has is linked to by others."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``, two numbers): the smallest node of its component.

    The number of rounds grows with the logarithm of the longest path.  Nodes with very many links are reduced in every
    task first.  Links of a node to itself, repeated links and either direction are fine; nulls are no links.
    """
    given = links.filter("a is not null and b is not null and a <> b")
    now = cut_lineage(given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        now = cut_lineage(_near(_far(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
