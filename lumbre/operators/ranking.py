"""PageRank by repeated join and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.operators.ordered import shuffle_partitions
from lumbre.storage import bucketed, cut_lineage

# The links of a source are dealt out over parts of about this many.
LINKS_PER_TASK = 1_000_000
# Links are written in buckets of about this many, or in as many as the session shuffles into if that is more.
LINKS_PER_BUCKET = 1_000_000


def page_rank(
    edges: DataFrame,
    iterations: int = 5,
    damping: float = 0.85,
    links_per_task: int = LINKS_PER_TASK,
    links_per_bucket: int = LINKS_PER_BUCKET,
    cut_every: int = 5,
) -> DataFrame:
    """``node, rank`` after ``iterations`` rounds over the distinct links of ``edges(src, dst)``.

    Every node with links starts at 1.  A round hands each node's rank out in equal shares along its links and sets
    ``rank = (1 - damping) + damping * received``.  Nodes that receive nothing drop out, nodes without links pass
    nothing on, and ranks are not normalised.

    Links are written once, in buckets of their source and part; a source has as many parts as its number of links
    asks for, so one with very many lies in many buckets.  A round shuffles one share per source and part, and partially summed
    shares, never the links; nor does it sort them: a bucket's shares, no more than its links, are looked up by hash.
    The plan is the same for every size; only the number of buckets and parts follows it.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    parts = F.ceil(F.col("links") / links_per_task).cast("int")
    nodes = cut_lineage(degrees.select(F.col("src").alias("node"), "links", parts.alias("parts")))
    total = nodes.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(links), -(-total // links_per_bucket))
    # Sources of several parts have at least ``links_per_task`` links each, so there are few of them.
    divided = nodes.filter("parts > 1").select(F.col("node").alias("src"), "parts")
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    placed = links.join(F.broadcast(divided), "src", "left").select("src", "dst", part)
    placed = bucketed(placed, buckets, "src", "part")

    ranks = nodes.select("node", F.lit(1.0).alias("rank"))
    for done in range(1, iterations + 1):
        shares = ranks.join(nodes, "node").select(
            F.col("node").alias("src"),
            (F.col("rank") / F.col("links")).alias("share"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        )
        ranks = (
            placed.join(shares.hint("shuffle_hash"), ["src", "part"])
            .groupBy(F.col("dst").alias("node"))
            .agg((F.lit(1 - damping) + damping * F.sum("share")).alias("rank"))
        )
        if done % cut_every == 0 and done < iterations:
            ranks = cut_lineage(ranks)
    return ranks
