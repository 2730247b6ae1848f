"""Shards of about equal bytes, as the leaves of a k-d tree over the metadata of groups of equal texts.

Every node is split along the metadata dimension that is widest in it, at the weighted median of the bytes, until a
leaf has the target bytes.  The median is found where the rows are: per round, the bytes of all nodes fall into
equal intervals of the dimension, and the interval that holds the median is cut again, until it holds next to nothing.
Equal coordinates are told apart by a hash, so any cut can be met.

A group is never divided.  Groups of more than ``1 / HEAVY`` of the target would move a median by that much; there are at most
``HEAVY`` times as many as shards, so the driver knows them all and puts each on the side of a split that has the
most room for it, before the median is taken over the rest.

Null texts count as empty: 1 byte, and one group with the empty texts.  Null metadata are the smallest value.  Repeated rows are
placed as often as they occur, all in one shard.  Other columns are not read.  An empty table gives no rows.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm.ranks import ranked
from lumbre.storage import cut_lineage

HEAVY = 64
#: Intervals per node and round; a cut is good when at most this share of the node is uncertain.
INTERVALS = 1024
TOLERANCE = 0.0005
#: Coordinates are whole numbers below SCALE, hashes too; together they are one sortable number.
SCALE = 1 << 31


def text_code(column: Column) -> Column:
    """The first seven bytes as a number: ordered like the texts."""
    first = F.rpad(F.hex(F.substring(F.encode(F.coalesce(column, F.lit("")), "utf-8"), 1, 7)), 14, "0")
    return F.conv(first, 16, 10).cast("double")


def dimensions_of_groups() -> dict[str, Column]:
    """The metadata dimensions, as aggregates over the rows of a group."""
    return {
        "source": text_code(F.min("source")),
        "lang": text_code(F.min("lang")),
        "size": F.log2(F.min("size").cast("double")),
        "age": F.coalesce(F.min("doc_id"), F.lit(0)).cast("double"),
    }


@dataclass
class Node:
    """A part of the groups; ``shards`` many leaves will hang on it, numbered from ``first``."""

    number: int
    first: int
    shards: int
    weight: int = 0
    heavy: list = field(default_factory=list)  # (weight, digest)


def literal_rows(spark: SparkSession, rows: list[tuple], **types: str) -> DataFrame:
    """A few rows as an expression: no data are sent, and nothing but the JVM makes them."""
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in types.items()))
    cells = [[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, types.items(), strict=True)] for row in rows]
    return spark.range(1).select(F.inline(F.array(*(F.struct(*row) for row in cells))))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, digest, lang, source``: what sharding needs of each row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        "lang",
        "source",
    )


def coordinates(groups: DataFrame, dimensions: list[str]) -> DataFrame:
    """Dimensions as whole numbers from 0 to SCALE - 1 over their whole range, each with the hash behind it."""
    ends = groups.agg(*(f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def placed(d: str) -> Column:
        lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        share = F.lit(0.0) if hi <= lo else (F.col(d) - lo) / (hi - lo)
        return F.floor(share * (SCALE - 1)).cast("long") * SCALE + F.col("_hash")

    hashed = groups.withColumn("_hash", F.pmod(F.xxhash64("digest"), F.lit(SCALE)))
    return hashed.select("digest", "weight", *(placed(d).alias(d) for d in dimensions))


def with_splits(points: DataFrame, splits: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """Moves the rows of split nodes to their children; the splits of a level are at most as many as shards."""
    if not splits:
        return points
    spark = points.sparkSession
    table = literal_rows(spark, splits, node="int", _along="string", _cut="long", _left="int", _right="int")
    along = F.coalesce(*(F.when(F.col("_along") == d, F.col(d)) for d in points.columns if d not in FIXED))
    child = F.when(F.col("_along").isNull(), F.col("node")).when(along < F.col("_cut"), F.col("_left")).otherwise(F.col("_right"))
    joined = points.join(F.broadcast(table), "node", "left")
    return joined.select(*(c for c in points.columns if c != "node"), child.alias("node"))


FIXED = ("digest", "weight", "node")


def medians(points: DataFrame, asked: list[tuple[int, str, float, int]]) -> dict[int, int]:
    """For each ``(node, dimension, weight, node's weight)`` the cut with about that weight of the node below it."""
    spark = points.sparkSession
    state = {node: (along, 0, SCALE * SCALE, weight, whole) for node, along, weight, whole in asked}
    cuts: dict[int, int] = {}
    for node, (_, _, _, weight, whole) in list(state.items()):
        if weight <= 0 or weight >= whole:
            cuts[node] = 0 if weight <= 0 else SCALE * SCALE
            del state[node]
    while state:
        rows = [(n, a, lo, max(1, -(-(hi - lo) // INTERVALS)), hi) for n, (a, lo, hi, _, _) in state.items()]
        table = literal_rows(spark, rows, node="int", _along="string", _lo="long", _step="long", _hi="long")
        along = F.coalesce(*(F.when(F.col("_along") == d, F.col(d)) for d in points.columns if d not in FIXED))
        inside = points.join(F.broadcast(table), "node").withColumn("_x", along).filter("_x >= _lo and _x < _hi")
        sums = inside.groupBy("node", F.floor((F.col("_x") - F.col("_lo")) / F.col("_step")).cast("long").alias("at"))
        found: dict[int, list] = {n: [] for n in state}
        for row in sums.agg(F.sum("weight").alias("w")).collect():  # at most INTERVALS rows for each node
            found[row["node"]].append((row["at"], row["w"]))
        steps = {r[0]: r[3] for r in rows}
        for node, (along_name, lo, _, weight, whole) in list(state.items()):
            below = 0
            for at, w in sorted(found[node]):
                if below + w >= weight:
                    break
                below += w
            start, step = lo + at * steps[node], steps[node]
            if step == 1 or w <= TOLERANCE * whole:
                cuts[node] = start + step if weight - below > w / 2 else start
                del state[node]
            else:
                state[node] = (along_name, start, start + step, weight - below, whole)
    return cuts


def split_heavy(node: Node, share: float) -> tuple[list, list]:
    """Each heavy group goes to the side with the most room left for its target."""
    rooms, sides = [node.weight * share, node.weight * (1 - share)], ([], [])
    for weight, digest in sorted(node.heavy, key=lambda h: (-h[0], h[1])):
        side = 0 if rooms[0] >= rooms[1] else 1
        sides[side].append((weight, digest))
        rooms[side] -= weight
    return sides


def kd_shards(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``digest, shard`` for the groups of ``rows`` (from ``sized``): as many shards as asked for, or as the target needs."""
    metadata = dimensions_of_groups()
    dimensions = list(metadata)
    aggregates = [F.sum("size").alias("weight"), *(column.alias(d) for d, column in metadata.items())]
    groups = cut_lineage(rows.groupBy("digest").agg(*aggregates))
    total = groups.agg(F.sum("weight")).first()[0] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    limit = total / shards / HEAVY
    heavy = [(r["weight"], bytes(r["digest"])) for r in groups.filter(F.col("weight") > limit).select("weight", "digest").collect()]
    light = coordinates(groups.filter(F.col("weight") <= limit), dimensions)
    points = cut_lineage(light.withColumn("node", F.lit(0)))
    numbers, open_nodes, leaves, last = points, [Node(0, 0, shards, total, heavy)], [], 0
    while open_nodes:
        leaves += [n for n in open_nodes if n.shards == 1]
        open_nodes = [n for n in open_nodes if n.shards > 1]
        if not open_nodes:
            break
        here = numbers.filter(F.col("node").isin([n.number for n in open_nodes])).groupBy("node")
        ends = [(F.max(d) - F.min(d)).alias(d) for d in dimensions]
        seen = {r["node"]: r for r in here.agg(F.sum("weight").alias("_w"), *ends).collect()}  # a row per node
        asked, plans = [], []
        for node in open_nodes:
            row = seen.get(node.number)
            light_weight = row["_w"] if row else 0
            along = max(dimensions, key=lambda d: (row[d] if row else 0) // SCALE)
            left = node.shards // 2
            sides = split_heavy(node, left / node.shards)
            wanted = node.weight * left / node.shards - sum(w for w, _ in sides[0])
            asked.append((node.number, along, wanted, light_weight))
            plans.append((node, along, left, sides))
        cuts = medians(numbers, asked)
        splits, children = [], []
        for node, along, left, sides in plans:
            a, b = Node(last + 1, node.first, left, 0, sides[0]), Node(last + 2, node.first + left, node.shards - left, 0, sides[1])
            last += 2
            splits.append((node.number, along, cuts[node.number], a.number, b.number))
            children += [a, b]
        numbers = with_splits(numbers, splits)
        weights = {r[0]: r[1] for r in numbers.groupBy("node").agg(F.sum("weight")).collect()}
        for child in children:
            child.weight = weights.get(child.number, 0) + sum(w for w, _ in child.heavy)
        open_nodes = children
    spark = rows.sparkSession
    of_node = literal_rows(spark, [(n.number, n.first) for n in leaves], node="int", shard="int")
    placed = numbers.join(F.broadcast(of_node), "node").select("digest", "shard")
    known = [(bytearray(digest), n.first) for n in leaves for _, digest in n.heavy]
    return placed.unionByName(literal_rows(spark, known, digest="binary", shard="int"))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: a shard for every row, and its place in it in the order of ids."""
    rows = cut_lineage(sized(docs))
    placed = rows.join(kd_shards(rows, shards, target_bytes), "digest")
    narrow = placed.select("doc_id", "size", "text_crc32", "shard")
    return ranked(narrow, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot")
