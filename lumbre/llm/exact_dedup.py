"""Exact duplicates by a stream with keyed state that never expires.

Arrivals (digest, stable identifier, where the content lies) flow through a streaming aggregation by digest.  Its state is in
RocksDB, on disk, and in the checkpoint in the shared folder; per digest it holds the count, the greatest identifier
seen and the locator of that row, never a text.  A digest seen more than once is a hit, and on hits the full bytes are
compared: rows are counted by digest *and* text, and where one digest turns out to have several texts, each text becomes a group of its own.

Null texts count as empty.  Of equal texts the row with the greatest identifier stays; of rows that also share the identifier (repeated rows),
the one that lies last.  A null identifier is smaller than any other.  Other columns are not read.  An empty table gives no rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.storage import cut_lineage, new_folder
from lumbre.streaming.tables import stream_session

#: Whether a store takes space on disk in advance: some megabytes for each of many partitions.
PREALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def place() -> list[Column]:
    """Where a row of a file-based table lies."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256, key: str = "doc_id") -> DataFrame:
    """``_digest, _id, _file, _row`` of every row of a file-based table, batch or stream."""
    return docs.select(digest(whole(docs)).alias("_digest"), F.col(key).alias("_id"), *place())


def whole(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def remember(arriving: DataFrame, checkpoint: str) -> None:
    """Runs what has arrived through the keyed state at ``checkpoint``; a later run goes on from there.

    Rows are reduced to one per digest in every task before the shuffle, so a digest with very many rows is no burden.
    """
    state = arriving.groupBy("_digest").agg(
        F.max(F.struct("_id", "_file", "_row")).alias("_last"), F.count(F.lit(1)).alias("_size")
    )
    query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``_digest, _last, _size``: what the state at ``checkpoint`` holds."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key._digest", F.col("value.max").alias("_last"), F.col("value.count").alias("_size"))


def deduplicate(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    key: str = "doc_id",
    batch_bytes: int = 1 << 30,
    batch_files: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``, a file-based table: ``key, keep_id, group_size, kept, digest`` and where the kept content lies (``keep_file, keep_row``).

    ``batch_bytes`` and ``batch_files`` bound what a micro-batch takes from the log of arrivals.
    """
    spark = docs.sparkSession
    log = new_folder(spark, "arrivals")
    arrivals(docs, digest, key).write.parquet(f"{log}/rows")
    rows = spark.read.parquet(f"{log}/rows")
    own = stream_session(spark)
    own.conf.set(PREALLOCATE, "false")
    source = own.readStream.schema(rows.schema).option("maxBytesPerTrigger", batch_bytes)
    if batch_files:
        source = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", batch_files)
    remember(source.parquet(f"{log}/rows"), f"{log}/state")
    remembered(own, f"{log}/state").write.parquet(f"{log}/seen")
    seen = spark.read.parquet(f"{log}/seen")

    decided = rows.join(seen, "_digest")
    mixed = cut_lineage(unequal(docs, seen, digest))
    if not mixed.isEmpty():  # texts with the same digest: nothing but the text can tell them apart
        decided = decided.join(mixed, "_digest", "left_anti")
        decided = decided.unionByName(by_text(docs, mixed, digest, key))
    last = F.col("_last")
    return decided.select(
        F.col("_id").alias(key),
        last["_id"].alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.struct("_id", "_file", "_row").eqNullSafe(last)).alias("kept"),
        F.col("_digest").alias("digest"),
        last["_file"].alias("keep_file"),
        last["_row"].alias("keep_row"),
        F.col("_file").alias("file"),
        F.col("_row").alias("row"),
    )


def unequal(docs: DataFrame, seen: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``_digest`` of the hits whose bytes are not all the same.

    Equal bytes meet as one grouping key, reduced in every task before the shuffle; the only one that texts go through.
    """
    content = docs.select(digest(whole(docs)).alias("_digest"), whole(docs).alias("_text"))
    classes = content.groupBy("_digest", "_text").agg(F.count(F.lit(1)).alias("_equal"))
    hits = seen.filter("_size > 1").select("_digest", "_size")
    return classes.select("_digest", "_equal").join(hits, "_digest").filter("_equal <> _size").select("_digest").distinct()


def by_text(docs: DataFrame, mixed: DataFrame, digest: Callable[[Column], Column], key: str) -> DataFrame:
    """The rows of digests with several texts, grouped by digest and text."""
    full = arrivals(docs, digest, key).columns
    content = docs.select(
        digest(whole(docs)).alias("_digest"),
        F.col(key).alias("_id"),
        *place(),
        whole(docs).alias("_text"),
    ).join(mixed, "_digest")
    groups = content.groupBy("_digest", "_text").agg(
        F.max(F.struct("_id", "_file", "_row")).alias("_last"), F.count(F.lit(1)).alias("_size")
    )
    return content.join(groups, ["_digest", "_text"]).select(*full, "_last", "_size")
