"""Running a stream over what is there now, and keeping its results in the shared folder."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumbre.storage import cut_lineage

#: Folders of batches before they are brought together.
FOLDERS = 16
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a batch costs per partition of state, whatever it holds: joined streams share one store instead of four, and a batch writes its changes
#: instead of the whole store.
STORES = {
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own for a stream: state lives in RocksDB (on disk) unless the caller chose a store, with the settings in ``STORES``.

    ``partitions`` is the number of state partitions, the session's shuffle partitions if it is not given; a stream keeps
    the number it was started with, so choose it for what the stream will hold, not for what there is at its start.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = spark.conf.getAll
    own.conf.set(PROVIDER, chosen.get(PROVIDER, ROCKSDB))
    if own.conf.get(PROVIDER) == ROCKSDB:
        for name, value in STORES.items():
            own.conf.set(name, chosen.get(name, value))
    return own


def stream_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).options(**options)
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.parquet(path)
    # A stream reads folders, so a single file is picked from the one it lies in; signs of patterns stand for themselves.
    name = re.sub(r"([*?\[\]{}\\])", r"\\\1", place.getName())
    return reader.option("pathGlobFilter", name).parquet(place.getParent().toString())


@dataclass(frozen=True)
class Batch:
    """What one micro-batch did: rows read, rows that came later than the watermark allows and were left out, and groups of state it changed."""

    number: int
    rows: int
    late: int
    changed: int


def finished(writer: DataStreamWriter, path: str) -> list[Batch]:
    """Run a stream over what is there now; its batches, as far as the session keeps their progress."""
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return [
        Batch(
            p.batchId,
            p.numInputRows,
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            sum(s.numRowsUpdated for s in p.stateOperators),
        )
        for p in query.recentProgress
    ]


def append_available(stream: DataFrame, path: str) -> list[Batch]:
    """Process all that is available and append the results to a Parquet table, exactly once."""
    return finished(stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table"), path)


def update_available(stream: DataFrame, path: str, keys: Sequence[str] = ()) -> list[Batch]:
    """Process all that is available; each batch adds the new versions of the groups it changed.

    A batch that is run again replaces its own folder, so the table stays right after a failure.  With the ``keys`` of the groups,
    folders are brought together whenever there are more than ``FOLDERS``.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/table/batch={batch}")
        if keys:
            compact(changed.sparkSession, path, keys)

    return finished(stream.writeStream.outputMode("update").foreachBatch(keep), path)


def numbered(spark: SparkSession, folder: str) -> dict[int, str]:
    """The written tables ``name=number`` in a folder, by number."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(place)]
    whole = (n for n in names if "=" in n and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in whole}


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Bring the folders of all batches so far together into one, if there are more than ``FOLDERS``.

    The whole table is written first, marked as complete by the writer, and the folders it replaces are deleted then; readers take the latest whole table and the
    batches after it.  So a failure at any point leaves a right table behind, and the next batch takes up what is left to do.
    """
    batches, wholes = numbered(spark, f"{path}/table"), numbered(spark, f"{path}/whole")
    if len(batches) > FOLDERS:
        upto = max(batches)
        read_latest(spark, path, keys).write.mode("overwrite").parquet(f"{path}/whole/upto={upto}")
        wholes[upto] = f"{path}/whole/upto={upto}"
    newest = max(wholes, default=-1)
    for number, folder in [*batches.items(), *wholes.items()]:
        if number < newest or (number == newest and folder in batches.values()):
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table")


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest version of every group an update stream has written."""
    wholes, batches = numbered(spark, f"{path}/whole"), numbered(spark, f"{path}/table")
    newest = max(wholes, default=-1)
    parts = [spark.read.parquet(folder).withColumn("batch", F.lit(n)) for n, folder in batches.items() if n > newest]
    parts += [spark.read.parquet(wholes[newest]).withColumn("batch", F.lit(newest))] if wholes else []
    versions = reduce(DataFrame.unionByName, parts)  # FOLDERS of them at most where folders are brought together
    values = [c for c in versions.columns if c not in (*keys, "batch")]
    latest = versions.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("latest"))
    return latest.select(*keys, *(F.col(f"latest.{v}").alias(v) for v in values))


def arrivals(table: DataFrame, order: str, parts: int, path: str) -> Iterator[str]:
    """The rows of a table as they would arrive: ``parts`` times about as many, in the order of a column; ``path`` after each time."""
    shares = [i / parts for i in range(1, parts)]
    place = F.unix_micros(F.col(order).cast("timestamp")) if "timestamp" in table.schema[order].dataType.simpleString() else F.col(order)
    placed = cut_lineage(table.withColumn("_place", place))
    cuts = placed.agg(F.percentile_approx("_place", shares, 1000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = placed if low is None else placed.filter(F.col("_place") > low)
        part = part if high is None else part.filter(F.col("_place") <= high)
        part.drop("_place").write.mode("append").parquet(path)
        yield path
