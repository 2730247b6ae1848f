"""The shared folder: where lineage is cut and where intermediate tables are written.

The folder is the one the cluster names in ``spark.checkpoint.dir``, so every executor can read what
another one wrote and a lost executor costs a re-read, not a re-run.  Only a local session, which has no
other machine to share with, falls back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Path of the shared folder; also makes it the context's checkpoint folder when none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="lumbre-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/lumbre/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A columnar table rather than an RDD checkpoint: it is smaller, later reads take only the columns they need, and
    its size is known when joins are planned.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """``df`` written to the shared folder in hash buckets of ``keys`` and read back.

    Joins and groupings on ``keys`` with as many partitions then read it without a shuffle.  The table is in the
    catalog only until it has been opened; its files stay in the shared folder.
    """
    spark = df.sparkSession
    name = f"spark_catalog.default.lumbre_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", new_folder(spark, "bucketed")).saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolves the table
    spark.sql(f"DROP TABLE {name}")
    return written
