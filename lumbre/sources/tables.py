"""Collections of tables: a folder of Parquet tables or a database of the session catalog."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.sources.catalog import Catalog, DeclaredKeys, declared_catalog
from lumbre.sources.frames import small_frame

SIZES = "tabla string, bytes_table long, bytes_indexes long, bytes_total long"


def quoted(name: str) -> str:
    """An identifier that keeps its case and any special characters."""
    return "`" + name.replace("`", "``") + "`"


def parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(tabla, path, length)`` of every data file below ``folder``: a listing, no file is opened.

    A table is ``<name>.parquet``, a file or a folder of files.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    table = F.regexp_extract("path", r"([^/]+)\.parquet(/|$)", 1)
    return listing.select(table.alias("tabla"), "path", "length")


class ParquetFolder:
    """Parquet tables in one folder, with the keys the caller declares for them."""

    def __init__(self, spark: SparkSession, folder: str, keys: DeclaredKeys | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.keys = keys or DeclaredKeys()
        self._opened: dict[str, DataFrame] = {}

    def listed(self) -> DataFrame:
        """Names of the tables."""
        return parquet_files(self.spark, self.folder).select("tabla").distinct()

    def names(self) -> list[str]:
        return sorted(row.tabla for row in self.listed().collect())

    def read(self, name: str) -> DataFrame:
        if name not in self._opened:  # the schema is read once per table
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    def open(self, names: Sequence[str]) -> None:
        """Read the schemas of several tables at the same time."""
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(self.read, names))

    def row_count(self, name: str) -> DataFrame:
        return self.read(name).agg(F.count(F.lit(1)).alias("registros"))

    def sizes(self, names: list[str]) -> DataFrame:
        """Bytes per table from the file listing.  Parquet has no indexes, so the table is the total."""
        table = F.sum("length")
        return (
            parquet_files(self.spark, self.folder)
            .filter(F.col("tabla").isin(names))
            .groupBy("tabla")
            .agg(table.alias("bytes_table"))
            .select("tabla", "bytes_table", F.lit(0).cast("long").alias("bytes_indexes"), F.col("bytes_table").alias("bytes_total"))
        )

    def catalog(self, names: list[str]) -> Catalog:
        return declared_catalog(self.spark, {name: self.read(name).schema for name in names}, self.keys)


class CatalogDatabase:
    """Managed and external tables of a database of the session catalog."""

    def __init__(self, spark: SparkSession, database: str, keys: DeclaredKeys | None = None):
        self.spark = spark
        self.database = database
        self.keys = keys or DeclaredKeys()

    def names(self) -> list[str]:
        listed = self.spark.catalog.listTables(self.database)
        return sorted(t.name for t in listed if not t.isTemporary and t.tableType in ("MANAGED", "EXTERNAL"))

    def _full_name(self, name: str) -> str:
        return f"{quoted(self.database)}.{quoted(name)}"

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._full_name(name))

    def row_count(self, name: str) -> DataFrame:
        return self.read(name).agg(F.count(F.lit(1)).alias("registros"))

    def sizes(self, names: list[str]) -> DataFrame:
        """Bytes per table as ``ANALYZE TABLE`` records them, without reading rows."""
        if not names:
            return small_frame(self.spark, SIZES, [])
        for name in names:
            self.spark.sql(f"ANALYZE TABLE {self._full_name(name)} COMPUTE STATISTICS NOSCAN")
        recorded = [
            self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._full_name(name)}")
            .filter(F.col("col_name") == "Statistics")
            .select(
                F.lit(name).alias("tabla"),
                F.regexp_extract("data_type", r"^(\d+) bytes", 1).cast("long").alias("bytes_table"),
            )
            for name in names
        ]
        return reduce(DataFrame.unionByName, recorded).select(
            "tabla", "bytes_table", F.lit(0).cast("long").alias("bytes_indexes"), F.col("bytes_table").alias("bytes_total")
        )

    def catalog(self, names: list[str]) -> Catalog:
        return declared_catalog(self.spark, {name: self.read(name).schema for name in names}, self.keys)
