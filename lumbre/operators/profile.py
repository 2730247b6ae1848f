"""Table statistics: counts, sizes and keys of a collection of tables, one record per table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions.text import in_order, joined_or, pretty_size
from lumbre.operators import catalog as lookups
from lumbre.sources.frames import small_frame

T = TypeVar("T")

NO_KEY = "Ninguna"
NO_INDEX = "Ninguno"
COUNTS = "tabla string, registros long"
ERRORS = "tabla string, error string"


@dataclass(frozen=True)
class Profile:
    """``stats`` has one record per readable table, ``errors`` one row per table that was skipped."""

    stats: DataFrame
    errors: DataFrame


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _union(spark: SparkSession, frames: Sequence[DataFrame], schema: str) -> DataFrame:
    return union_all(frames) if frames else small_frame(spark, schema, [])


def row_counts(source, names: Sequence[str]) -> DataFrame:
    """``tabla, registros``; an empty table counts 0.  Each branch sends one number per task to its shuffle."""
    branches = [source.row_count(name).select(F.lit(name).alias("tabla"), "registros") for name in names]
    return _union(source.spark, branches, COUNTS)


#: What is wrong with a table; anything else, such as a lost connection to Spark, ends the job.
DATA_ERRORS = (PySparkException, Py4JJavaError, OSError)


def _told(source, problem: Exception) -> str:
    """The text of a table's problem, if it is one: where Spark itself has ended, no table is to blame."""
    if source.spark.sparkContext._jsc.sc().isStopped():
        raise problem
    return str(problem)


def _attempt(source, name: str, execute: bool):
    try:
        counted = source.row_count(name).select(F.lit(name).alias("tabla"), "registros")
        return name, (counted.first() if execute else counted), None
    except DATA_ERRORS as problem:
        return name, None, _told(source, problem)


def isolated_counts(source, names: Sequence[str], execute: bool = True, threads: int = 8):
    """Row counts and errors with every table on its own: ``(counts, errors, readable)``, the latter two as lists.

    Tables are resolved and counted one by one (as concurrent jobs, one number back from each), so that a table whose data cannot be
    read is skipped like one whose schema cannot.  Without ``execute`` they are only resolved, and counted in one job later on.
    """
    with ThreadPoolExecutor(threads) as pool:
        tried = list(pool.map(lambda name: _attempt(source, name, execute), names))
    good = [counted for _, counted, problem in tried if problem is None]
    counts = small_frame(source.spark, COUNTS, good) if execute else _union(source.spark, good, COUNTS)
    errors = [(n, problem) for n, _, problem in tried if problem is not None]
    return counts, errors, [name for name, _, problem in tried if problem is None]


def looked_up(source, read: Callable[[Sequence[str]], T], names: Sequence[str]) -> tuple[T, list[tuple[str, str]], list[str]]:
    """``read(names)``, and if that fails, of the names that can be read by themselves: ``(result, errors, readable)``."""
    try:
        return read(names), [], list(names)
    except DATA_ERRORS as problem:
        _told(source, problem)
    errors, readable = [], []
    for name in names:
        try:
            read([name])
            readable.append(name)
        except DATA_ERRORS as problem:
            errors.append((name, _told(source, problem)))
    return read(readable), errors, readable


def profile(source, schema: str = "public", compat: bool = False, execute: bool = True) -> Profile:
    """The statistics record of every table of ``source``; a table that fails at any step is reported and skipped, the others go on."""
    counts, failed, names = isolated_counts(source, source.names(), execute)
    sizes, without_size, names = looked_up(source, source.sizes, names)
    cat, without_catalog, names = looked_up(source, source.catalog, names)
    errors = small_frame(source.spark, ERRORS, [*failed, *without_size, *without_catalog])
    if without_size or without_catalog:
        counts = counts.filter(F.col("tabla").isin(names))
    columns = (
        lookups.table_columns(cat.columns, schema)
        .groupBy("tabla")
        .agg(in_order(F.col("ordinal_position"), F.col("column_name")).alias("columns"))
    )
    primary = (
        lookups.primary_keys(cat.pg_index, cat.pg_attribute, cat.pg_class, schema)
        .groupBy("tabla")
        .agg(in_order(F.col("key_position"), F.col("column_name")).alias("primary"))
    )
    reference = F.format_string(
        "%s -> %s.%s", F.col("column_name"), F.col("foreign_table_name"), F.col("foreign_column_name")
    )
    foreign = (
        lookups.foreign_keys(
            cat.table_constraints, cat.key_column_usage, cat.constraint_column_usage, schema, compat
        )
        .groupBy("tabla")
        .agg(in_order(F.struct("constraint_name", "key_position"), reference).alias("foreign"))
    )
    indexed = (
        lookups.indexes(cat.pg_indexes, schema)
        .groupBy("tabla")
        .agg(F.sort_array(F.collect_list("index_name")).alias("indexed"))
    )
    joined = counts
    for part in (sizes, columns, primary, foreign, indexed):
        joined = joined.join(part, "tabla", "left")

    def how_many(names_column: str):
        return F.greatest(F.coalesce(F.size(names_column), F.lit(0)), F.lit(0))

    stats = joined.select(
        "tabla",
        "registros",
        pretty_size(F.col("bytes_total")).alias("tamaño_total"),
        pretty_size(F.col("bytes_table")).alias("tamaño_tabla"),
        pretty_size(F.col("bytes_indexes")).alias("tamaño_indices"),
        how_many("columns").alias("cantidad_columnas"),
        F.concat_ws(", ", "columns").alias("columnas"),
        joined_or(F.col("primary"), NO_KEY).alias("llaves_primarias"),
        how_many("foreign").alias("cantidad_llaves_foraneas"),
        joined_or(F.col("foreign"), NO_KEY).alias("llaves_foraneas"),
        how_many("indexed").alias("cantidad_indices"),
        joined_or(F.col("indexed"), NO_INDEX).alias("indices"),
        "bytes_total",
        "bytes_table",
        "bytes_indexes",
    ).orderBy("tabla")
    return Profile(stats, errors)


def largest_tables(stats: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` tables with most rows; ties go to the first name."""
    return stats.orderBy(F.desc("registros"), "tabla").limit(n).select("tabla", "registros", "tamaño_total")


def summary(stats: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: tables found, processed and failed."""
    outcome = stats.select(F.lit(1).alias("ok")).unionByName(errors.select(F.lit(0).alias("ok")))
    return outcome.agg(
        F.count(F.lit(1)).alias("encontradas"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("procesadas"),
        F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("fallidas"),
    )


def report(stats: DataFrame, with_sizes: bool = True) -> DataFrame:
    """``tabla, detalle``: the record of each table as a block of text."""

    def count_of(label: str, number: str, listed: str):
        return F.format_string(f"   • {label} (%d): %s", F.col(number), F.col(listed))

    # The labels of the report.
    lines = [
        F.concat(F.lit("📊 Tabla: "), F.col("tabla")),
        F.concat(F.lit("   • Registros: "), F.format_number("registros", 0)),
    ]
    if with_sizes:
        lines += [
            F.concat(F.lit("   • Tamaño total: "), F.col("tamaño_total")),
            F.concat(F.lit("   • Tamaño tabla: "), F.col("tamaño_tabla")),
            F.concat(F.lit("   • Tamaño índices: "), F.col("tamaño_indices")),
        ]
    lines += [
        count_of("Columnas", "cantidad_columnas", "columnas"),
        F.concat(F.lit("   • Llaves primarias: "), F.col("llaves_primarias")),
        count_of("Llaves foráneas", "cantidad_llaves_foraneas", "llaves_foraneas"),
        count_of("Índices", "cantidad_indices", "indices"),
    ]
    return stats.select("tabla", F.concat_ws("\n", *lines).alias("detalle"))
