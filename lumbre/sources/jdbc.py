"""PostgreSQL as a source through Spark's JDBC reader.

Connection options (``url``, ``user``, ``password``, ``driver`` …) always come from the caller; none are kept here.
Counts, sizes and catalog lookups are queries the database answers itself, one per relation for all tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from lumbre.sources.catalog import Catalog
from lumbre.sources.frames import small_frame
from lumbre.sources.tables import SIZES

# The information-schema and system-catalog relations read at the source.
CATALOG_QUERIES = {
    "tables": "SELECT table_schema, table_name, table_type FROM information_schema.tables",
    "columns": (
        "SELECT table_schema, table_name, ordinal_position, column_name, data_type, is_nullable, column_default "
        "FROM information_schema.columns"
    ),
    "pg_class": (
        "SELECT CAST(c.oid AS bigint) AS oid, n.nspname, c.relname FROM pg_class c "
        "JOIN pg_namespace n ON n.oid = c.relnamespace"
    ),
    "pg_index": (
        "SELECT CAST(indrelid AS bigint) AS indrelid, CAST(indkey AS int2[]) AS indkey, indisprimary FROM pg_index"
    ),
    "pg_attribute": "SELECT CAST(attrelid AS bigint) AS attrelid, attnum, attname FROM pg_attribute",
    "table_constraints": (
        "SELECT constraint_name, table_schema, table_name, constraint_type FROM information_schema.table_constraints"
    ),
    "key_column_usage": (
        "SELECT constraint_name, table_schema, table_name, column_name, ordinal_position "
        "FROM information_schema.key_column_usage"
    ),
    # The standard view knows neither the constrained table nor the position, so the pairs come from pg_constraint.
    "constraint_column_usage": (
        "SELECT k.conname AS constraint_name, n.nspname AS table_schema, parent.relname AS table_name, "
        "a.attname AS column_name, child.relname AS constrained_table, CAST(u.ord AS int) AS ordinal_position "
        "FROM pg_constraint k JOIN pg_class child ON child.oid = k.conrelid "
        "JOIN pg_class parent ON parent.oid = k.confrelid JOIN pg_namespace n ON n.oid = child.relnamespace "
        "CROSS JOIN LATERAL unnest(k.confkey) WITH ORDINALITY AS u(attnum, ord) "
        "JOIN pg_attribute a ON a.attrelid = k.confrelid AND a.attnum = u.attnum WHERE k.contype = 'f'"
    ),
    "pg_indexes": "SELECT schemaname, tablename, indexname, indexdef FROM pg_indexes",
}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def read_query(spark: SparkSession, options: Mapping[str, str], sql: str) -> DataFrame:
    """Run ``sql`` at the source and fetch its rows."""
    return spark.read.format("jdbc").options(**options).option("query", sql).load()


def read_table(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    partition: tuple[str, object, object, int] | None = None,
) -> DataFrame:
    """One table; ``partition = (column, lower, upper, parts)`` reads it in that many ranges.

    Without ``partition`` the source sends the table over one connection to one task, so give it for large tables.
    The bounds only place the cuts: rows outside them are read too.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(
            partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts)
        )
    return reader.load()


class JdbcDatabase:
    """Base tables of one PostgreSQL schema."""

    def __init__(self, spark: SparkSession, options: Mapping[str, str], schema: str = "public"):
        self.spark = spark
        self.options = dict(options)
        self.schema = schema

    def _query(self, sql: str) -> DataFrame:
        return read_query(self.spark, self.options, sql)

    def names(self) -> list[str]:
        sql = (
            f"SELECT table_name FROM information_schema.tables WHERE table_schema = {literal(self.schema)} "
            "AND table_type = 'BASE TABLE'"
        )
        return sorted(row.table_name for row in self._query(sql).collect())

    def _full_name(self, name: str) -> str:
        return f"{quoted(self.schema)}.{quoted(name)}"

    def read(self, name: str, partition: tuple[str, object, object, int] | None = None) -> DataFrame:
        return read_table(self.spark, self.options, self._full_name(name), partition)

    def row_count(self, name: str) -> DataFrame:
        return self._query(f"SELECT COUNT(*) AS registros FROM {self._full_name(name)}")

    def sizes(self, names: list[str]) -> DataFrame:
        if not names:
            return small_frame(self.spark, SIZES, [])
        listed = ", ".join(literal(name) for name in names)
        return self._query(
            "SELECT c.relname AS tabla, pg_relation_size(c.oid) AS bytes_table, pg_indexes_size(c.oid) AS bytes_indexes, "
            "pg_total_relation_size(c.oid) AS bytes_total FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace "
            f"WHERE n.nspname = {literal(self.schema)} AND c.relname IN ({listed})"
        )

    def catalog(self, names: list[str]) -> Catalog:
        return Catalog(**{relation: self._query(sql) for relation, sql in CATALOG_QUERIES.items()})


