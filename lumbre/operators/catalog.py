"""Lookups over catalog relations, each answered for all tables of a schema in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_tables(tables: DataFrame, schema: str = "public") -> DataFrame:
    """Names of the base tables, sorted: ``tabla``."""
    wanted = (F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")
    return tables.filter(wanted).select(F.col("table_name").alias("tabla")).orderBy("tabla")


def table_columns(columns: DataFrame, schema: str = "public") -> DataFrame:
    """``tabla, ordinal_position, column_name, data_type, is_nullable, column_default``."""
    return columns.filter(F.col("table_schema") == schema).select(
        F.col("table_name").alias("tabla"),
        "ordinal_position",
        "column_name",
        "data_type",
        "is_nullable",
        "column_default",
    )


def primary_keys(
    pg_index: DataFrame, pg_attribute: DataFrame, pg_class: DataFrame, schema: str = "public"
) -> DataFrame:
    """``tabla, key_position, column_name`` of every declared primary key.

    The membership test ``attnum = ANY(indkey)`` becomes an equi-join on the unnested key, which also keeps the
    order of the columns in the key.
    """
    keys = pg_index.filter("indisprimary").select(
        F.col("indrelid").alias("relid"), F.posexplode("indkey").alias("pos", "attnum")
    )
    attributes = pg_attribute.select(F.col("attrelid").alias("relid"), "attnum", "attname")
    relations = pg_class.filter(F.col("nspname") == schema).select(
        F.col("oid").alias("relid"), F.col("relname").alias("tabla")
    )
    return (
        keys.join(attributes, ["relid", "attnum"])
        .join(relations, "relid")
        .select("tabla", (F.col("pos") + 1).alias("key_position"), F.col("attname").alias("column_name"))
    )


def foreign_keys(
    table_constraints: DataFrame,
    key_column_usage: DataFrame,
    constraint_column_usage: DataFrame,
    schema: str = "public",
    compat: bool = False,
) -> DataFrame:
    """``tabla, constraint_name, key_position, column_name, foreign_table_name, foreign_column_name``.

    Columns of a key are paired by position and constraints are told apart by table.  ``compat`` joins on
    constraint name and schema alone: an m-column key then gives m*m pairs, tables that reuse a constraint name
    see each other's columns, and every schema counts.
    """
    constraints = table_constraints.filter(F.col("constraint_type") == "FOREIGN KEY").select(
        "constraint_name", "table_schema", F.col("table_name").alias("tabla")
    )
    own = key_column_usage.select(
        "constraint_name",
        "table_schema",
        F.col("table_name").alias("own_table"),
        "column_name",
        F.col("ordinal_position").alias("key_position"),
    )
    referenced = constraint_column_usage.select(
        "constraint_name",
        "table_schema",
        F.col("table_name").alias("foreign_table_name"),
        F.col("column_name").alias("foreign_column_name"),
        F.col("constrained_table").alias("own_table"),
        F.col("ordinal_position").alias("key_position"),
    )
    name = ["constraint_name", "table_schema"]
    if compat:
        pairs = constraints.join(own, name).join(referenced.drop("own_table", "key_position"), name)
    else:
        pairs = (
            constraints.filter(F.col("table_schema") == schema)
            .join(own, name)
            .filter(F.col("own_table") == F.col("tabla"))
            .join(referenced, [*name, "own_table", "key_position"])
        )
    return pairs.select(
        "tabla", "constraint_name", "key_position", "column_name", "foreign_table_name", "foreign_column_name"
    )


def indexes(pg_indexes: DataFrame, schema: str = "public") -> DataFrame:
    """``tabla, index_name, index_definition``."""
    return pg_indexes.filter(F.col("schemaname") == schema).select(
        F.col("tablename").alias("tabla"),
        F.col("indexname").alias("index_name"),
        F.col("indexdef").alias("index_definition"),
    )


def bound(spark: SparkSession, query: str, values: Mapping[str, object], **relations: DataFrame) -> DataFrame:
    """A SQL query over ``relations``, which it names in braces, with ``values`` for its ``:names``.

    Values are bound, never written into the text, so that no value is taken for SQL, whatever quotes or semicolons it has.
    """
    return spark.sql(query, args=dict(values), **relations)


# Lookups for one table each, by its bound name.
COLUMNS_OF = """
SELECT table_name AS tabla, CAST(ordinal_position AS INT) AS ordinal_position, column_name
FROM {columns} WHERE table_schema = :schema AND table_name = :tabla"""
