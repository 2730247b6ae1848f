"""Catalog relations: the metadata frames the table statistics are joined from.

The same relations come from a relational database (``sources.jdbc``) or are built here from the schemas of
the tables and the keys the caller declares, so one set of operators serves both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lumbre.sources.frames import small_frame

# The metadata relations and their columns.
TABLES = "table_schema string, table_name string, table_type string"
COLUMNS = (
    "table_schema string, table_name string, ordinal_position int, column_name string, data_type string, "
    "is_nullable string, column_default string"
)
PG_CLASS = "oid long, nspname string, relname string"
PG_INDEX = "indrelid long, indkey array<smallint>, indisprimary boolean"
PG_ATTRIBUTE = "attrelid long, attnum smallint, attname string"
TABLE_CONSTRAINTS = "constraint_name string, table_schema string, table_name string, constraint_type string"
KEY_COLUMN_USAGE = (
    "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int"
)
CONSTRAINT_COLUMN_USAGE = (
    "constraint_name string, table_schema string, table_name string, column_name string, "
    "constrained_table string, ordinal_position int"
)
PG_INDEXES = "schemaname string, tablename string, indexname string, indexdef string"


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of ``table`` refer to ``parent_columns`` of ``parent``, pairwise in order."""

    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.table}_{'_'.join(self.columns)}_fkey"


@dataclass(frozen=True)
class DeclaredKeys:
    """Keys of tables whose storage format has no place for them (Parquet files)."""

    primary: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: Sequence[ForeignKey] = ()


@dataclass(frozen=True)
class Catalog:
    """The metadata relations of one schema."""

    tables: DataFrame
    columns: DataFrame
    pg_class: DataFrame
    pg_index: DataFrame
    pg_attribute: DataFrame
    table_constraints: DataFrame
    key_column_usage: DataFrame
    constraint_column_usage: DataFrame
    pg_indexes: DataFrame


def primary_key_name(table: str) -> str:
    return f"{table}_pkey"


def primary_key_definition(schema: str, table: str, columns: Sequence[str]) -> str:
    return (
        f"CREATE UNIQUE INDEX {primary_key_name(table)} ON {schema}.{table} USING btree ({', '.join(columns)})"
    )


def declared_catalog(
    spark: SparkSession, schemas: Mapping[str, StructType], keys: DeclaredKeys, schema: str = "public"
) -> Catalog:
    """Catalog of tables known by their Spark schemas; a primary key implies its unique index.

    Keys declared for tables that are not in ``schemas`` are left out.
    """
    oid = {name: number for number, name in enumerate(sorted(schemas), start=1)}
    number = {name: {f.name: i for i, f in enumerate(struct, start=1)} for name, struct in schemas.items()}
    primary = {t: cols for t, cols in keys.primary.items() if t in schemas}
    foreign = [fk for fk in keys.foreign if fk.table in schemas]
    return Catalog(
        tables=small_frame(spark, TABLES, [(schema, name, "BASE TABLE") for name in oid]),
        columns=small_frame(
            spark,
            COLUMNS,
            [
                (
                    schema,
                    name,
                    number[name][f.name],
                    f.name,
                    f.dataType.simpleString(),
                    "YES" if f.nullable else "NO",
                    f.metadata.get("CURRENT_DEFAULT"),
                )
                for name, struct in schemas.items()
                for f in struct
            ],
        ),
        pg_class=small_frame(spark, PG_CLASS, [(i, schema, name) for name, i in oid.items()]),
        pg_index=small_frame(
            spark, PG_INDEX, [(oid[t], [number[t][c] for c in cols], True) for t, cols in primary.items()]
        ),
        pg_attribute=small_frame(
            spark, PG_ATTRIBUTE, [(oid[t], i, c) for t, cols in number.items() for c, i in cols.items()]
        ),
        table_constraints=small_frame(
            spark,
            TABLE_CONSTRAINTS,
            [(primary_key_name(t), schema, t, "PRIMARY KEY") for t in primary]
            + [(fk.name, schema, fk.table, "FOREIGN KEY") for fk in foreign],
        ),
        key_column_usage=small_frame(
            spark,
            KEY_COLUMN_USAGE,
            [(fk.name, schema, fk.table, c, i) for fk in foreign for i, c in enumerate(fk.columns, start=1)],
        ),
        constraint_column_usage=small_frame(
            spark,
            CONSTRAINT_COLUMN_USAGE,
            [
                (fk.name, schema, fk.parent, c, fk.table, i)
                for fk in foreign
                for i, c in enumerate(fk.parent_columns, start=1)
            ],
        ),
        pg_indexes=small_frame(
            spark,
            PG_INDEXES,
            [(schema, t, primary_key_name(t), primary_key_definition(schema, t, cols)) for t, cols in primary.items()],
        ),
    )
