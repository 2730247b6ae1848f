"""Catalog lookups on fixtures with composite keys, reused names and other schemas."""

import pytest

from lumbre.operators import catalog as lookups
from lumbre.sources import catalog as relations
from lumbre.sources.frames import small_frame


@pytest.fixture(scope="module")
def constraints(spark):
    """``child`` refers to ``parent`` by two columns; ``other`` reuses the constraint's name for one column."""
    tc = [("fk", "public", "child", "FOREIGN KEY"), ("fk", "public", "other", "FOREIGN KEY"), ("pk", "public", "child", "PRIMARY KEY")]
    kcu = [("fk", "public", "child", "a", 1), ("fk", "public", "child", "b", 2), ("fk", "public", "other", "c", 1)]
    ccu = [
        ("fk", "public", "parent", "x", "child", 1),
        ("fk", "public", "parent", "y", "child", 2),
        ("fk", "public", "thing", "z", "other", 1),
    ]
    return (
        small_frame(spark, relations.TABLE_CONSTRAINTS, tc),
        small_frame(spark, relations.KEY_COLUMN_USAGE, kcu),
        small_frame(spark, relations.CONSTRAINT_COLUMN_USAGE, ccu),
    )


def test_base_tables(spark):
    tables = small_frame(
        spark,
        relations.TABLES,
        [("public", "b", "BASE TABLE"), ("public", "Mixed", "BASE TABLE"), ("public", "v", "VIEW"), ("audit", "log", "BASE TABLE")],
    )
    assert [r.tabla for r in lookups.base_tables(tables).collect()] == ["Mixed", "b"]


def test_columns_keep_their_defaults(spark):
    columns = small_frame(
        spark,
        relations.COLUMNS,
        [("public", "t", 1, "id", "integer", "NO", "nextval('s')"), ("public", "t", 2, "n", "text", "YES", None), ("audit", "t", 1, "x", "text", "YES", None)],
    )
    assert [tuple(r) for r in lookups.table_columns(columns).orderBy("ordinal_position").collect()] == [
        ("t", 1, "id", "integer", "NO", "nextval('s')"),
        ("t", 2, "n", "text", "YES", None),
    ]


def test_primary_key_keeps_the_order_of_the_index(spark, rows):
    index = small_frame(spark, relations.PG_INDEX, [(7, [3, 1], True), (7, [2], False), (8, [1], True)])
    attribute = small_frame(spark, relations.PG_ATTRIBUTE, [(7, 1, "a"), (7, 2, "b"), (7, 3, "c"), (8, 1, "a")])
    named = small_frame(spark, relations.PG_CLASS, [(7, "public", "t"), (8, "audit", "u")])
    assert rows(lookups.primary_keys(index, attribute, named)) == [("t", 1, "c"), ("t", 2, "a")]


def test_foreign_keys_pair_by_position(constraints, rows):
    found = lookups.foreign_keys(*constraints).filter("tabla = 'child'")
    assert rows(found) == [("child", "fk", 1, "a", "parent", "x"), ("child", "fk", 2, "b", "parent", "y")]


def test_foreign_keys_compat_pairs_everything(constraints):
    found = lookups.foreign_keys(*constraints, compat=True)
    assert found.filter("tabla = 'child'").count() == 9


def test_foreign_keys_of_other_tables_stay_apart(constraints, rows):
    found = lookups.foreign_keys(*constraints).filter("tabla = 'other'")
    assert rows(found) == [("other", "fk", 1, "c", "thing", "z")]


def test_indexes(spark, rows):
    listed = small_frame(spark, relations.PG_INDEXES, [("public", "t", "t_i", "CREATE INDEX"), ("audit", "t", "a_i", "CREATE")])
    assert rows(lookups.indexes(listed)) == [("t", "t_i", "CREATE INDEX")]
