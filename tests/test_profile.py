"""The statistics record: sizes, skipped tables, ties, empty schemas, names in mixed case."""

import os

import pytest
from pyspark.sql import functions as F

from lumbre.operators import keys, profile
from lumbre.plans import schema as facts
from lumbre.sources.catalog import DeclaredKeys, ForeignKey
from lumbre.sources.sinks import append_snapshot
from lumbre.sources.tables import CatalogDatabase, ParquetFolder


def write(spark, path, n):
    spark.range(n).withColumn("v", F.col("id") % 3).coalesce(1).write.parquet(str(path))


@pytest.fixture()
def folder(spark, tmp_path):
    for name, n in {"a": 5, "b": 7, "c": 5, "d": 5, "e": 9, "f": 5, "g": 5, "Mixed": 0}.items():
        write(spark, tmp_path / f"{name}.parquet", n)
    return str(tmp_path)


def test_sizes_are_those_on_disk(spark, sf_dir):
    source = ParquetFolder(spark, sf_dir)
    for row in source.sizes(source.names()).collect():
        assert row.bytes_total == row.bytes_table == os.stat(f"{sf_dir}/{row.tabla}.parquet").st_size
        assert row.bytes_indexes == 0


def test_sizes_of_a_folder_of_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    expected = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    assert [tuple(r) for r in ParquetFolder(spark, str(tmp_path)).sizes(["t"]).collect()] == [("t", expected, 0, expected)]


def test_record(spark, folder):
    declared = DeclaredKeys({"a": ("id",)}, (ForeignKey("b", ("id", "v"), "a", ("id", "v")),))
    stats = {r.tabla: r for r in profile.profile(ParquetFolder(spark, folder, declared)).stats.collect()}
    assert sorted(stats) == ["Mixed", "a", "b", "c", "d", "e", "f", "g"]
    assert stats["Mixed"].registros == 0
    assert stats["a"].llaves_primarias == "id"
    assert (stats["a"].cantidad_indices, stats["a"].indices) == (1, "a_pkey")
    assert (stats["b"].llaves_primarias, stats["b"].indices) == ("Ninguna", "Ninguno")
    assert (stats["b"].cantidad_llaves_foraneas, stats["b"].llaves_foraneas) == (2, "id -> a.id, v -> a.v")
    assert (stats["a"].cantidad_llaves_foraneas, stats["a"].llaves_foraneas) == (0, "Ninguna")
    assert (stats["c"].cantidad_columnas, stats["c"].columnas) == (2, "id, v")
    assert stats["c"].tamaño_total.endswith("bytes") and stats["c"].tamaño_indices == "0 bytes"


def test_ties_go_to_the_first_name(spark, folder):
    top = profile.largest_tables(profile.profile(ParquetFolder(spark, folder)).stats)
    assert [(r.tabla, r.registros) for r in top.collect()] == [("e", 9), ("b", 7), ("a", 5), ("c", 5), ("d", 5)]


@pytest.mark.parametrize("execute", [False, True])
def test_unreadable_table_is_skipped(spark, folder, execute):
    with open(f"{folder}/broken.parquet", "w") as f:
        f.write("no parquet")
    done = profile.profile(ParquetFolder(spark, folder), execute=execute)
    assert done.stats.count() == 8
    assert [r.tabla for r in done.errors.collect()] == ["broken"]
    assert tuple(profile.summary(done.stats, done.errors).first()) == (9, 8, 1)


def test_table_whose_data_is_unreadable_is_skipped(spark, folder):
    """The first file, which gives the schema, is fine; a second one is not."""
    spark.range(3).coalesce(1).write.parquet(f"{folder}/part.parquet")
    with open(f"{folder}/part.parquet/zzz.parquet", "w") as f:
        f.write("no parquet at all")
    done = profile.profile(ParquetFolder(spark, folder))
    assert [r.tabla for r in done.errors.collect()] == ["part"]
    assert done.stats.count() == 8


@pytest.mark.parametrize("step", ["sizes", "catalog"])
def test_a_lookup_that_fails_for_one_table_hides_no_other(spark, folder, step):
    class Partly(ParquetFolder):
        pass

    def failing(self, names):
        if "c" in names:
            raise OSError("no such place")
        return getattr(ParquetFolder, step)(self, names)

    setattr(Partly, step, failing)
    done = profile.profile(Partly(spark, folder))
    assert [tuple(r) for r in done.errors.collect()] == [("c", "no such place")]
    assert sorted(r.tabla for r in done.stats.collect()) == ["Mixed", "a", "b", "d", "e", "f", "g"]


def test_other_failures_are_no_fault_of_a_table(spark, folder):
    class Lost(ParquetFolder):
        def row_count(self, name):
            raise RuntimeError("connection lost")

    with pytest.raises(RuntimeError):
        profile.profile(Lost(spark, folder))


def test_no_tables(spark, tmp_path):
    class Nothing(ParquetFolder):
        def names(self):
            return []

    (tmp_path / "x.parquet").mkdir()
    write(spark, tmp_path / "x.parquet" / "y", 1)
    done = profile.profile(Nothing(spark, str(tmp_path)))
    assert done.stats.count() == 0 and "registros" in done.stats.columns
    assert profile.largest_tables(done.stats).count() == 0
    assert tuple(profile.summary(done.stats, done.errors).first()) == (0, 0, 0)


def test_report(spark, folder):
    stats = profile.profile(ParquetFolder(spark, folder)).stats.filter("tabla = 'e'")
    text = profile.report(stats.withColumn("registros", F.lit(1234567))).first().detalle
    lines = text.split("\n")
    assert lines[0] == "📊 Tabla: e"
    assert lines[1] == "   • Registros: 1,234,567"
    assert lines[4] == "   • Tamaño índices: 0 bytes"
    assert lines[5:] == [
        "   • Columnas (2): id, v",
        "   • Llaves primarias: Ninguna",
        "   • Llaves foráneas (0): Ninguna",
        "   • Índices (0): Ninguno",
    ]


def test_snapshots_append_by_day(spark, folder, tmp_path):
    stats = profile.profile(ParquetFolder(spark, folder)).stats
    path = str(tmp_path / "snapshots")
    for day in ("2024-01-01", "2024-01-02"):
        append_snapshot(stats, path, F.lit(day))
    kept = spark.read.parquet(path)
    assert kept.groupBy("snapshot_date").count().count() == 2
    assert kept.filter("snapshot_date = '2024-01-02'").drop("snapshot_date").exceptAll(stats).count() == 0


def test_catalog_database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stats_test LOCATION '{tmp_path}/db'")
    try:
        for name, n in (("plain", 4), ("Order", 2)):
            write(spark, tmp_path / name, n)
            spark.sql(f"CREATE TABLE stats_test.`{name}` USING parquet LOCATION '{tmp_path}/{name}'")
        done = profile.profile(CatalogDatabase(spark, "stats_test"))
        found = {r.tabla: r for r in done.stats.collect()}
        assert {name.lower(): r.registros for name, r in found.items()} == {"plain": 4, "order": 2}
        assert all(r.bytes_total > 0 for r in found.values())
    finally:
        spark.sql("DROP DATABASE stats_test CASCADE")


def test_key_checks_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (None, None)], "k int, s string")
    row = keys.verify_key(df, "t", ["k", "s"]).first()
    assert (row.registros, row.llaves_distintas, row.registros_nulos, row.max_repeticiones, row.es_llave) == (5, 2, 2, 2, False)
    assert keys.verify_key(df.filter("s = 'a'"), "t", ["k"]).first().es_llave
    empty = keys.verify_key(df.limit(0), "t", ["k"]).first()
    assert (empty.registros, empty.max_repeticiones, empty.es_llave) == (0, 0, True)


def test_reference_checks(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (9, 9), (None, 1)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (3, 3)], "x int, y int")
    row = keys.verify_foreign_key(child, parent, ForeignKey("c", ("a", "b"), "p", ("x", "y"))).first()
    assert (row.registros, row.con_referencia, row.huerfanos, row.nulos, row.se_cumple) == (5, 3, 1, 1, False)


def test_declared_references_hold(spark, sf_dir):
    source = ParquetFolder(spark, sf_dir)
    for key in facts.FOREIGN:
        row = keys.verify_foreign_key(source.read(key.table), source.read(key.parent), key).first()
        assert row.con_referencia + row.huerfanos + row.nulos == row.registros == source.read(key.table).count()
        assert row.se_cumple
