"""Search for keys against trying every column set, and lookups by bound values."""

import random
from itertools import combinations

from lumbre.operators import catalog, keys


def brute_force(df, most):
    rows, found = df.collect(), []
    for size in range(1, most + 1):
        for s in combinations(df.columns, size):
            values = [tuple(r[c] for c in s) for r in rows]
            whole = all(v is not None for value in values for v in value)
            if whole and len(set(values)) == len(values) and not any(set(k) <= set(s) for k in found):
                found.append(s)
    return {(", ".join(s), len(s)) for s in found}


def test_all_minimal_keys(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(rng.randrange(60), rng.randrange(5), i % 13, rng.choice("abc"), rng.choice([1.5, None, 2.5]), i // 13) for i in range(rng.choice([20, 50]))]
        df = spark.createDataFrame(rows, "a int, `b.c` long, d int, e string, f double, g int").withColumnRenamed("b.c", "b")
        found = {(r["columnas"], r["n_columnas"]) for r in keys.minimal_keys(df, "t").collect()}
        assert found == brute_force(df, 3)


def test_screening_goes_on_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(keys, "AT_ONCE", 2)
    df = spark.createDataFrame([(i % 10, i // 10, i % 7, i) for i in range(70)], "a int, b int, c int, d int")
    assert {r["columnas"] for r in keys.minimal_keys(df, "t").collect()} == {"d", "a, b", "a, c"}


def test_empty_and_nested(spark):
    df = spark.createDataFrame([], "a int, b array<int>")
    assert [tuple(r) for r in keys.minimal_keys(df, "t").collect()] == [("t", "a", 1)]
    assert keys.minimal_keys(df.select("b"), "t").collect() == []


def test_bound_values_are_never_sql(spark):
    columns = spark.createDataFrame([("public", n, 1, "c") for n in ("plain", "o'rders", "x'; DROP TABLE y; --")], "table_schema string, table_name string, ordinal_position int, column_name string")
    for name in ("plain", "o'rders", "x'; DROP TABLE y; --"):
        assert [r["tabla"] for r in catalog.bound(spark, catalog.COLUMNS_OF, {"schema": "public", "tabla": name}, columns=columns).collect()] == [name]
    assert catalog.bound(spark, catalog.COLUMNS_OF, {"schema": "public", "tabla": "' OR '1'='1"}, columns=columns).collect() == []
