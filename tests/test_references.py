"""Search for references against comparing every pair of columns."""

import random

from lumbre.operators import references


def brute_force(tables):
    found = set()
    values = {(t, c): {r[c] for r in df.select(c).collect()} - {None} for t, df in tables.items() for c in df.columns}
    kinds = {(t, f.name): references.kind_of(f.dataType) for t, df in tables.items() for f in df.schema}
    for a, x in values.items():
        for b, y in values.items():
            if a != b and kinds[a] == kinds[b] and x and x <= y:
                found.add((*a, *b, len(x), len(y)))
    return found


def test_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    tables = {}
    for t in range(4):
        rows = [(rng.randrange(3 + 2 * t), rng.randrange(4), rng.choice(["0", "1", "x", None]), rng.choice([0.0, -0.0, 1.5]), None) for _ in range(12)]
        tables[f"t{t}"] = spark.createDataFrame(rows, "a int, b long, c string, d double, e int")
    tables["empty"] = tables["t0"].limit(0)
    want = brute_force(tables)
    assert {tuple(r) for r in references.inclusions(tables).collect()} == want and len(want) > 10
    monkeypatch.setattr(references, "BITS", 3)  # columns over several numbers
    assert {tuple(r) for r in references.inclusions(tables).collect()} == want


def test_odd_names_and_nested_columns(spark):
    tables = {"p": spark.createDataFrame([(1, [1]), (2, [2])], "`a.b` int, n array<int>"), "q": spark.createDataFrame([(1,)], "value smallint")}
    assert [tuple(r) for r in references.inclusions(tables).collect()] == [("q", "value", "p", "a.b", 1, 2)]
