"""Key checks over the rows themselves, for sources whose catalog declares or enforces nothing."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.operators.references import kind_of
from lumbre.sources.catalog import ForeignKey
from lumbre.sources.frames import small_frame

#: Relative deviation of the screening by sketches, and how many deviations a key may lie below the number of rows.
DEVIATION, DEVIATIONS = 0.02, 6
#: Column sets screened in one pass over the table, and sets checked at the same time.
AT_ONCE, JOBS = 40, 8


def verify_key(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One row: is ``columns`` unique and never null in ``df``?

    Rows are counted per key before the shuffle, so a key that holds a large part of the table costs one row per
    task, and only the key columns are read.
    """
    missing = F.lit(False)
    for column in columns:
        missing = missing | F.col(column).isNull()
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    whole = F.when(~missing, F.col("n"))
    checked = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("registros"),
        F.count(whole).alias("llaves_distintas"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("registros_nulos"),
        F.coalesce(F.max(whole), F.lit(0)).alias("max_repeticiones"),
    )
    return checked.select(
        F.lit(table).alias("tabla"),
        F.lit(", ".join(columns)).alias("columnas"),
        "registros",
        "llaves_distintas",
        "registros_nulos",
        "max_repeticiones",
        ((F.col("max_repeticiones") <= 1) & (F.col("registros_nulos") == 0)).alias("es_llave"),
    )


def verify_foreign_key(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """One row: how many rows of ``child`` have, lack or do not use a counterpart in ``parent``.

    The child is reduced to one row per key value first; what is joined is at most one row per distinct key on
    either side, whatever the skew of the rows.  A key with a null column refers to nothing and is no orphan.
    """
    names = [f"k{i}" for i in range(len(key.columns))]
    values = child.groupBy(*(F.col(c).alias(n) for c, n in zip(key.columns, names, strict=True))).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = (
        parent.select(*(F.col(c).alias(n) for c, n in zip(key.parent_columns, names, strict=True)))
        .distinct()
        .withColumn("known", F.lit(True))
    )
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    found = F.coalesce(F.col("known"), F.lit(False))

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    checked = values.join(known, names, "left").agg(
        rows_where(F.lit(True)).alias("registros"),
        rows_where(~missing & found).alias("con_referencia"),
        rows_where(~missing & ~found).alias("huerfanos"),
        rows_where(missing).alias("nulos"),
    )
    return checked.select(
        F.lit(key.table).alias("tabla"),
        F.lit(
            ", ".join(
                f"{c} -> {key.parent}.{p}" for c, p in zip(key.columns, key.parent_columns, strict=True)
            )
        ).alias("llave_foranea"),
        "registros",
        "con_referencia",
        "huerfanos",
        "nulos",
        (F.col("huerfanos") == 0).alias("se_cumple"),
    )


def _distinct(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> list[int]:
    """About how many different values each column set has; some sets per pass, one small sketch per set and task."""
    found: list[int] = []
    for first in range(0, len(sets), AT_ONCE):
        some = sets[first : first + AT_ONCE]
        sketches = [F.approx_count_distinct(F.xxhash64(*(F.col(f"`{c}`") for c in s)), DEVIATION).alias(f"d{i}") for i, s in enumerate(some)]
        found.extend(df.agg(*sketches).first())
    return found


def is_unique(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether no two rows agree on the columns; ends with the first group that has two."""
    return df.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def minimal_keys(df: DataFrame, table: str, most: int = 3) -> DataFrame:
    """``tabla, columnas, n_columnas``: all sets of up to ``most`` columns that are unique and never null, without those that hold a smaller one.

    Level by level: a set is looked at only if no part of it is a key already and the numbers of different values of its columns multiply to
    as many as there are rows.  Sketches screen a whole level in a few passes, and what they leave is checked exactly.  Columns with nulls, and
    nested ones, are in no key.  In a table without rows every single column is a key.
    """
    names = [f.name for f in df.schema if kind_of(f.dataType)]
    spark, schema = df.sparkSession, "tabla string, columnas string, n_columnas int"
    if not names:
        return small_frame(spark, schema, [])
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names))).first()
    rows = counted[0]
    names = [c for c, n in zip(names, counted[1:], strict=True) if n == rows]
    enough = rows * (1 - DEVIATIONS * DEVIATION)
    values = dict(zip(names, _distinct(df, [(c,) for c in names]), strict=True)) if names else {}
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        sets = [s for s in sets if _product(values[c] * (1 + DEVIATIONS * DEVIATION) for c in s) >= rows]
        about = [values[s[0]] for s in sets] if size == 1 else _distinct(df, sets)
        left = [s for s, n in zip(sets, about, strict=True) if n >= enough]
        with ThreadPoolExecutor(JOBS) as pool:  # each check is a job of its own, and ends by itself
            keys += [s for s, holds in zip(left, pool.map(lambda s: is_unique(df, s), left), strict=True) if holds]
    return small_frame(spark, schema, [(table, ", ".join(k), len(k)) for k in keys])


def _product(numbers) -> float:
    total = 1.0
    for number in numbers:
        total *= number
    return total
