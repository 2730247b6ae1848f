"""Search for references: which columns hold only values that another column holds as well.

All pairs of columns are decided by one shuffle.  Every column sends its distinct values; where equal values of a kind meet, the set of
columns that hold them is a few bits; and a column refers to those that are in all sets it is in itself.  No pair of columns is
joined, and after the shuffle there is one row per distinct set.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, FractionalType, IntegralType, StringType, TimestampNTZType, TimestampType

#: Columns whose bits share a number.
BITS = 62
KINDS = {
    IntegralType: "number",
    FractionalType: "fraction",
    DecimalType: "decimal",
    StringType: "text",
    BooleanType: "truth",
    DateType: "date",
    TimestampType: "time",
    TimestampNTZType: "local time",
}


def kind_of(type_: DataType) -> str | None:
    """Values of different kinds are never the same; nothing for nested and binary ones, which are left out."""
    if isinstance(type_, DecimalType):
        return f"decimal {type_.scale}"
    return next((kind for of, kind in KINDS.items() if isinstance(type_, of)), None)


def as_text(column: Column, type_: DataType) -> Column:
    """The same text for equal values of a kind, whatever their width."""
    if isinstance(type_, FractionalType) and not isinstance(type_, DecimalType):
        wide = column.cast("double")
        return F.when(wide == 0, "0.0").otherwise(wide.cast("string"))  # no negative zero
    return column.cast("string")


def inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``tabla, columna, tabla_referida, columna_referida, valores, valores_referidos`` of all pairs of columns of which the first one's values are all in the second one.

    Nulls refer to nothing; a column without values refers to no column.  The numbers are of distinct values.  Each table is read once.
    """
    columns = [(table, f.name, kind_of(f.dataType), f.dataType) for table, df in tables.items() for f in df.schema if kind_of(f.dataType)]
    words = -(-len(columns) // BITS)
    names = [f"_m{w}" for w in range(words)]
    held = []
    for table, df in tables.items():
        own = [(i, c) for i, c in enumerate(columns) if c[0] == table]
        if own:
            values = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), as_text(F.col(f"`{n}`"), t).alias("value")) for i, (_, n, k, t) in own))
            held.append(df.select(F.explode(values).alias("v")).select("v.*").filter("value is not null"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("i", F.lit(BITS)).cast("int"))
    marked = reduce(DataFrame.unionByName, held).select(
        "kind", "value", *(F.when(F.floor(F.col("i") / BITS) == w, bit).otherwise(F.lit(0).cast("long")).alias(n) for w, n in enumerate(names))
    )
    sets = marked.groupBy("kind", "value").agg(*(F.bit_or(n).alias(n) for n in names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))

    def has(i: Column, masks: list[str]) -> Column:
        of = reduce(lambda rest, w: F.when(F.floor(i / BITS) == w, F.col(masks[w])).otherwise(rest), range(words), F.lit(0).cast("long"))
        return F.call_function("shiftright", of, F.pmod(i, F.lit(BITS)).cast("int")).bitwiseAND(F.lit(1)) == 1

    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame([(i, t, n, k) for i, (t, n, k, _) in enumerate(columns)], "i int, tabla string, columna string, kind string")
    # Each set is listed once for every column in it; what is in all sets of a column is what it refers to.
    every = F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("i")
    of_column = sets.select("*", every).filter(has(F.col("i"), names))
    common = of_column.groupBy("i").agg(F.sum("n").alias("valores"), *(F.bit_and(n).alias(n) for n in names))
    pairs = common.select("i", "valores", *names, F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("j"))
    pairs = pairs.filter((F.col("i") != F.col("j")) & has(F.col("j"), names)).select("i", "valores", "j")
    first = listed.select("i", "tabla", "columna")
    second = listed.select(F.col("i").alias("j"), F.col("tabla").alias("tabla_referida"), F.col("columna").alias("columna_referida"))
    sizes = common.select(F.col("i").alias("j"), F.col("valores").alias("valores_referidos"))
    return pairs.join(sizes, "j").join(first, "i").join(second, "j").select(
        "tabla", "columna", "tabla_referida", "columna_referida", "valores", "valores_referidos"
    )
