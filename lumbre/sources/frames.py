"""Small driver-built relations (catalog rows, declared keys) with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_frame(spark: SparkSession, schema: str, rows: Iterable[Sequence]) -> DataFrame:
    """Rows as a local relation.  For metadata: its size is that of a catalog, never that of the data."""
    struct = StructType.fromDDL(schema)
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], struct)
    columns = [
        pa.array(list(values), type=field.type)
        for values, field in zip(zip(*rows, strict=True), to_arrow_schema(struct), strict=True)
    ]
    return spark.createDataFrame(pa.table(columns, names=struct.names), struct)
