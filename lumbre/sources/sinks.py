"""Where results go: statistics snapshots and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_RECORD = (
    "job_name string, app_name string, status string, state string, exit_code int, duration_seconds double, "
    "start_time timestamp_ntz, end_time timestamp_ntz, elapsed_seconds int, pi_value double, "
    "parameters map<string,string>"
)


def append_snapshot(stats: DataFrame, path: str, snapshot_date: Column) -> None:
    """Append table statistics under the day they were taken."""
    stats.withColumn("snapshot_date", snapshot_date.cast("date")).write.mode("append").partitionBy(
        "snapshot_date"
    ).parquet(path)


def append_run_records(records: DataFrame, path: str) -> None:
    """Append run records to the run log; columns a job does not report are null."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(RUN_RECORD)
    given = set(records.columns)
    unknown = given - set(wanted.names)
    if unknown:
        raise ValueError(f"not part of a run record: {sorted(unknown)}")
    columns = [
        (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ]
    records.select(columns).write.mode("append").parquet(path)
