"""Log of source loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("in_progress", "success", "failed")


def log_row(spark: SparkSession, source: str, run_id: int, status: str, started_at, records: int = 0, error: str | None = None, read_until=None) -> DataFrame:
    """One row to append to the log: a load that began, succeeded (having read all files older than read_until) or failed."""
    if status not in STATES:
        raise ValueError(status)
    return spark.range(1).select(
        F.lit(source).alias("source_name"), F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(status).alias("status"), F.lit(records).cast("bigint").alias("records_synced"), F.lit(error).cast("string").alias("error_message"),
        F.lit(read_until).cast("timestamp").alias("read_until"))


def last_success(log: DataFrame) -> DataFrame:
    """When each source last loaded well."""
    return log.where(F.col("status") == "success").groupBy("source_name").agg(F.max("started_at").alias("last_success"))


def read_until(log: DataFrame, source: str) -> DataFrame:
    """One row: up to when the source's files have been read by loads that succeeded; null if by none."""
    return log.where((F.col("source_name") == source) & (F.col("status") == "success")).agg(F.max("read_until").alias("read_until"))


def sources_to_load(sources: DataFrame, log: DataFrame) -> DataFrame:
    """Sources that never loaded any record successfully."""
    done = log.where((F.col("status") == "success") & (F.col("records_synced") > 0)).select("source_name").distinct()
    return sources.join(done, "source_name", "left_anti")
