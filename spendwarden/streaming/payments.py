"""Payments as a stream: landing, exact and near duplicates with the batch rules' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Params


def duplicate_stream(payments: DataFrame, p: Params, delay: str = "7 days") -> DataFrame:
    """Same vendor, amount and day more than once; a day is closed when the watermark passes it."""
    counted = (
        payments.where(F.col("vendor_id").isNotNull() & (F.col("amount") > p.duplicate_min_amount))
        .withWatermark("paid_at", delay).groupBy(F.window("paid_at", "1 day"), "vendor_id", "amount").agg(F.count("*").alias("duplicate_count"))
    )
    return counted.where("duplicate_count > 1").select("vendor_id", "amount", F.col("window.start").cast("date").alias("payment_date"), "duplicate_count")


def near_duplicate_stream(payments: DataFrame, p: Params, delay: str = "7 days") -> DataFrame:
    """Runs of equal payments whose gaps stay within the window; a run is closed when the watermark passes it."""
    gap = f"{p.duplicate_payment_window_days} days"
    runs = (
        payments.where(F.col("vendor_id").isNotNull() & (F.col("amount") >= p.near_duplicate_min_amount)).withWatermark("paid_at", delay)
        .groupBy(F.session_window("paid_at", gap), "vendor_id", "amount")
        .agg(F.count("*").alias("payment_count"), F.min("paid_at").cast("date").alias("first_date"), F.max("paid_at").cast("date").alias("last_date"))
    )
    return runs.where("first_date < last_date").select("vendor_id", "amount", "payment_count", "first_date", "last_date")


def land_within(stream: DataFrame, path: str, checkpoint: str, key: str = "id", arrived: str = "arrived_at", delay: str = "7 days") -> StreamingQuery:
    """Append payments, each key once, where a payment is sent again within delay of its arrival at most.

    Only the keys of that span are kept in state; nothing that has landed is read again. The clock is the arrival, not the
    payment's own date, so payments of any date land. Each batch owns one folder, so a repeated batch replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    fresh = stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append payments not landed before, however long ago that was; for that the keys of all that has landed are read.

    Each batch owns one folder, so a repeated batch replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            seen = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = None
        if seen is not None:
            fresh = fresh.join(seen.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
