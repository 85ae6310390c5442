"""Payments made twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity
from ..params import Params


def _vendors(t: dict) -> DataFrame:
    return t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))


def exact_duplicates(t: dict, p: Params) -> DataFrame:
    """Same vendor, amount and date (a missing date is a date) more than once."""
    n, a = F.col("duplicate_count"), F.col("amount")
    groups = (
        t["payment"].where(F.col("vendor_id").isNotNull() & (a > p.duplicate_min_amount))
        .groupBy("vendor_id", "amount", "payment_date")
        .agg(F.count("*").alias("duplicate_count"), F.count_distinct("agency_id").alias("agencies"))
        .where(n > 1)
    )
    return groups.join(_vendors(t), "vendor_id").select(
        F.lit("duplicate_payment").alias("alert_type"),
        severity("low", ("medium", (n >= 3) | (a >= 10000)), ("high", (n >= 5) | (a >= 50000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "amount",
        "payment_date", "duplicate_count", (a * n).alias("total_duplicate_amount"), "agencies")


def exact_duplicate_payments(t: dict, findings: DataFrame) -> DataFrame:
    """The payments behind exact duplicates, one row each."""
    pay = t["payment"]
    f = findings.select(F.col("entity_id").alias("f_vendor"), F.col("amount").alias("f_amount"), F.col("payment_date").alias("f_date"))
    cond = (pay["vendor_id"] == f["f_vendor"]) & (pay["amount"] == f["f_amount"]) & pay["payment_date"].eqNullSafe(f["f_date"])
    return pay.join(f, cond, "left_semi").select("vendor_id", "amount", "payment_date", "id", "agency_id", "description", "source_system")


def _chained_days(t: dict, p: Params) -> DataFrame:
    """One row per vendor, amount and day, numbered by run of days whose gaps stay within the window.

    Payments of one day are counted before the shuffle, so a group never holds more rows than there are days.
    """
    days = (
        t["payment"]
        .where(F.col("vendor_id").isNotNull() & (F.col("amount") >= p.near_duplicate_min_amount) & F.col("payment_date").isNotNull())
        .groupBy("vendor_id", "amount", "payment_date").agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("vendor_id", "amount").orderBy("payment_date")
    gap = F.datediff("payment_date", F.lag("payment_date").over(w))
    new = F.when(gap <= p.duplicate_payment_window_days, 0).otherwise(1)
    return days.withColumn("new", new).withColumn("run", F.sum("new").over(w)).drop("new")


def near_duplicates(t: dict, p: Params) -> DataFrame:
    """Same vendor and amount on different days, each within the window of the one before."""
    n = F.col("payment_count")
    runs = (
        _chained_days(t, p).groupBy("vendor_id", "amount", "run")
        .agg(F.sum("n").alias("payment_count"), F.count("*").alias("days"),
             F.min("payment_date").alias("first_date"), F.max("payment_date").alias("last_date"))
        .where("days > 1")
    )
    return runs.join(_vendors(t), "vendor_id").select(
        F.lit("near_duplicate_payment").alias("alert_type"),
        severity("low", ("medium", n >= 4), ("high", (n >= 6) | (F.col("amount") >= 25000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "amount",
        "payment_count", "days", "first_date", "last_date", (F.col("amount") * n).alias("total_amount"))


def near_duplicate_payments(t: dict, p: Params) -> DataFrame:
    """The payments of every run, one row each with the run's first date."""
    w = Window.partitionBy("vendor_id", "amount", "run")
    days = (
        _chained_days(t, p).withColumn("days", F.count("*").over(w)).withColumn("first_date", F.min("payment_date").over(w))
        .where("days > 1").select("vendor_id", "amount", "payment_date", "first_date")
    )
    return t["payment"].join(days, ["vendor_id", "amount", "payment_date"]).select(
        "vendor_id", "amount", "first_date", "payment_date", "id", "agency_id")


def related_vendor_duplicates(t: dict, p: Params, members: DataFrame) -> DataFrame:
    """Vendors at one address paid the same amount within the window.

    members: (address, vendor_id) of the shared addresses. One row per vendor, amount and day on which the vendor was
    paid it, against the payments of vendors with higher ids at the address, of which the highest id is named. Dates
    are compared per address, amount and day, so no pairs of vendors are built.
    """
    w_days = p.duplicate_payment_window_days
    pay = t["payment"].where(F.col("amount") >= p.related_duplicate_min_amount).select("vendor_id", "amount", "payment_date")
    at = members.select("address", "vendor_id").join(pay, "vendor_id")
    mine = at.distinct()
    day = F.datediff(F.col("payment_date"), F.lit("1970-01-01"))
    per_day = (
        at.groupBy("address", "amount", "payment_date").agg(F.max("vendor_id").alias("top"))
        .withColumn("day", day)
    )
    near = Window.partitionBy("address", "amount", F.col("day").isNull()).orderBy("day").rangeBetween(-w_days, w_days)
    whole = Window.partitionBy("address", "amount")
    reach = per_day.select(
        "address", "amount", "payment_date",
        F.when(F.col("day").isNull(), F.max("top").over(whole)).otherwise(
            F.greatest(F.max("top").over(near), F.max(F.when(F.col("day").isNull(), F.col("top"))).over(whole))
        ).alias("related_vendor_id"))
    m, r = mine.alias("m"), reach.alias("r")
    cond = [F.col("m.address") == F.col("r.address"), F.col("m.amount") == F.col("r.amount"),
            F.col("m.payment_date").eqNullSafe(F.col("r.payment_date"))]
    return (
        m.join(r, cond).where(F.col("r.related_vendor_id") > F.col("m.vendor_id"))
        .select(F.lit("related_vendor_duplicate").alias("alert_type"), F.lit("medium").alias("severity"),
                F.lit("vendor").alias("entity_type"), F.col("m.vendor_id").alias("entity_id"),
                F.col("r.related_vendor_id").alias("related_vendor_id"), F.col("m.amount").alias("amount"),
                F.col("m.payment_date").alias("payment_date"), F.col("m.address").alias("shared_address"))
    )
