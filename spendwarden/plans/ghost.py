"""Paid vendors that look unreal: not registered, no usable address, suspicious address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import red_flag_texts
from ..functions.scalars import severity
from ..params import Params


def _missing(c: str):
    return F.col(c).isNull() | (F.col(c) == "")


def _flags(*pairs):
    return F.array_compact(F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for text, cond in pairs]))


def _paid(t: dict, p: Params, vendors: DataFrame, *extra) -> DataFrame:
    """Totals per vendor, filtered, joined to the vendors of interest."""
    per = (
        t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id")
        .agg(F.sum("amount").alias("total_payments"), F.count("*").alias("payment_count"), *extra)
        .where(F.col("total_payments") >= p.ghost_vendor_min_payment)
    )
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("vendor_id").alias("vendor_vid"), F.col("name").alias("vendor_name"),
                       "address", "city", "state", "zip_code", "phone", "in_cmbl")
    return per.join(v, "vendor_id")


def ghost_vendors(t: dict, p: Params) -> DataFrame:
    """Paid vendors missing from the bidder list, with the further flags they show."""
    paid = _paid(t, p, t["vendor"].where(~F.col("in_cmbl")), F.count_distinct("agency_id").alias("agency_count"),
                 F.min("payment_date").alias("first_payment"), F.max("payment_date").alias("last_payment"))
    flags = _flags(
        ("No state vendor ID", _missing("vendor_vid")),
        ("Incomplete address", _missing("address") | _missing("city") | _missing("state")),
        ("No phone number", _missing("phone")),
        (F.format_string("Payments from %d different agencies", "agency_count"), F.col("agency_count") >= 3))
    return paid.withColumn("red_flags", flags).select(
        F.lit("ghost_vendor").alias("alert_type"),
        severity("medium", ("high", (F.col("total_payments") >= 500000) | (F.size("red_flags") >= 3))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "total_payments",
        "payment_count", "agency_count", "first_payment", "last_payment", "red_flags")


def incomplete_addresses(t: dict, p: Params) -> DataFrame:
    """Registered paid vendors whose address lacks parts."""
    short = F.length("address") < 5
    bad = t["vendor"].where(F.col("in_cmbl") & (F.col("address").isNull() | short | F.col("city").isNull() | F.col("state").isNull()))
    missing = _flags(("street address", _missing("address") | short), ("city", _missing("city")),
                     ("state", _missing("state")), ("ZIP code", _missing("zip_code")))
    return _paid(t, p, bad).withColumn("missing_fields", missing).select(
        F.lit("incomplete_vendor_address").alias("alert_type"),
        severity("medium", ("high", (F.col("total_payments") >= 100000) | (F.size("missing_fields") >= 3))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "total_payments",
        "payment_count", "missing_fields")


def suspicious_addresses(t: dict, p: Params) -> DataFrame:
    """Paid vendors whose address is a mail box or a filler."""
    total = F.col("total_payments")
    marked = t["vendor"].where(F.size(red_flag_texts(F.col("address"))) > 0)
    found = _paid(t, p, marked).withColumn("patterns", red_flag_texts(F.col("address")))
    box = F.exists("patterns", lambda x: F.contains(x, F.lit("box"))) & (total >= 250000)
    extra = _flags(("Large payments to PO Box address", box), ("Very short address", F.length("address") < 10))
    return found.withColumn("red_flags", F.concat("patterns", extra)).select(
        F.lit("suspicious_vendor_address").alias("alert_type"),
        severity("low", ("medium", total >= 100000), ("high", (total >= 500000) | (F.size("red_flags") >= 3))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "total_payments",
        "payment_count", "address", "red_flags")
