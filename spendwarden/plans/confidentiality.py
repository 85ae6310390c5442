"""How much spending is marked confidential."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity, share
from ..params import Params


def _is_secret():
    return F.coalesce(F.col("is_confidential"), F.lit(False))


def _rates(df: DataFrame, key: str) -> DataFrame:
    secret = _is_secret()
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("total_count"), F.count_if(secret).alias("confidential_count"),
        F.sum("amount").alias("total_amount"),
        F.sum(F.when(secret, F.col("amount")).otherwise(0)).alias("confidential_amount"))


def _agencies(t: dict) -> DataFrame:
    return t["agency"].select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))


def high_confidentiality(t: dict, p: Params) -> DataFrame:
    """Agencies with a high share of confidential payments."""
    rate = F.col("confidential_count") / F.col("total_count")
    per = _rates(t["payment"], "agency_id").where((F.col("total_count") >= p.confidentiality_min_count) & (rate >= p.confidentiality_rate_threshold))
    return per.join(_agencies(t), "agency_id").select(
        F.lit("high_confidentiality_rate").alias("alert_type"), severity("medium", ("high", rate >= 0.40)).alias("severity"),
        F.lit("agency").alias("entity_type"), F.col("agency_id").alias("entity_id"), "agency_name", "total_count",
        "confidential_count", rate.alias("rate"), "total_amount", "confidential_amount",
        F.round(F.coalesce(share(F.col("confidential_amount"), F.col("total_amount")), F.lit(0.0)) * 100, 1).alias("confidential_amount_rate"))


def confidentiality_spikes(t: dict, p: Params) -> DataFrame:
    """Agencies whose confidential share rose against the rest of the past year; both periods in one grouping."""
    recent_from, history_from = p.as_of - dt.timedelta(days=90), p.as_of - dt.timedelta(days=365)
    d, secret = F.col("payment_date"), _is_secret()
    recent, past = d >= F.lit(recent_from), d < F.lit(recent_from)
    per = (
        t["payment"].where(F.col("agency_id").isNotNull() & (d >= F.lit(history_from))).groupBy("agency_id")
        .agg(F.count_if(recent).alias("recent_count"), F.count_if(recent & secret).alias("recent_confidential"),
             F.count_if(past).alias("history_count"), F.count_if(past & secret).alias("history_confidential"))
        .where((F.col("recent_count") >= p.confidentiality_recent_min) & (F.col("history_count") >= p.confidentiality_history_min))
    )
    r, h = F.col("recent_confidential") / F.col("recent_count"), F.col("history_confidential") / F.col("history_count")
    return per.where(r > h + p.confidentiality_spike_delta).join(_agencies(t), "agency_id").select(
        F.lit("confidentiality_spike").alias("alert_type"), severity("medium", ("high", r - h >= 0.25)).alias("severity"),
        F.lit("agency").alias("entity_type"), F.col("agency_id").alias("entity_id"), "agency_name", "recent_count",
        "recent_confidential", "history_count", "history_confidential", F.round((r - h) * 100, 1).alias("increase"))


def vendor_confidentiality(t: dict, p: Params) -> DataFrame:
    """Vendors paid mostly in confidence."""
    rate = F.col("confidential_count") / F.col("total_count")
    per = _rates(t["payment"], "vendor_id").where((F.col("total_count") >= p.vendor_confidentiality_min_count) & (rate >= p.vendor_confidentiality_rate))
    v = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    return per.join(v, "vendor_id").select(
        F.lit("vendor_high_confidentiality").alias("alert_type"),
        severity("low", ("medium", rate >= 0.75), ("high", (rate >= 0.90) & (F.col("total_amount") >= 100000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "total_count",
        "confidential_count", F.round(rate * 100, 1).alias("confidential_rate"), "total_amount")


def confidentiality_summary(t: dict) -> DataFrame:
    """One row of totals and shares."""
    secret = _is_secret()
    s = t["payment"].agg(
        F.count("*").alias("total_transactions"), F.count_if(secret).alias("confidential_transactions"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total_amount"),
        F.coalesce(F.sum(F.when(secret, F.col("amount"))), F.lit(0)).alias("confidential_amount"))
    return s.select(
        "*",
        F.round(F.coalesce(share(F.col("confidential_transactions"), F.col("total_transactions")), F.lit(0.0)) * 100, 2).alias("confidential_rate"),
        F.round(F.coalesce(share(F.col("confidential_amount"), F.col("total_amount")), F.lit(0.0)) * 100, 2).alias("confidential_amount_rate"))


def agencies_with_rate(agencies: DataFrame, findings: DataFrame) -> DataFrame:
    """Agencies with the stored rate brought up to date from high-rate findings."""
    new = findings.select(F.col("entity_id").alias("id"), F.col("rate").cast("decimal(5,4)").alias("_rate"))
    kept = F.col("confidentiality_rate") if "confidentiality_rate" in agencies.columns else F.lit(None).cast("decimal(5,4)")
    return agencies.join(new, "id", "left").withColumn("confidentiality_rate", F.coalesce("_rate", kept)).drop("_rate")
