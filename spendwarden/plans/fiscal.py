"""Spending bunched at the end of the fiscal year."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_places, fiscal_year_of, severity, share, state_fiscal_year
from ..params import Params


def _closed_years(t: dict, p: Params, years: int, key: str) -> DataFrame:
    now, d = fiscal_year_of(p.as_of), F.col("payment_date")
    return (
        t["payment"].where(F.col(key).isNotNull() & d.between(F.lit(dt.date(now - years - 1, 9, 1)), F.lit(dt.date(now - 1, 8, 31))))
        .withColumn("fiscal_year", state_fiscal_year(d))
    )


def _months_sum(*months: int):
    return F.sum(F.when(F.month("payment_date").isin(*months), F.col("amount")).otherwise(0))


def _agencies(t: dict) -> DataFrame:
    return t["agency"].select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))


def spending_rush(t: dict, p: Params) -> DataFrame:
    """Agencies whose July and August outrun the monthly average of the first ten months."""
    per = _closed_years(t, p, 5, "agency_id").groupBy("agency_id", "fiscal_year").agg(
        F.sum("amount").alias("fy_total"), _months_sum(7, 8).alias("final_months"), _months_sum(7).alias("july"),
        _months_sum(8).alias("august"), F.count("*").alias("payment_count"))
    average = (F.col("fy_total") - F.col("final_months")).cast("double") / 10
    final_ratio, august_ratio = F.col("final_months").cast("double") / average, F.col("august").cast("double") / average
    pct = share(F.col("final_months"), F.col("fy_total"))
    rush = per.where((F.col("fy_total") != 0) & (F.col("fy_total") > F.col("final_months"))).where(
        ((final_ratio >= p.fy_end_spike_multiplier) | (august_ratio >= p.fy_end_spike_multiplier))
        & (F.col("final_months") >= p.fy_end_min_amount))
    return rush.join(_agencies(t), "agency_id").select(
        F.lit("fiscal_year_spending_rush").alias("alert_type"),
        severity("medium", ("high", (august_ratio >= p.fy_end_spike_multiplier * 1.5) | (pct >= 0.35))).alias("severity"),
        F.lit("agency").alias("entity_type"), F.col("agency_id").alias("entity_id"), "agency_name", "fiscal_year", "fy_total",
        "final_months", "july", "august", "payment_count", F.round(final_ratio, 2).alias("final_months_ratio"),
        F.round(august_ratio, 2).alias("august_ratio"))


def vendor_year_end(t: dict, p: Params) -> DataFrame:
    """Vendors paid mostly in July and August."""
    late = F.month("payment_date").isin(7, 8)
    per = _closed_years(t, p, 3, "vendor_id").groupBy("vendor_id", "fiscal_year").agg(
        F.sum("amount").alias("fy_total"), _months_sum(7, 8).alias("final_months"), F.count("*").alias("payment_count"),
        F.count_if(late).alias("final_months_count"))
    pct = share(F.col("final_months"), F.col("fy_total"))
    v = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    return per.where((F.col("fy_total") >= p.fy_vendor_min_total) & (pct >= p.fy_vendor_share)).join(v, "vendor_id").select(
        F.lit("vendor_fy_end_concentration").alias("alert_type"),
        severity("medium", ("high", (pct >= 0.9) | (F.col("final_months") >= 500000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "fiscal_year", "fy_total",
        "final_months", "payment_count", "final_months_count", F.round(pct * 100, 1).alias("final_months_percentage"))


def _last_days(t: dict, p: Params) -> DataFrame:
    d = F.col("payment_date")
    return _closed_years(t, p, 5, "agency_id").where((F.month(d) == 8) & (F.day(d) >= 27))


def year_end_clusters(t: dict, p: Params) -> DataFrame:
    """Agencies with heavy payments from 27 to 31 August."""
    per = _last_days(t, p).groupBy("agency_id", "fiscal_year").agg(
        F.sum("amount").alias("final_days_total"), F.count("*").alias("payment_count"), F.count_distinct("vendor_id").alias("vendor_count"))
    return per.where(F.col("final_days_total") >= p.fy_end_min_amount).join(_agencies(t), "agency_id").select(
        F.lit("fy_end_payment_cluster").alias("alert_type"),
        severity("medium", ("high", (F.col("final_days_total") >= 1000000) | (F.col("payment_count") >= 50))).alias("severity"),
        F.lit("agency").alias("entity_type"), F.col("agency_id").alias("entity_id"), "agency_name", "fiscal_year",
        "final_days_total", "payment_count", "vendor_count")


def year_end_top_vendors(t: dict, p: Params, k: int | None = None) -> DataFrame:
    """The vendors paid in those days by amount, per agency and year with a finding, all or the first k."""
    per = _last_days(t, p).where(F.col("vendor_id").isNotNull()).groupBy("agency_id", "fiscal_year", "vendor_id").agg(F.sum("amount").alias("amount"))
    w = Window.partitionBy("agency_id", "fiscal_year").orderBy(F.desc("amount"), "vendor_id")
    found = year_end_clusters(t, p).select(F.col("entity_id").alias("agency_id"), "fiscal_year")
    top = first_places(per.withColumn("place", F.row_number().over(w)), k)
    return top.join(found, ["agency_id", "fiscal_year"], "left_semi")
