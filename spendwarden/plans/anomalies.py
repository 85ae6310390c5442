"""Odd payments: round amounts, large first payments, overspent contracts, unregistered vendors, August spending."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fiscal_year_of, severity, share, state_fiscal_year
from ..params import Params


def _vendors(t: dict, *extra: str) -> DataFrame:
    return t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"), *extra)


def round_numbers(t: dict, p: Params) -> DataFrame:
    """Vendors paid one round amount often; every amount is counted in one grouping."""
    a = F.col("amount")
    pay = t["payment"].where(F.col("vendor_id").isNotNull())
    aggs = [F.count("*").alias("total_payments")]
    for i, amt in enumerate(p.round_number_amounts):
        aggs += [F.count_if(a == amt).alias(f"n{i}"), F.sum(F.when(a == amt, a)).alias(f"s{i}")]
    per = pay.groupBy("vendor_id").agg(*aggs)
    entries = [
        F.struct(F.lit(float(amt)).alias("round_amount"), F.col(f"n{i}").alias("round_count"), F.col(f"s{i}").alias("total_round_value"))
        for i, amt in enumerate(p.round_number_amounts)
    ]
    pct = F.col("round_count") / F.col("total_payments")
    flagged = (
        per.select("vendor_id", "total_payments", F.inline(F.array(*entries)))
        .where((F.col("round_count") >= p.round_number_min_count) & (pct >= p.round_number_min_share))
    )
    return flagged.join(_vendors(t), "vendor_id").select(
        F.lit("round_number_payments").alias("alert_type"),
        severity("low", ("medium", (pct >= 0.5) | (F.col("total_round_value") >= 500000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "round_amount",
        "round_count", "total_payments", F.round(pct * 100, 1).alias("round_percentage"), "total_round_value")


def large_first_payments(t: dict, p: Params) -> DataFrame:
    """Large payments on a new vendor's first payment date."""
    dated = t["payment"].where(F.col("vendor_id").isNotNull() & F.col("payment_date").isNotNull())
    first = dated.groupBy("vendor_id").agg(F.min("payment_date").alias("payment_date"))
    large = dated.where(F.col("amount") >= p.new_vendor_large_payment).select("id", "vendor_id", "payment_date", "amount", "agency_id")
    cutoff = p.as_of - dt.timedelta(days=p.new_vendor_days)
    new = _vendors(t, "first_seen", "in_cmbl").where(F.col("first_seen").isNull() | (F.col("first_seen") >= F.lit(cutoff)))
    return large.join(first, ["vendor_id", "payment_date"]).join(new, "vendor_id").select(
        F.lit("large_first_payment").alias("alert_type"),
        severity("medium", ("high", F.col("amount") >= 500000)).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name",
        F.col("id").alias("payment_id"), "amount", "payment_date", "first_seen", "in_cmbl", "agency_id")


def over_contract_payments(t: dict, p: Params) -> DataFrame:
    """Payments of a vendor and agency above a contract's maximum; a missing agency pairs with a missing agency."""
    paid = t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id", "agency_id").agg(F.sum("amount").alias("total_payments"))
    c = t["contract"].where((F.col("max_value") > 0) & F.col("vendor_id").isNotNull()).select(
        F.col("id").alias("contract_id"), "contract_number", F.col("vendor_id").alias("c_vendor"),
        F.col("agency_id").alias("c_agency"), "max_value")
    excess = F.col("total_payments") - F.col("max_value")
    over = c.join(paid, (F.col("c_vendor") == F.col("vendor_id")) & F.col("c_agency").eqNullSafe(F.col("agency_id"))).where(excess > 0)
    return over.select(
        F.lit("over_contract_payment").alias("alert_type"),
        severity("medium", ("high", (excess * 2 >= F.col("max_value")) | (excess >= 100000))).alias("severity"),
        F.lit("contract").alias("entity_type"), F.col("contract_id").alias("entity_id"), "contract_number", "vendor_id",
        "agency_id", "max_value", "total_payments", excess.alias("excess_amount"),
        F.round(share(excess, F.col("max_value")) * 100, 1).alias("excess_percentage"))


def unlisted_vendors(t: dict, p: Params) -> DataFrame:
    """Well-paid vendors missing from the bidder list."""
    paid = t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(
        F.sum("amount").alias("total_payments"), F.count("*").alias("payment_count"))
    v = _vendors(t, "address", "in_cmbl").where(~F.col("in_cmbl"))
    return paid.where(F.col("total_payments") >= p.simple_ghost_min_total).join(v, "vendor_id").select(
        F.lit("ghost_vendor").alias("alert_type"),
        severity("medium", ("high", F.col("total_payments") >= 500000)).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "total_payments",
        "payment_count", "address")


def august_spikes(t: dict, p: Params) -> DataFrame:
    """Agencies that spend a large part of a fiscal year in August; five closed years in one grouping."""
    now, d = fiscal_year_of(p.as_of), F.col("payment_date")
    fy = state_fiscal_year(d)
    per = (
        t["payment"].where(F.col("agency_id").isNotNull() & d.between(F.lit(dt.date(now - 6, 9, 1)), F.lit(dt.date(now - 1, 8, 31))))
        .groupBy("agency_id", fy.alias("fiscal_year"))
        .agg(F.sum(F.when(F.month(d) == 8, F.col("amount")).otherwise(0)).alias("august_spending"),
             F.sum("amount").alias("fy_total_spending"))
    )
    pct = share(F.col("august_spending"), F.col("fy_total_spending"))
    agencies = t["agency"].select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))
    return per.where(pct >= p.august_share).join(agencies, "agency_id").select(
        F.lit("fy_end_spike").alias("alert_type"), severity("low", ("medium", pct >= 0.35)).alias("severity"),
        F.lit("agency").alias("entity_type"), F.col("agency_id").alias("entity_id"), "agency_name", "fiscal_year",
        "august_spending", "fy_total_spending", F.round(pct * 100, 1).alias("august_percentage"))
