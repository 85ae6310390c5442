"""Contracts kept just under an approval threshold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity
from ..params import Params


def _in_band(contracts: DataFrame, low: float, high: float, since: dt.date | None = None) -> DataFrame:
    hit = contracts.where(F.col("current_value").between(low, high) & F.col("vendor_id").isNotNull())
    return hit if since is None else hit.where(F.col("start_date") >= F.lit(since))


def _split_groups(t: dict, p: Params, low: float, high: float, base: str) -> DataFrame:
    since = p.as_of - dt.timedelta(days=p.contract_splitting_months * 30)
    v = F.col("current_value").cast("double")
    groups = (
        _in_band(t["contract"], low, high, since)
        .groupBy("vendor_id", "agency_id")
        .agg(F.count("*").alias("contract_count"), F.sum("current_value").alias("total_value"),
             F.avg("current_value").alias("avg_value"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"))
        .where(F.col("contract_count") >= p.contract_splitting_count)
    )
    cv = F.when(F.col("contract_count") > 1, F.when(F.col("_mean") > 0, F.col("_sd") / F.col("_mean")).otherwise(1.0))
    uniform = (cv < 0.1) & (F.col("contract_count") >= 5)
    vendors = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    agencies = t["agency"].select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))
    return (
        groups.withColumn("coefficient_of_variation", F.round(cv, 3))
        .withColumn("severity", severity(base, ("high", uniform)))
        .join(vendors, "vendor_id").join(agencies, "agency_id", "left")
        .select(F.lit("contract_splitting").alias("alert_type"), "severity", F.lit("vendor").alias("entity_type"),
                F.col("vendor_id").alias("entity_id"), "vendor_name", "agency_id",
                F.coalesce("agency_name", F.lit("Unknown")).alias("agency_name"), "contract_count", "total_value",
                "avg_value", "coefficient_of_variation", F.lit(float(high)).alias("threshold"))
    )


def contract_splitting(t: dict, p: Params) -> DataFrame:
    """Vendor and agency pairs with several contracts just under the main threshold."""
    return _split_groups(t, p, p.contract_splitting_min, p.contract_splitting_max, "high")


def contract_splitting_small(t: dict, p: Params) -> DataFrame:
    """The same under the small-purchase threshold; uniform larger groups rank high, each row by itself."""
    return _split_groups(t, p, p.esbd_threshold - p.esbd_band, p.esbd_threshold, "medium")


def splitting_contracts(t: dict, p: Params, findings: DataFrame, low: float, high: float) -> DataFrame:
    """The contracts behind splitting findings, one row each."""
    since = p.as_of - dt.timedelta(days=p.contract_splitting_months * 30)
    keys = findings.select(F.col("entity_id").alias("f_vendor"), F.col("agency_id").alias("f_agency"))
    c = _in_band(t["contract"], low, high, since)
    return c.join(keys, (c["vendor_id"] == F.col("f_vendor")) & c["agency_id"].eqNullSafe(F.col("f_agency")), "left_semi").select(
        "vendor_id", "agency_id", "contract_number", "current_value", "start_date", "description")


def alert_contracts(alerts: DataFrame, contracts: DataFrame, p: Params) -> DataFrame:
    """(alert_id, contract_number, current_value): the contracts behind stored splitting alerts.

    Vendor, agency and threshold are the alert's own; an alert without a threshold is one of the main threshold.
    """
    high = F.coalesce(F.get_json_object("evidence", "$.threshold").try_cast("double"), F.lit(float(p.contract_splitting_max)))
    band = F.when(high == float(p.esbd_threshold), float(p.esbd_band)).otherwise(float(p.contract_splitting_max - p.contract_splitting_min))
    a = alerts.where(F.col("alert_type") == "contract_splitting").select(
        F.col("id").alias("alert_id"), F.col("entity_id").alias("_vendor"), F.get_json_object("evidence", "$.agency_id").try_cast("bigint").alias("_agency"),
        (high - band).alias("_low"), high.alias("_high"))
    since = p.as_of - dt.timedelta(days=p.contract_splitting_months * 30)
    c = contracts.where((F.col("start_date") >= F.lit(since)) & F.col("vendor_id").isNotNull())
    own = (c["vendor_id"] == a["_vendor"]) & c["agency_id"].eqNullSafe(a["_agency"]) & c["current_value"].cast("double").between(a["_low"], a["_high"])
    return c.join(a, own).select("alert_id", "contract_number", "current_value")


def splitting_candidates(t: dict, min_contracts: int = 2, threshold: float = 50000, buffer: float = 5000) -> DataFrame:
    """Vendors by number of contracts just under a threshold, without a date window."""
    per = (
        _in_band(t["contract"], threshold - buffer, threshold).groupBy("vendor_id")
        .agg(F.count("*").alias("contract_count"), F.sum("current_value").alias("total_value"))
        .where(F.col("contract_count") >= min_contracts)
    )
    v = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"), F.col("vendor_id").alias("vendor_vid"))
    return per.join(v, "vendor_id").orderBy(F.desc("contract_count"), "vendor_id")
