"""Employees that look like vendors: by name and by home address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import normalize_address
from ..functions.scalars import json_text, severity
from ..operators.fuzzy_join import fuzzy_pairs
from ..params import Params
from ..session import cut


def _paid(t: dict) -> DataFrame:
    return t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(
        F.count("*").alias("payment_count"), F.sum("amount").alias("total_payments"), F.max("payment_date").alias("last_payment")
    ).where("total_payments <> 0")


def name_matches(t: dict, p: Params, vendor_id: int | None = None) -> DataFrame:
    """(employee_id, vendor_id, confidence, ...) for every similar vendor name of an employee; vendors must be paid.

    All paid vendors of one name are one row: their number, payments and sums, and the lowest of their ids. So a name
    that many employees and many vendors have makes a row per employee, not per pair. With a vendor_id only the rows
    that name this vendor are worked out: employees are compared with its name alone.
    """
    e = t["employee"].where(F.length("name_normalized") > 0).select(
        F.col("id").alias("employee_id"), F.col("name").alias("employee_name"), F.col("name_normalized").alias("left_name"))
    named = t["vendor"].where(F.length("name_normalized") > 0).select(F.col("id").alias("vendor_id"), F.col("name_normalized").alias("right_name"))
    if vendor_id is not None:
        named = named.join(named.where(F.col("vendor_id") == vendor_id).select("right_name").distinct(), "right_name", "left_semi")
    holder = named.join(_paid(t), "vendor_id").groupBy("right_name").agg(
        F.min("vendor_id").alias("vendor_id"), F.count("*").alias("vendors"), F.sum("payment_count").alias("payment_count"),
        F.sum("total_payments").alias("total_payments"), F.max("last_payment").alias("last_payment"))
    holder = cut(holder if vendor_id is None else holder.where(F.col("vendor_id") == vendor_id))
    near = fuzzy_pairs(e, "left_name", holder, "right_name", int(p.employee_vendor_name_similarity * 100))
    return e.join(near, "left_name").join(holder, "right_name").select(
        "employee_id", "employee_name", "vendor_id", "vendors", (F.col("score") / 100).alias("confidence"), "payment_count", "total_payments", "last_payment")


def name_alerts(matches: DataFrame) -> DataFrame:
    c, total = F.col("confidence"), F.col("total_payments")
    return matches.select(
        F.lit("employee_vendor_match").alias("alert_type"),
        severity("medium", ("high", ((c >= 0.95) & (total >= 100000)) | (c >= 0.98))).alias("severity"),
        F.lit("employee").alias("entity_type"), F.col("employee_id").alias("entity_id"), "employee_name", "vendor_id", "vendors",
        F.round(c, 4).alias("name_similarity"), "payment_count", "total_payments", "last_payment")


def address_sides(t: dict) -> DataFrame:
    """(address, side, id): employees and vendors at addresses that have both. Membership, not pairs."""
    raw = F.col("raw_data")
    home = normalize_address(json_text(raw, "address"), json_text(raw, "city"), json_text(raw, "state"), json_text(raw, "zip"))["normalized"]
    e = t["employee"].where(F.length(json_text(raw, "address")) > 0).select(home.alias("address"), F.lit("employee").alias("side"), "id")
    seat = normalize_address(F.col("address"), F.col("city"), F.col("state"), F.col("zip_code"))["normalized"]
    v = t["vendor"].where(F.length("address") > 0).select(seat.alias("address"), F.lit("vendor").alias("side"), "id")
    both = cut(e.unionByName(v)).where("address <> ''")
    shared = both.groupBy("address").agg(F.max(F.col("side") == "employee").alias("e"), F.max(F.col("side") == "vendor").alias("v")).where("e and v")
    return both.join(shared.select("address"), "address", "left_semi")


def address_alerts(t: dict, sides: DataFrame) -> DataFrame:
    """One row per employee whose home is a paid vendor's address, with all such vendors counted and summed."""
    at = sides.where("side = 'vendor'").select("address", F.col("id").alias("vendor_id")).join(_paid(t), "vendor_id")
    seat = at.groupBy("address").agg(F.min("vendor_id").alias("vendor_id"), F.count("*").alias("vendors"),
                                     F.sum("payment_count").alias("payment_count"), F.sum("total_payments").alias("total_payments"))
    e = sides.where("side = 'employee'").select("address", F.col("id").alias("employee_id"))
    return e.join(seat, "address").select(
        F.lit("employee_vendor_address_match").alias("alert_type"), F.lit("high").alias("severity"), F.lit("employee").alias("entity_type"),
        F.col("employee_id").alias("entity_id"), "vendor_id", F.col("address").alias("shared_address"), "vendors", "payment_count", "total_payments")


def entity_match_rows(matches: DataFrame, sides: DataFrame) -> DataFrame:
    """Rows for the entity match table; an address match names the lowest vendor id of the address."""
    low = sides.where("side = 'vendor'").groupBy("address").agg(F.min("id").alias("entity_id_2"))
    at = sides.where("side = 'employee'").join(low, "address")
    kinds = [F.lit("employee").alias("entity_type_1"), F.lit("vendor").alias("entity_type_2")]
    by_name = matches.select(*kinds, F.col("employee_id").alias("entity_id_1"), F.col("vendor_id").alias("entity_id_2"), F.lit("name").alias("match_type"),
                             F.col("confidence").alias("confidence_score"), F.to_json(F.struct("employee_name")).alias("evidence"))
    by_address = at.select(*kinds, F.col("id").alias("entity_id_1"), "entity_id_2", F.lit("address").alias("match_type"),
                           F.lit(0.85).alias("confidence_score"), F.to_json(F.struct("address")).alias("evidence"))
    return by_name.unionByName(by_address)
