"""From landed files to alerts in one call per step."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.resolve import link_vendors, resolve_agencies, resolve_vendors, surrogate_id
from .operators.tables import insert_absent, update_in
from .params import Params
from .plans import alerts, employee_match, engine
from .schema import KEYS, conform, read_tables, write_table
from .session import cut

RULE_TABLES = ("vendor", "payment", "contract", "agency", "employee", "contribution", "tax_permit", "debarred", "alert", "entity_match")


def load_contracts(mapped: DataFrame, t: dict, as_of: dt.date, by_code: bool = False) -> dict:
    """Mapped contract rows to ids and into the contract table; returns the changed tables."""
    rows, vendor = resolve_vendors(cut(mapped), t["vendor"], as_of)
    agency = t["agency"]
    if "agency_name" in rows.columns:
        rows, agency = resolve_agencies(rows, agency, by_code)
    rows = rows.withColumn("id", surrogate_id(F.lit("contract"), F.col("contract_number")))
    return {"contract": insert_absent(t["contract"], conform(rows, "contract"), ["contract_number"], F.col("id")), "vendor": vendor, "agency": agency}


def load_payments(mapped: DataFrame, t: dict, as_of: dt.date) -> dict:
    """Mapped payment rows to ids and into the payment table; rows with a known source id are left out."""
    rows, vendor = resolve_vendors(cut(mapped), t["vendor"], as_of)
    rows, agency = resolve_agencies(rows, t["agency"])
    key = F.coalesce("source_id", F.to_json(F.struct("vendor_name", "agency_name", "amount", "payment_date", "_pos")))
    rows = conform(rows.withColumn("id", surrogate_id(F.lit("payment"), F.col("source_system"), key)), "payment")
    return {"payment": insert_absent(t["payment"], rows, ["id"], F.col("id")), "vendor": vendor, "agency": agency}


def load_bids(mapped: DataFrame, t: dict) -> DataFrame:
    """Bids with a link to a known vendor; vendors are not created."""
    rows = link_vendors(mapped, t["vendor"], "contractor_name")
    return conform(rows.withColumn("id", surrogate_id(F.lit("bid"), F.col("project_id"), F.col("contractor_normalized"))), "construction_bid")


def write_learned(spark: SparkSession, root: str, shared: dict, found: DataFrame | None) -> dict[str, int]:
    """Relationships, address members, employee matches and agency rates into their tables; returns changed rows per table.

    Of two scores for a pair the higher one stays, and its evidence. Results of rules that failed are left out.
    """
    out = {}

    def put(name: str, rows: DataFrame, order: str, **how) -> None:
        out[name] = update_in(spark, root, name, rows, KEYS.get(name, ["id"]), F.col(order), **how)

    if "sequential" in shared:
        put("vendor_relationship", shared["sequential"].drop("first_vendor"), "confidence_score", score="confidence_score")
    if "names" in shared:
        put("name_relationship", shared["names"], "confidence_score", score="confidence_score")
    if "members" in shared:
        put("address_member", shared["members"], "vendors")
    if "employee_names" in shared and "sides" in shared:
        rows = employee_match.entity_match_rows(shared["employee_names"], shared["sides"]).withColumn("is_confirmed", F.lit(False))
        put("entity_match", rows, "confidence_score", score="confidence_score", keep_always=("is_confirmed",))
    if found is not None:
        rate = F.get_json_object("evidence", "$.rate").try_cast("double")
        rates = found.where("alert_type = 'high_confidentiality_rate'").select(F.col("entity_id").alias("id"), rate.alias("confidentiality_rate"))
        put("agency", rates, "confidentiality_rate", only_known=True)
    return out


def detect(spark: SparkSession, root: str, p: Params, at: dt.datetime) -> list[dict]:
    """Run all rules over the tables under root, append the new alerts, and write what the rules learned; returns the outcome per rule."""
    t = read_tables(spark, root, *RULE_TABLES)
    shared: dict = {}
    found, outcome = engine.run_all(t, p, shared=shared)
    write_learned(spark, root, shared, found)
    if found is not None:
        rows = cut(alerts.to_alert_rows(alerts.new_alerts(found, t["alert"]), at))
        write_table(rows, "alert", f"{root}/alert", mode="append")
    return outcome
