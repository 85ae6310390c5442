"""Findings to alerts: common shape, one open alert per entity, status history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank

KEY = ["alert_type", "entity_type", "entity_id"]
PART = {"pay_to_play": "contributor_name", "debarred_vendor": "exclusion_id"}  # evidence that tells an entity's alerts of one type apart
CLOSED = ("resolved", "false_positive")

# What each kind of alert says.
LABELS = {
    "contract_splitting": "Contracts kept under an approval threshold", "duplicate_payment": "Identical payments",
    "near_duplicate_payment": "Equal payments close together", "related_vendor_duplicate": "Equal payments to vendors at one address",
    "vendor_cluster_address": "Vendors at one address", "vendor_cluster_name": "Nearly equal vendor names",
    "vendor_cluster_sequential": "Neighbouring vendor ids with similar names", "round_number_payments": "Many round payments",
    "large_first_payment": "Large first payment to a new vendor", "over_contract_payment": "Payments above the contract maximum",
    "ghost_vendor": "Paid vendor without registration", "fy_end_spike": "August spending spike",
    "high_confidentiality_rate": "High share of confidential payments", "confidentiality_spike": "Rise in confidential payments",
    "vendor_high_confidentiality": "Vendor paid mostly in confidence", "hub_vendor": "Vendor with unusually many agencies",
    "vendor_cluster": "Linked vendors sharing agencies", "exclusive_relationship": "Agency spending with one vendor",
    "address_cluster": "Vendors with the same written address", "pay_to_play": "Contributor is a vendor",
    "employee_vendor_match": "Employee and vendor share a name", "employee_vendor_address_match": "Employee and vendor share an address",
    "incomplete_vendor_address": "Paid vendor with incomplete address", "suspicious_vendor_address": "Paid vendor with suspicious address",
    "fiscal_year_spending_rush": "Year-end spending rush", "vendor_fy_end_concentration": "Vendor paid mostly at year end",
    "fy_end_payment_cluster": "Heavy payments in the last days of August", "related_party_network": "Network of related vendors",
    "employee_vendor_contributor_triangle": "Employee, vendor and contributor linked", "circular_payment_pattern": "Related vendors paid by the same agencies",
    "debarred_vendor": "Vendor on an exclusion list",
}


def as_findings(df: DataFrame, rule_order: int = 0) -> DataFrame:
    """Bring a rule's typed result to the common shape; its own columns become the evidence."""
    own = [c for c in df.columns if c not in ("alert_type", "severity", "entity_type", "entity_id")]
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    name = [c for c in own if c in ("vendor_name", "agency_name", "employee_name", "contract_number", "address", "contributor_name")]
    title = F.coalesce(F.try_element_at(label, F.col("alert_type")), F.col("alert_type"))
    title = F.concat_ws(": ", title, F.col(name[0])) if name else title
    evidence = F.to_json(F.struct(*[F.col(c) for c in own])) if own else F.lit("{}")
    return df.select(
        "alert_type", "severity", title.alias("title"), F.concat(title, F.lit(" "), evidence).alias("description"), "entity_type",
        F.col("entity_id").cast("bigint").alias("entity_id"), evidence.alias("evidence"), F.lit(rule_order).alias("rule_order"))


def alert_part() -> Column:
    """What the type's PART names in the evidence; empty for types without."""
    kinds = [F.when(F.col("alert_type") == kind, F.get_json_object("evidence", f"$.{field}")) for kind, field in PART.items()]
    return F.coalesce(*kinds, F.lit("")).alias("_part")


def new_alerts(findings: DataFrame, existing: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Findings that become alerts: the best per entity and type, unless an open alert has it already.

    Contributors to one vendor and exclusions of one vendor are alerts of their own. Rule order decides, then severity,
    then evidence. Findings without an entity all pass.
    """
    row = F.struct(*[F.col(c) for c in findings.columns])
    order = F.struct(F.col("rule_order"), -severity_rank(F.col("severity")), F.col("evidence"))
    named = findings.where(F.col("entity_id").isNotNull())
    best = named.groupBy(*key, alert_part()).agg(F.min_by(row, order).alias("_r")).select("_r.*", "_part")
    open_ = existing.where(~F.col("status").isin(*CLOSED)).select(*key, alert_part()).distinct()
    fresh = best.join(open_, [*key, "_part"], "left_anti").select(*findings.columns)
    return fresh.unionByName(findings.where(F.col("entity_id").isNull()))


def to_alert_rows(fresh: DataFrame, created_at) -> DataFrame:
    """Rows of the alerts table, status new; ids are hashed from the alert's own text and time."""
    at = F.lit(created_at).cast("timestamp")
    return fresh.select(
        F.xxhash64("alert_type", "entity_type", "entity_id", "evidence", at).alias("id"), "alert_type", "severity", "title", "description",
        "entity_type", "entity_id", "evidence", F.lit("new").alias("status"), at.alias("created_at"))


def append_alerts(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def current_alerts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with their latest status and the time of each change.

    events: (alert_id, status, note, at), append only. Notes are added in order of time, a line each, to those the alert has.
    """
    def last(status: str):
        return F.max(F.when(F.col("status") == status, F.col("at")))

    state = events.groupBy("alert_id").agg(
        F.max_by("status", F.struct("at", "status")).alias("_status"), last("acknowledged").alias("acknowledged_at"),
        F.max(F.when(F.col("status").isin(*CLOSED), F.col("at"))).alias("resolved_at"), F.sort_array(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("at", "note")))).alias("_notes"))
    old = F.col("notes").cast("string") if "notes" in alerts.columns else F.lit(None).cast("string")
    new = F.transform("_notes", lambda x: x["note"])
    text = F.concat_ws("\n", F.array_compact(F.concat(F.array(old), F.coalesce(new, F.array().cast("array<string>")))))
    out = alerts.join(state, alerts["id"] == state["alert_id"], "left")
    return out.withColumn("notes", F.nullif(text, F.lit(""))).withColumn("status", F.coalesce("_status", "status")).drop("_status", "_notes", "alert_id")


def status_event(alert_id: int, status: str, note: str | None, at, spark) -> DataFrame:
    """One status change to append to the events table."""
    return spark.range(1).select(F.lit(alert_id).cast("bigint").alias("alert_id"), F.lit(status).alias("status"), F.lit(note).cast("string").alias("note"),
                                 F.lit(at).cast("timestamp").alias("at"))
