"""Public records requests drafted from alerts, and their deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import add_business_days, first_places

RESPONSE_DAYS = 10

# Which letter an alert gets; every alert type not listed gets the general one.
LETTER_OF = {
    "contract_splitting": "splitting", "duplicate_payment": "duplicate", "near_duplicate_payment": "duplicate",
    "related_vendor_duplicate": "duplicate", "vendor_cluster_address": "relationship", "vendor_cluster_name": "relationship",
    "vendor_cluster_sequential": "relationship", "vendor_cluster": "relationship", "address_cluster": "relationship",
    "high_confidentiality_rate": "confidentiality", "confidentiality_spike": "confidentiality", "vendor_high_confidentiality": "confidentiality",
}
OPENING = "To the public information officer: under the state public information law please send copies of the records below.\n\n"
CLOSING = "\nThis request serves public oversight. Please say so before costs exceed $40. Thank you.\n"
ASKS = {
    "general": "Wanted: contracts, letters, payment records and internal messages on this matter.",
    "splitting": "Wanted: the contracts, bids, selection reasons, and any waiver of competitive bidding.",
    "duplicate": "Wanted: invoices, approvals, vendor letters, refunds and internal reviews of these payments.",
    "relationship": "Wanted: vendor registration files, ownership and conflict of interest statements, debarment records.",
    "confidentiality": "Wanted: the legal ground of each confidential marking, counts by category, and the policy on markings.",
}


def _letter(alert_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LETTER_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(table, alert_type), F.lit("general"))


def draft_requests(alerts: DataFrame, contracts: DataFrame | None = None, listed: int | None = None) -> DataFrame:
    """One draft per alert. contracts (alert_id, contract_number, current_value), each alert's own, are listed in splitting letters, all or the first."""
    a = alerts.withColumn("letter", _letter(F.col("alert_type")))
    if contracts is not None:
        w = Window.partitionBy("alert_id").orderBy("contract_number")
        line = F.format_string("  - %s: $%s", "contract_number", F.format_number("current_value", 2))
        first = first_places(contracts.withColumn("place", F.row_number().over(w)), listed)
        per = first.groupBy(F.col("alert_id").alias("id")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
        a = a.join(per, "id", "left")
    else:
        a = a.withColumn("lines", F.lit(None).cast("string"))
    asks = F.try_element_at(F.create_map(*[F.lit(x) for kv in ASKS.items() for x in kv]), F.col("letter"))
    vendor = F.coalesce(F.get_json_object("evidence", "$.vendor_name"), F.lit("[VENDOR NAME]"))
    matter = F.when(F.col("letter") == "splitting", F.concat(F.lit("Vendor: "), vendor, F.lit("\n"), F.coalesce("lines", F.lit("")))).otherwise(F.col("description"))
    matter = F.when(F.col("letter") == "general", F.concat(F.lit("Subject: "), F.col("title"), F.lit("\n"), F.col("description"))).otherwise(matter)
    return a.select(
        F.col("id").alias("related_alert_id"), F.get_json_object("evidence", "$.agency_id").try_cast("bigint").alias("agency_id"),
        F.concat(F.lit("Records Request: "), F.col("title")).alias("subject"), F.lit("draft").alias("status"), "letter",
        F.concat(F.lit(OPENING), matter, F.lit("\n"), asks, F.lit(CLOSING)).alias("request_text"))


def draft_for_agency(agencies: DataFrame, agency_code: str, subject: str) -> DataFrame:
    return agencies.where(F.col("agency_code") == agency_code).select(
        F.col("id").alias("agency_id"), F.lit(subject).alias("subject"), F.lit("").alias("request_text"), F.lit("draft").alias("status"))


def submit(requests: DataFrame, submitted) -> DataFrame:
    """Mark drafts submitted: pending, due ten working days later."""
    day = F.lit(submitted) if not isinstance(submitted, Column) else submitted
    draft = F.col("status") == "draft"
    return requests.withColumn("submitted_date", F.when(draft, day).otherwise(F.col("submitted_date"))).withColumn(
        "due_date", F.when(draft, add_business_days(F.col("submitted_date"), RESPONSE_DAYS)).otherwise(F.col("due_date"))).withColumn(
        "status", F.when(draft, "pending").otherwise(F.col("status")))


def mark_overdue(requests: DataFrame, as_of) -> DataFrame:
    late = (F.col("status") == "pending") & (F.col("due_date") < F.lit(as_of))
    return requests.withColumn("status", F.when(late, "overdue").otherwise(F.col("status")))


def list_requests(requests: DataFrame, status: str | None = None, k: int = 20) -> DataFrame:
    df = requests if status is None else requests.where(F.col("status") == status)
    return df.orderBy(F.desc("submitted_date"), F.desc("id")).limit(k)


def show_request(requests: DataFrame, agencies: DataFrame, alerts: DataFrame, request_id: int) -> DataFrame:
    """One request with all its fields, its agency's name and the title of the alert it came from; no row for an unknown id."""
    a = agencies.select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))
    o = alerts.select(F.col("id").alias("related_alert_id"), F.col("title").alias("alert_title"))
    one = requests.where(F.col("id") == request_id)
    return one.join(a, "agency_id", "left").join(o, "related_alert_id", "left").select(*requests.columns, "agency_name", "alert_title")
