"""The canonical tables and how they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MONEY, RATE = "decimal(15,2)", "decimal(5,4)"

# States of alerts, requests and loads, in order.
ALERT_STATES = ("new", "acknowledged", "investigating", "resolved", "false_positive")
REQUEST_STATES = ("draft", "submitted", "pending", "received", "overdue", "closed")

TABLES: dict[str, str] = {
    "agency": f"id bigint, agency_code string, name string, category string, confidentiality_rate {RATE}",
    "vendor": "id bigint, vendor_id string, name string, name_normalized string, address string, city string, state string, zip_code string, "
              "phone string, hub_status string, nigp_codes array<string>, first_seen date, last_seen date, risk_score int, in_cmbl boolean, raw_data string",
    "payment": f"id bigint, vendor_id bigint, agency_id bigint, amount {MONEY}, payment_date date, fiscal_year_state int, fiscal_year_federal int, "
               "calendar_year int, comptroller_object_code string, description string, is_confidential boolean, source_system string, source_id string, raw_data string",
    "contract": f"id bigint, contract_number string, vendor_id bigint, agency_id bigint, description string, current_value {MONEY}, base_value {MONEY}, max_value {MONEY}, "
                "start_date date, end_date date, nigp_codes array<string>, source string, fiscal_year int, raw_data string",
    "contract_sale": f"contract_number string, file string, amount {MONEY}",
    "grant": f"id bigint, grant_number string, recipient_id bigint, agency_id bigint, program_name string, amount_awarded {MONEY}, amount_disbursed {MONEY}, "
             "fiscal_year int, start_date date, end_date date, source string, federal_award_id string, raw_data string",
    "alert": "id bigint, alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, "
             "status string, created_at timestamp",
    "alert_state": "id bigint, alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, status string, "
                   "created_at timestamp, notes string, acknowledged_at timestamp, resolved_at timestamp",
    "alert_event": "alert_id bigint, status string, note string, at timestamp",
    "pia_request": "id bigint, agency_id bigint, subject string, request_text string, related_alert_id bigint, status string, submitted_date date, due_date date, received_date date",
    "sync_status": "source_name string, started_at timestamp, run_id bigint, status string, records_synced bigint, error_message string, read_until timestamp",
    "vendor_relationship": f"vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string, confidence_score {RATE}, evidence string",
    "name_relationship": f"name string, other_name string, confidence_score {RATE}",
    "address_member": "address string, vendor_id bigint, vendors bigint",
    "employee": f"id bigint, name string, name_normalized string, agency_id bigint, job_title string, annual_salary {MONEY}, hire_date date, employment_status string, raw_data string",
    "contribution": f"id bigint, filer_name string, filer_type string, contributor_name string, contributor_normalized string, contributor_type string, "
                    f"contribution_amount {MONEY}, contribution_date date, contributor_city string, contributor_state string, contributor_employer string, raw_data string",
    "lobbying_activity": f"id bigint, lobbyist_name string, client_name string, client_normalized string, amount {MONEY}, year int, raw_data string",
    "tax_permit": "id bigint, permit_type string, taxpayer_name string, taxpayer_normalized string, taxpayer_number string, business_name string, business_address string, "
                  "business_city string, business_state string, business_zip string, naics_code string, sic_code string, permit_status string, first_sale_date date, raw_data string",
    "entity_match": f"entity_type_1 string, entity_id_1 bigint, entity_type_2 string, entity_id_2 bigint, match_type string, confidence_score {RATE}, evidence string, is_confirmed boolean",
    "debarred": "id bigint, source string, sam_number string, entity_name string, name_normalized string, classification string, exclusion_type string, exclusion_program string, "
                "excluding_agency string, cage_code string, uei string, address string, city string, state string, zip_code string, country string, start_date date, end_date date, "
                "is_active boolean, reason string, raw_data string",
    "construction_bid": f"id bigint, project_id string, contractor_name string, contractor_normalized string, vendor_id bigint, bid_amount {MONEY}, engineer_estimate {MONEY}, "
                        "bid_rank int, is_winner boolean, letting_date date, county string, source string, raw_data string",
    "hhs_contract": "id bigint, contract_number string, vendor_name string, vendor_normalized string, vendor_id bigint, solicitation_number string, start_date date, end_date date, agency string",
}

# Payments are read by date range in most rules, so whole years of files can be left unread. Logs are only appended to.
PARTITION_BY = {"payment": ["fiscal_year_state"], "alert": [], "alert_event": [], "sync_status": []}
# All other tables are dealt by id, or by these keys, into _part, so that an update rewrites some files and not all.
KEYS = {"vendor_relationship": ["vendor_id_1", "vendor_id_2", "relationship_type"], "name_relationship": ["name", "other_name"], "address_member": ["address", "vendor_id"],
        "entity_match": ["entity_type_1", "entity_id_1", "entity_type_2", "entity_id_2", "match_type"], "contract_sale": ["contract_number", "file"]}
PARTS = 16  # for new rows; a row stays in the partition it is in, so the number may be raised later


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns and types; missing columns are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(name).fields])


def placed(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """df with _part, where the table has no partition columns of its own."""
    if name in PARTITION_BY:
        return df
    return df.withColumn("_part", F.pmod(F.xxhash64(*KEYS.get(name, ["id"])), F.lit(parts or PARTS)).cast("int"))


def store(df: DataFrame, name: str, path: str, mode: str) -> None:
    """Write rows that have their partition columns; overwrite replaces only the partitions that df has rows of."""
    by = PARTITION_BY.get(name, ["_part"])
    if by:
        df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_table(df: DataFrame, name: str, path: str, mode: str = "overwrite") -> None:
    """Store a whole table as Parquet; a new version belongs under a new path."""
    by = PARTITION_BY.get(name, ["_part"])
    out = placed(conform(df, name), name).write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def read_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The named tables under one folder; a table never written is empty."""
    out = {}
    for n in names:
        try:
            out[n] = spark.read.parquet(f"{root}/{n}").select(*schema_of(n).names)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[n] = spark.createDataFrame([], schema_of(n))
    return out
