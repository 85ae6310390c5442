"""Small tables for tests; columns not given are null."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

SCHEMAS = {
    "agency": "id bigint, agency_code string, name string",
    "vendor": "id bigint, vendor_id string, name string, name_normalized string, address string, city string, state string, zip_code string, "
              "phone string, hub_status string, first_seen date, risk_score int, in_cmbl boolean, raw_data string",
    "payment": "id bigint, vendor_id bigint, agency_id bigint, amount decimal(15,2), payment_date date, is_confidential boolean, description string, source_system string",
    "contract": "id bigint, contract_number string, vendor_id bigint, agency_id bigint, description string, current_value decimal(15,2), "
                "max_value decimal(15,2), start_date date, end_date date",
    "employee": "id bigint, name string, name_normalized string, agency_id bigint, job_title string, annual_salary decimal(15,2), raw_data string",
    "contribution": "id bigint, filer_name string, contributor_name string, contributor_normalized string, contribution_amount decimal(15,2), contribution_date date",
    "tax_permit": "id bigint, taxpayer_normalized string, permit_type string",
    "debarred": "id bigint, source string, sam_number string, entity_name string, name_normalized string, address string, is_active boolean, exclusion_type string",
    "alert": "id bigint, alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, status string, created_at timestamp",
}


def table(spark, name: str, *rows: dict):
    schema = SCHEMAS[name]
    kinds = dict(c.strip().split(" ", 1) for c in schema.replace("decimal(15,2)", "decimal").split(","))
    out = []
    for i, r in enumerate(rows):
        r = {"id": i + 1, **r}
        row = []
        for c, kind in kinds.items():
            v = r.get(c)
            if v is not None and kind.startswith("decimal"):
                v = Decimal(str(v))
            if v is not None and kind == "date" and isinstance(v, str):
                v = dt.date.fromisoformat(v)
            row.append(v)
        out.append(tuple(row))
    return spark.createDataFrame(out, schema)
