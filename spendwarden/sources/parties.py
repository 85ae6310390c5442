"""Permits, contributions and exclusions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_vendor_name
from ..functions.scalars import parse_date, parse_money
from ..operators.tables import pick_per_key, upsert
from .readers import filled, have, known, pick, raw

MIN_CONTRIBUTION = 500


def map_permits(df: DataFrame, permit_type: str) -> DataFrame:
    """Permit holders; the last row per number, every row without one."""
    name = known(df, "taxpayer_name", default="")

    def text(*names: str):
        return known(df, *names, default="")

    rows = df.select(
        F.lit(permit_type).alias("permit_type"), name.alias("taxpayer_name"), normalize_vendor_name(name).alias("taxpayer_normalized"),
        F.nullif(text("taxpayer_number", "taxpayer_no"), F.lit("")).alias("taxpayer_number"), text("business_name").alias("business_name"),
        text("physical_address", "address").alias("business_address"), text("physical_city", "city").alias("business_city"),
        text("physical_state", "state").alias("business_state"), text("physical_zip", "zip").alias("business_zip"), text("naics_code", "naics").alias("naics_code"),
        text("sic_code", "sic").alias("sic_code"), known(df, "permit_status", "status", default="active").alias("permit_status"),
        parse_date(known(df, "first_sale_date", "first_sales_date"), "yyyy-M-d'T'H:m:s", "yyyy-M-d", "M/d/yyyy", "yyyy/M/d", cut=19).alias("first_sale_date"),
        raw(df).alias("raw_data"), "_pos").where("taxpayer_name <> ''")
    numbered = pick_per_key(rows.where("taxpayer_number is not null"), ["taxpayer_number", "permit_type"], F.col("_pos"), last=True)
    return numbered.unionByName(rows.where("taxpayer_number is null"))


def upsert_permits(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    numbered, other = incoming.where("taxpayer_number is not null"), incoming.where("taxpayer_number is null")
    return upsert(existing, numbered, ["taxpayer_number", "permit_type"], F.col("_pos")).unionByName(other.select(*[c for c in existing.columns]))


def map_contributions(df: DataFrame) -> DataFrame:
    """Contributions of 500 and more; first row per filer, contributor, amount and date."""
    person = F.trim(F.concat_ws(" ", pick(df, "contributorNameFirst"), pick(df, "contributorNameLast")))
    name = F.coalesce(filled(df, "contributorNameOrganization"), F.nullif(person, F.lit("")), filled(df, "contributorName", "contributor", "payorName"))
    date = parse_date(filled(df, "contributionDate", "receivedDate", "contributionInfoDate", "date"), "yyyyMMdd", "M/d/yyyy", "yyyy-M-d", "M-d-yyyy", "yyyy/M/d", cut=10)
    rows = df.select(
        filled(df, "filerName", "candidateName", "committeeNameOrAccount", "recipientName").alias("filer_name"),
        filled(df, "filerType", "filerTypeCd", "recipientType").alias("filer_type"), name.alias("contributor_name"), normalize_vendor_name(name).alias("contributor_normalized"),
        filled(df, "contributorType", "contributorTypeCd", "entityType").alias("contributor_type"),
        parse_money(filled(df, "contributionAmount", "amount", "contributionInfoAmount")).alias("contribution_amount"), date.alias("contribution_date"),
        filled(df, "contributorCity", "city").alias("contributor_city"), filled(df, "contributorState", "contributorStateCd", "state").alias("contributor_state"),
        filled(df, "contributorEmployer", "employerName").alias("contributor_employer"), raw(df).alias("raw_data"), "_pos")
    rows = rows.where((F.col("contribution_amount") >= MIN_CONTRIBUTION) & F.col("filer_name").isNotNull() & F.col("contributor_name").isNotNull())
    return pick_per_key(rows, ["filer_name", "contributor_name", "contribution_amount", "contribution_date"], F.col("_pos"))


_DATES = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyyMMdd", "d-MMM-yyyy", "d MMM yyyy")


def _finish(rows: DataFrame, as_of: dt.date) -> DataFrame:
    active = F.col("end_date").isNull() | (F.col("end_date") >= F.lit(as_of))
    return rows.where("sam_number is not null").withColumn("entity_name", F.coalesce(F.nullif(F.trim("entity_name"), F.lit("")), F.lit("Unknown"))).withColumn(
        "name_normalized", normalize_vendor_name(F.col("entity_name"))).withColumn("is_active", active).withColumn("source", F.lit("sam_gov"))


def map_exclusions(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Exclusion extract in CSV form; first row per number within the file."""
    person = F.concat_ws(" ", *[filled(df, c) for c in ("Prefix", "First", "Middle", "Last", "Suffix")])
    own = have(df, "Name")
    name = F.when(F.coalesce(own, F.lit("")) != "", F.trim(own)).otherwise(person)
    address = F.nullif(F.concat_ws(", ", *[filled(df, f"Address {i}") for i in range(1, 5)]), F.lit(""))
    named = {"classification": "Classification", "exclusion_type": "Exclusion Type", "exclusion_program": "Exclusion Program",
             "excluding_agency": "Excluding Agency", "cage_code": "CT Code", "uei": "UEI", "city": "City", "state": "State Province",
             "zip_code": "Zip", "country": "Country", "reason": "Additional Comments"}
    rows = df.select(
        filled(df, "SAM Number").alias("sam_number"), name.alias("entity_name"), address.alias("address"),
        parse_date(have(df, "Active Date"), *_DATES).alias("start_date"), parse_date(have(df, "Termination Date"), *_DATES).alias("end_date"),
        *[filled(df, c).alias(k) for k, c in named.items()], raw(df).alias("raw_data"), "_pos")
    return pick_per_key(_finish(rows, as_of), ["sam_number"], F.col("_pos"))


def map_exclusions_json(df: DataFrame, as_of: dt.date) -> DataFrame:
    """The same from nested records; the last per number stands."""
    def field(group: str, name: str):
        if group not in df.columns or name not in df.schema[group].dataType.names:
            return F.lit(None).cast("string")
        return F.nullif(F.col(group)[name].cast("string"), F.lit(""))

    ident, details, address, actions = "exclusionIdentification", "exclusionDetails", "exclusionAddress", "exclusionActions"
    person = F.concat_ws(" ", *[field(ident, c) for c in ("prefix", "firstName", "middleName", "lastName", "suffix")])
    rows = df.select(
        F.coalesce(filled(df, "samNumber"), field(ident, "samNumber")).alias("sam_number"), F.coalesce(field(ident, "name"), person).alias("entity_name"),
        F.nullif(F.concat_ws(", ", field(address, "addressLine1"), field(address, "addressLine2")), F.lit("")).alias("address"),
        parse_date(field(actions, "activeDate"), *_DATES).alias("start_date"), parse_date(field(actions, "terminationDate"), *_DATES).alias("end_date"),
        field(details, "classification").alias("classification"), field(details, "exclusionType").alias("exclusion_type"),
        field(details, "exclusionProgram").alias("exclusion_program"), field(actions, "excludingAgency").alias("excluding_agency"),
        field(ident, "cageCode").alias("cage_code"), field(ident, "ueiSAM").alias("uei"), field(address, "city").alias("city"),
        field(address, "stateOrProvinceCode").alias("state"), field(address, "zipCode").alias("zip_code"), field(address, "countryCode").alias("country"),
        field(actions, "additionalComments").alias("reason"), raw(df).alias("raw_data"), "_pos")
    return pick_per_key(_finish(rows, as_of), ["sam_number"], F.col("_pos"), last=True)


def upsert_exclusions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["source", "sam_number"], F.col("_pos"))
