"""Expenditures, payments and salaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_vendor_name
from ..functions.scalars import federal_fiscal_year, parse_date, parse_money, state_fiscal_year
from ..operators.tables import pick_per_key
from .readers import filled, have, known, pick, raw


def map_expenditures(df: DataFrame, fiscal_year: int, dedupe: str = "first") -> DataFrame:
    """Agency spending by category. Files hold a row per county: keep the first per key, or the sum."""
    rows = df.select(
        parse_money(have(df, "amount")).alias("amount"), known(df, "agency_name", default="").alias("agency_name"),
        known(df, "agency_number", default="").alias("agency_code"), known(df, "major_spending_category", default="").alias("description"),
        F.lit(fiscal_year).alias("fiscal_year_state"), F.lit("socrata_expenditures").alias("source_system"), "_pos")
    rows = rows.withColumn("source_id", F.concat_ws("-", "fiscal_year_state", "agency_code", "description"))
    rows = rows.where("amount <> 0 and (agency_name <> '' or agency_code <> '')")
    if dedupe == "first":
        return pick_per_key(rows, ["source_id"], F.col("_pos"))
    return rows.groupBy("source_id").agg(
        F.sum("amount").cast("decimal(15,2)").alias("amount"),
        *[F.min_by(c, "_pos").alias(c) for c in ("agency_name", "agency_code", "description", "fiscal_year_state", "source_system")], F.min("_pos").alias("_pos"))


def map_payments(df: DataFrame) -> DataFrame:
    """Payment records; the first of each source id."""
    date = parse_date(known(df, "date", "payment_date"), "yyyy-M-d'T'H:m:s", "yyyy-M-d", "M/d/yyyy", cut=19)
    rows = df.select(
        parse_money(known(df, "amount", "payment_amount", default="0")).alias("amount"), date.alias("payment_date"),
        known(df, "payee_name", "vendor_name", default="").alias("vendor_name"), known(df, "agency_name", "agency", default="").alias("agency_name"),
        known(df, "agency_code", "agency_number", default="").alias("agency_code"),
        known(df, "object_code", "comptroller_object", default="").alias("comptroller_object_code"),
        known(df, "description", "payment_description", default="").alias("description"),
        (F.upper(known(df, "confidential", default="N")) == "Y").alias("is_confidential"), F.lit("socrata").alias("source_system"),
        F.nullif(known(df, ":id", "id", default=""), F.lit("")).alias("source_id"), raw(df).alias("raw_data"), "_pos").where("amount <> 0")
    d = F.col("payment_date")
    rows = rows.withColumns({"fiscal_year_state": state_fiscal_year(d), "fiscal_year_federal": federal_fiscal_year(d), "calendar_year": F.year(d)})
    return pick_per_key(rows.where("source_id is not null"), ["source_id"], F.col("_pos")).unionByName(rows.where("source_id is null"))


def map_payee_payments(df: DataFrame, dataset: str) -> DataFrame:
    """Payments by payee, columns drifting by dataset. Deduplicate after resolution with first_payments."""
    fy_text = F.left(filled(df, "fiscal_year", "fy"), F.lit(4)).try_cast("int")
    from_name = next((int(y) for y in re.findall(r"(?<!\d)(?:19|20)\d\d(?!\d)", dataset)), None)
    date_text = filled(df, "payment_date", "date", "check_date")
    date = F.when(F.contains(date_text, F.lit("T")), F.try_to_date(F.substring_index(date_text, "T", 1), "yyyy-MM-dd")).otherwise(
        F.try_to_date(F.left(date_text, F.lit(10)), "yyyy-M-d"))
    return df.select(
        filled(df, "payee_name", "vendor_name", "payee").alias("vendor_name"), filled(df, "agency_name", "agency").alias("agency_name"),
        known(df, "agency_code", "agency_number").alias("agency_code"),
        parse_money(filled(df, "amount", "payment_amount", "expenditure_amount")).alias("amount"), date.alias("payment_date"),
        F.coalesce(F.nullif(fy_text, F.lit(0)), F.lit(from_name).cast("int")).alias("fiscal_year_state"),
        filled(df, "description", "comptroller_object_title").alias("description"),
        filled(df, "comptroller_object_code", "object_code").alias("comptroller_object_code"),
        F.lit(f"comptroller_{dataset}").alias("source_system"), raw(df).alias("raw_data"), "_pos").where("vendor_name is not null and amount is not null")


def first_payments(resolved: DataFrame) -> DataFrame:
    """The first row per vendor, agency, amount and date; missing values are values."""
    return pick_per_key(resolved, ["vendor_id", "agency_id", "amount", "payment_date"], F.col("_pos"))


def map_salaries(df: DataFrame) -> DataFrame:
    """Employee rows; the last row per name and agency stands (apply last_salaries after resolution)."""
    person = F.trim(F.concat_ws(" ", pick(df, "FIRST NAME"), pick(df, "LAST NAME")))
    name = F.nullif(F.coalesce(F.nullif(person, F.lit("")), pick(df, "Name")), F.lit(""))
    hired = F.substring_index(filled(df, "HIRE DATE", "Hire Date", "hire_date"), "T", 1)
    return df.select(
        name.alias("name"), normalize_vendor_name(name).alias("name_normalized"),
        pick(df, "AGENCY NAME", "Agency Name", "Department", "agency").alias("agency_name"),
        pick(df, "AGENCY", "agency_code", "Agency Code").alias("agency_code"),
        pick(df, "CLASS TITLE", "Class Title", "Title", "Job Title").alias("job_title"),
        parse_money(filled(df, "ANNUAL", "Annual", "summed_annual_salary", "Salary")).alias("annual_salary"),
        parse_date(hired, "yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d").alias("hire_date"),
        pick(df, "EMPLOYEE TYPE", "Employee Type", "Status").alias("employment_status"), raw(df).alias("raw_data"), "_pos").where("name is not null")


def last_salaries(resolved: DataFrame) -> DataFrame:
    """The last row per name and agency; the first row's spelling of the name stays."""
    first = resolved.groupBy("name_normalized", "agency_id").agg(F.min_by("name", "_pos").alias("_name"))
    last = pick_per_key(resolved, ["name_normalized", "agency_id"], F.col("_pos"), last=True)
    cond = [last[c].eqNullSafe(first[c]) for c in ("name_normalized", "agency_id")]
    return last.join(first, cond).select(*[(F.col("_name") if c == "name" else last[c]).alias(c) for c in last.columns])
