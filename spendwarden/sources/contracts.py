"""Contracts of all layouts, federal awards and construction work."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_vendor_name
from ..functions.scalars import parse_date, parse_money
from ..operators.tables import pick_per_key
from .readers import filled, have, known, pick, raw

ISO, US = "yyyy-M-d", "M/d/yyyy"


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    return pick_per_key(rows, list(keys), F.col("_pos"))


def map_contract_csv(df: DataFrame) -> DataFrame:
    """Contract export; the number may be link text. First row per number."""
    text = pick(df, "Contract-ID", "Contract")
    number = F.trim(F.when(F.contains(text, F.lit("<a href=")) & text.rlike(">[^<]+</a>"), F.regexp_extract(text, ">([^<]+)</a>", 1)).otherwise(text))
    codes = F.regexp_extract_all(pick(df, "NGIP Codes and Categories", "NIGP Codes and Categories"), F.lit(r"(\d{3}-\d{2})"), F.lit(1))
    return _first(df.select(
        F.nullif(number, F.lit("")).alias("contract_number"), pick(df, "Vendor").alias("vendor_name"), pick(df, "Agency").alias("agency_name"),
        filled(df, "Subject").alias("description"), parse_money(filled(df, "Current Contract Value")).alias("current_value"),
        parse_date(filled(df, "Award Date"), ISO, US).alias("start_date"), parse_date(filled(df, "Completion Date"), US, ISO).alias("end_date"),
        F.when(F.size(codes) > 0, codes).alias("nigp_codes"), F.lit("LBB").alias("source"), raw(df).alias("raw_data"), "_pos").where("contract_number is not null"), "contract_number")


def plain_heading(c: str) -> str:
    """A spreadsheet heading in lower case with underscores."""
    return re.sub(r"[^0-9a-z_]", "", re.sub(r"[ -]", "_", c.strip().lower()))


def plain_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c if c in ("_pos", "_cells") else plain_heading(c)) for c in df.columns])


def map_contract_sheet(df: DataFrame) -> DataFrame:
    """Spreadsheet layout, nan meaning empty. The last row per number stands."""
    d = plain_columns(df)

    def text(*names: str):
        return F.nullif(F.nullif(F.trim(known(d, *names, default="")), F.lit("nan")), F.lit(""))

    def first_of(read, *names: str):
        return F.coalesce(*[read(F.nullif(have(d, n), F.lit("nan"))) for n in names])

    day = lambda c: parse_date(c, US, ISO)
    nigp = text("nigp_code", "commodity_code")
    rows = d.select(
        text("contract_number", "contract_no").alias("contract_number"), text("vendor_name", "contractor").alias("vendor_name"),
        text("agency_name", "agency").alias("agency_name"), text("description", "contract_description").alias("description"),
        first_of(parse_money, "current_value", "contract_value", "value").alias("current_value"),
        first_of(parse_money, "max_value", "maximum_value", "max_contract_value").alias("max_value"),
        first_of(day, "start_date", "effective_date", "begin_date").alias("start_date"),
        first_of(day, "end_date", "expiration_date", "termination_date").alias("end_date"),
        F.when(nigp.isNotNull(), F.transform(F.split(nigp, ","), lambda x: F.trim(x))).alias("nigp_codes"),
        first_of(lambda c: c.try_cast("double").cast("int"), "fiscal_year", "fy", "award_fiscal_year").alias("fiscal_year"),
        F.lit("LBB").alias("source"), raw(d).alias("raw_data"), "_pos").where("contract_number is not null")
    return pick_per_key(rows, ["contract_number"], F.col("_pos"), last=True)


def map_awards(df: DataFrame, award_type: str, fiscal_year: int) -> DataFrame:
    """Federal awards; first row per award id."""
    award = filled(df, "Award ID")
    return _first(df.select(
        award.alias("grant_number"), filled(df, "Recipient Name").alias("vendor_name"), filled(df, "Awarding Agency", "Awarding Sub Agency").alias("agency_name"),
        filled(df, "Description").alias("program_name"), parse_money(known(df, "Award Amount", default="0")).alias("amount_awarded"),
        parse_money(known(df, "Total Outlays", default="0")).alias("amount_disbursed"), F.lit(fiscal_year).alias("fiscal_year"),
        parse_date(have(df, "Start Date"), ISO, cut=10).alias("start_date"), parse_date(have(df, "End Date"), ISO, cut=10).alias("end_date"),
        F.lit(f"usaspending_{award_type}").alias("source"), award.alias("federal_award_id"), raw(df).alias("raw_data"), "_pos").where("grant_number is not null"), "grant_number")


def map_cooperative(df: DataFrame) -> DataFrame:
    """Cooperative contracts: kind and sub-kind go into the description. First row per number."""
    text, kind, sub = (known(df, c, default="") for c in ("rfo_description", "contract_type", "contract_subtype"))
    pair = F.concat(kind, F.lit("/"), sub)
    described = F.when((kind == "") & (sub == ""), text).when(text == "", pair).otherwise(F.concat(text, F.lit(" ["), pair, F.lit("]")))
    return _first(df.select(
        filled(df, "contract_number").alias("contract_number"), known(df, "primary_vendor_name", default="").alias("vendor_name"),
        F.nullif(described, F.lit("")).alias("description"), parse_date(have(df, "contract_start"), "yyyy-MM-dd", cut=10).alias("start_date"),
        parse_date(have(df, "contract_termination_date"), "yyyy-MM-dd", cut=10).alias("end_date"), F.lit("dir_contracts").alias("source"),
        raw(df).alias("raw_data"), "_pos").where("contract_number is not null"), "contract_number")


def sales_rollup(df: DataFrame, per: str | None = None) -> DataFrame:
    """Positive purchases summed per contract (or per contract and file), other fields from its first row. The sum is partial before the shuffle."""
    by = [F.col("contract_number")] + ([F.col("_pos.file").alias("file")] if per == "file" else [])
    rows = df.select(
        filled(df, "contract_number").alias("contract_number"), known(df, "purchase_amount", default="0").try_cast("decimal(15,2)").alias("amount"),
        known(df, "vendor_name", default="").alias("vendor_name"), known(df, "customer_name", default="").alias("agency_name"),
        F.nullif(known(df, "rfo_description", default=""), F.lit("")).alias("description"),
        parse_date(have(df, "contract_start_date"), "yyyy-MM-dd", cut=10).alias("start_date"),
        parse_date(have(df, "contract_termination_date"), "yyyy-MM-dd", cut=10).alias("end_date"), "_pos").where("contract_number is not null and amount > 0")
    head = F.struct("vendor_name", "agency_name", "description", "start_date", "end_date", "_pos")
    return rows.groupBy(*by).agg(F.sum("amount").cast("decimal(15,2)").alias("current_value"), F.min_by(head, "_pos").alias("h")).select(
        "contract_number", *(["file"] if per == "file" else []), "current_value", "h.*", F.lit("dir_sales").alias("source"))


def apply_sales(contracts: DataFrame, sales: DataFrame, base_value: str = "base_value") -> DataFrame:
    """Contract values as base plus sales; the base is kept, so running twice changes nothing."""
    base = F.col(base_value) if base_value in contracts.columns else F.col("current_value")
    old = contracts.withColumn(base_value, base)
    s = sales.select("contract_number", F.col("current_value").alias("_sold"))
    updated = old.join(s, "contract_number", "left").withColumn(
        "current_value", F.when(F.col("_sold").isNotNull(), F.coalesce(base_value, F.lit(0)) + F.col("_sold")).otherwise(F.col("current_value"))).drop("_sold")
    fresh = sales.join(contracts.select("contract_number"), "contract_number", "left_anti").withColumn(base_value, F.lit(0).cast("decimal(15,2)"))
    return updated.unionByName(fresh.drop("_pos"), allowMissingColumns=True)


def map_bids(df: DataFrame, first_letting=None) -> DataFrame:
    """Construction bids without the engineer's own estimate; first row per project and cleaned contractor."""
    name = known(df, "vendor_name", default="")
    estimate = F.contains(F.lower(name), F.lit("engineer")) & F.contains(F.lower(name), F.lit("estimate"))
    rank = filled(df, "bid_rank_sequence_number").try_cast("double").cast("int")
    rows = df.select(
        filled(df, "control_section_job_csj", "controlling_project_id_ccsj").alias("project_id"), name.alias("contractor_name"),
        normalize_vendor_name(name).alias("contractor_normalized"), parse_money(filled(df, "bid_total_amount")).alias("bid_amount"),
        parse_money(filled(df, "sealed_engineer_s_estimate", "sealed_engineer_s_estimate_1")).alias("engineer_estimate"), rank.alias("bid_rank"),
        F.coalesce(rank == 1, F.lit(False)).alias("is_winner"),
        parse_date(filled(df, "project_actual_let_date", "project_estimated_let_date"), ISO, cut=10).alias("letting_date"),
        known(df, "county", default="").alias("county"), F.lit("txdot").alias("source"), raw(df).alias("raw_data"), "_pos",
    ).where((name != "") & ~estimate).where("project_id is not null")
    if first_letting is not None:
        rows = rows.where(F.col("letting_date") >= F.lit(first_letting))
    return _first(rows, "project_id", "contractor_normalized")


def map_construction(df: DataFrame) -> DataFrame:
    """Construction contracts, numbered by contract and project. First row per number."""
    number, project = filled(df, "contract_number"), filled(df, "controlling_project_id_ccsj")
    return _first(df.select(
        F.when(number.isNotNull(), F.concat_ws("-", F.lit("TXDOT"), number, project)).alias("contract_number"),
        known(df, "contractor", default="").alias("vendor_name"), F.lit("TXDOT").alias("agency_code"),
        F.lit("TEXAS DEPARTMENT OF TRANSPORTATION").alias("agency_name"),
        F.concat(known(df, "county", default=""), F.lit(" - "), known(df, "contract_limits_from", default=""), F.lit(" to "), known(df, "contract_limits_to", default="")).alias("description"),
        parse_money(F.nullif(known(df, "final_contract_amount", "original_contract_amount"), F.lit(""))).alias("current_value"),
        parse_money(filled(df, "original_contract_amount")).alias("max_value"), parse_date(filled(df, "date_work_begin"), ISO, cut=10).alias("start_date"),
        parse_date(filled(df, "date_work_accepted"), ISO, cut=10).alias("end_date"), F.lit("txdot").alias("source"), raw(df).alias("raw_data"), "_pos").where(
        "contract_number is not null"), "contract_number")
