"""Vendor master, class codes and commodity book."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import normalize_address
from ..functions.names import normalize_vendor_name
from ..operators.resolve import surrogate_id
from ..operators.tables import upsert
from .readers import filled, pick, raw


def map_vendors(df: DataFrame, as_of: dt.date, certified: bool = False) -> DataFrame:
    """Bidder list rows to vendors; address parts only where there is an address."""
    address = filled(df, "WEB_ADDR1", "VENDOR ADDRESS LINE 1", " VENDOR ADDRESS LINE 1", "Address", "Street1")
    city = pick(df, "WEB_CITY", "CITY", "City")
    state = pick(df, "WEB_STATE", "STATE", "State")
    zip_code = pick(df, "WEB_ZIP", "ZIP CODE", "Zip", "ZipCode")
    hub = filled(df, "WEB_HUB_STATUS", " STATUS CODE", "STATUS CODE", "CertType", "Hub_Status")
    rows = df.select(
        filled(df, "WEB_VID", "VENDOR ID NUMBER", "VendorId", "Vendor_Id").alias("vendor_id"),
        filled(df, "WEB_NAME_VENDOR_NAME", "VENDOR NAME", " VENDOR NAME", "Name", "Vendor_Name").alias("name"),
        address.alias("address"), city.alias("c"), state.alias("s"), zip_code.alias("z"),
        normalize_address(address, city, state, zip_code).alias("a"),
        filled(df, "WEB_PHONE", "PHONE NUMBER", " PHONE NUMBER", "Phone", "PhoneNumber").alias("phone"),
        (F.coalesce(hub, F.lit("HUB")) if certified else hub).alias("hub_status"), raw(df).alias("raw_data"), "_pos")
    here = F.col("address").isNotNull()

    def part(field: str, own: str):
        return F.when(here, F.coalesce(F.nullif(F.col(f"a.{field}"), F.lit("")), F.col(own)))

    return rows.where("vendor_id is not null and name is not null").select(
        surrogate_id(F.lit("state vendor"), F.col("vendor_id")).alias("id"), "vendor_id", "name", normalize_vendor_name(F.col("name")).alias("name_normalized"),
        "address", part("city", "c").alias("city"), part("state", "s").alias("state"), part("zip_code", "z").alias("zip_code"), "phone", "hub_status",
        F.lit(True).alias("in_cmbl"), F.lit(as_of).alias("first_seen"), F.lit(as_of).alias("last_seen"), "raw_data", "_pos")


def upsert_vendors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By state id: new values win, missing ones keep the old, first_seen and id stay."""
    return upsert(existing, incoming.drop("_pos") if "_pos" in existing.columns else incoming, ["vendor_id"], F.col("_pos"),
                  keep_if_null=("address", "city", "state", "zip_code", "phone", "hub_status"), keep_always=("id", "first_seen"))


def class_codes(df: DataFrame) -> DataFrame:
    """(vendor_id, nigp_codes): the distinct class codes of each vendor, sorted."""
    rows = df.select(filled(df, "CLASS_VID", "VendorId").alias("vendor_id"), filled(df, "CLASS_CODE", "Class").alias("code")).where(
        "vendor_id is not null and code is not null").distinct()
    return rows.groupBy("vendor_id").agg(F.sort_array(F.collect_list("code")).alias("nigp_codes"))


def attach_codes(vendors: DataFrame, codes: DataFrame) -> DataFrame:
    new = codes.select("vendor_id", F.col("nigp_codes").alias("_codes"))
    old = F.col("nigp_codes") if "nigp_codes" in vendors.columns else F.lit(None).cast("array<string>")
    return vendors.join(new, "vendor_id", "left").withColumn("nigp_codes", F.coalesce("_codes", old)).drop("_codes")


def commodity_descriptions(book: DataFrame) -> DataFrame:
    """First description per class and item, and per class alone (item null)."""
    b = book.select(F.col("Class").alias("class_code"), F.col("Item").alias("item_code"), F.col("Description").alias("description"), "_pos")
    by_item = b.groupBy("class_code", "item_code").agg(F.min_by("description", "_pos").alias("description"))
    by_class = b.groupBy("class_code").agg(F.min_by("description", "_pos").alias("description"))
    return by_item.where("item_code is not null").unionByName(by_class.withColumn("item_code", F.lit(None).cast("string")))


def describe_code(book: DataFrame, class_code: str, item_code: str | None = None) -> DataFrame:
    hit = book.where(F.col("Class") == class_code)
    hit = hit if item_code is None else hit.where(F.col("Item") == item_code)
    return hit.orderBy("_pos").limit(1).select("Description")
