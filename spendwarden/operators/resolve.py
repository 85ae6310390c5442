"""Names in source rows to vendor and agency ids, creating entries for names not seen before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_vendor_name
from ..functions.scalars import initials_code
from ..session import cut


def surrogate_id(*cols):
    """Stable id of a natural key, non-negative."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


def with_vendor_key(rows: DataFrame, name: str = "vendor_name") -> DataFrame:
    return rows.withColumn("vendor_key", normalize_vendor_name(F.nullif(F.col(name), F.lit(""))))


def new_vendors(rows: DataFrame, vendors: DataFrame, as_of: dt.date, name: str = "vendor_name") -> DataFrame:
    """A vendor for every cleaned name the vendor table lacks; the first row's spelling gives the name."""
    spelled = cut(rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("_pos").alias("_pos")))  # a spelling is cleaned once, not row by row
    keyed = with_vendor_key(spelled, name).where(F.col("vendor_key").isNotNull())
    fresh = keyed.groupBy("vendor_key").agg(F.min_by(name, "_pos").alias("name"))
    known = vendors.select(F.col("name_normalized").alias("vendor_key")).where(F.col("vendor_key").isNotNull()).distinct()
    day = F.lit(as_of)
    return fresh.join(known, "vendor_key", "left_anti").select(
        surrogate_id(F.lit("vendor"), F.col("vendor_key")).alias("id"), "name", F.col("vendor_key").alias("name_normalized"),
        F.lit(False).alias("in_cmbl"), day.alias("first_seen"), day.alias("last_seen"))


def link_vendors(rows: DataFrame, vendors: DataFrame, name: str = "vendor_name") -> DataFrame:
    """vendor_id by equality of cleaned names; null where unknown. The lowest id holds a shared name."""
    holder = vendors.where(F.col("name_normalized").isNotNull()).groupBy(F.col("name_normalized").alias("vendor_key")).agg(F.min("id").alias("vendor_id"))
    spelled = cut(rows.where(F.col(name).isNotNull()).select(F.col(name).alias("_spelled")).distinct())  # a spelling is cleaned once, not row by row
    known = with_vendor_key(spelled, "_spelled").join(holder, "vendor_key").select("_spelled", "vendor_id")
    return rows.join(known, F.col(name) == F.col("_spelled"), "left").drop("_spelled")


def resolve_vendors(rows: DataFrame, vendors: DataFrame, as_of: dt.date, name: str = "vendor_name") -> tuple[DataFrame, DataFrame]:
    """(rows with vendor_id, vendor table with the new entries)."""
    table = vendors.unionByName(new_vendors(rows, vendors, as_of, name), allowMissingColumns=True)
    return link_vendors(rows, table, name), table


def _agency_keys(rows: DataFrame, by_code: bool) -> DataFrame:
    name = F.nullif(F.col("agency_name"), F.lit(""))
    made = initials_code(name)
    if by_code and "agency_code" in rows.columns:
        made = F.coalesce(F.nullif(F.trim("agency_code"), F.lit("")), made)
    return rows.withColumn("_name", name).withColumn("_code", F.when(name.isNotNull(), made))


def link_agencies(rows: DataFrame, agencies: DataFrame, by_code: bool = True) -> DataFrame:
    """agency_id by code, then by name; only by name where by_code is off."""
    codes = agencies.groupBy(F.col("agency_code").alias("_code")).agg(F.min("id").alias("_by_code"))
    names = agencies.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_by_name"))
    out = _agency_keys(rows, by_code).join(names, "_name", "left")
    if by_code:
        out = out.join(codes, "_code", "left").withColumn("agency_id", F.coalesce("_by_code", "_by_name")).drop("_by_code")
    else:
        out = out.withColumn("agency_id", F.col("_by_name"))
    return out.drop("_name", "_code", "_by_name")


def new_agencies(rows: DataFrame, agencies: DataFrame, by_code: bool = True) -> DataFrame:
    """Agencies the table lacks: the first row of each code, then of each name."""
    seen = _agency_keys(rows, by_code).where(F.col("_name").isNotNull()).groupBy("_code", "_name").agg(F.min("_pos").alias("_pos"))
    seen = seen.join(agencies.select(F.col("name").alias("_name")), "_name", "left_anti")
    if by_code:
        seen = seen.join(agencies.select(F.col("agency_code").alias("_code")), "_code", "left_anti")
        seen = seen.groupBy("_code").agg(F.min_by("_name", "_pos").alias("_name"), F.min("_pos").alias("_pos"))
    first = seen.groupBy("_name").agg(F.min_by("_code", "_pos").alias("_code"))
    return first.select(surrogate_id(F.lit("agency"), F.col("_name")).alias("id"), F.col("_code").alias("agency_code"), F.col("_name").alias("name"))


def resolve_agencies(rows: DataFrame, agencies: DataFrame, by_code: bool = True) -> tuple[DataFrame, DataFrame]:
    table = agencies.unionByName(new_agencies(rows, agencies, by_code), allowMissingColumns=True)
    return link_agencies(rows, table, by_code), table


def coded_agencies(rows: DataFrame, agencies: DataFrame, prefix: str = "FED_", separator: str = "_") -> DataFrame:
    """New agencies with codes made unique by numbering: base, base2, base3 and so on, whichever are free."""
    fresh = rows.select(F.nullif(F.col("agency_name"), F.lit("")).alias("name")).where(F.col("name").isNotNull()).distinct().join(
        agencies.select("name"), "name", "left_anti")
    fresh = fresh.withColumn("base", F.concat(F.lit(prefix), initials_code(F.col("name"))))
    # a code stands for itself and, with a number at its end, for a numbered one of the code before it
    end = F.regexp_extract("agency_code", rf"{separator}(\d+)$", 1)
    numbers = agencies.select(F.col("agency_code").alias("base"), F.lit(1).alias("n")).unionByName(
        agencies.withColumn("_end", end).select(F.regexp_replace("agency_code", rf"{separator}\d+$", "").alias("base"), F.col("_end").try_cast("int").alias("n")).where("n >= 2"))
    used = numbers.groupBy("base").agg(F.sort_array(F.collect_set("n")).alias("used"))
    w = Window.partitionBy("base").orderBy("name")
    place = F.row_number().over(w)
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("place"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    numbered = fresh.join(used, "base", "left").withColumn("place", place).withColumn("n", free)
    code = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(separator), F.col("n").cast("string")))
    return numbered.select(surrogate_id(F.lit("agency"), F.col("name")).alias("id"), code.alias("agency_code"), "name", F.lit("federal").alias("category"))
