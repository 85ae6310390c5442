"""Screening against exclusion lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_vendor_name
from ..functions.scalars import first_places, severity
from ..functions.similarity import possible, ratio
from ..operators.fuzzy_join import fuzzy_pairs
from ..params import Params


def _active(t: dict) -> DataFrame:
    return t["debarred"].where(F.col("is_active"))


def debarred_matches(t: dict, p: Params) -> DataFrame:
    """(vendor, kind of match, excluded name or address): score, number of exclusions and the lowest of their ids.

    Equal names first; similar names only for vendors without an equal one; then equal addresses, less the
    exclusions the vendor already matched by name. Exclusions under one name or address are one row, so equal
    names or a shared mail drop never multiply.
    """
    paid = (
        t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.sum("amount").alias("total_payments"))
        .where(F.col("total_payments") >= p.debarment_min_payment)
    )
    vendors = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name_normalized").alias("vname"),
                                 normalize_vendor_name(F.col("address")).alias("vaddr")).join(paid, "vendor_id")
    listed = _active(t).select(F.col("id").alias("x_id"), F.col("name_normalized").alias("xname"),
                               normalize_vendor_name(F.col("address")).alias("xaddr"))
    names = listed.where(F.length("xname") > 0).groupBy("xname").agg(F.count("*").alias("exclusions"), F.min("x_id").alias("exclusion_id"))
    exact = vendors.join(names, F.col("vname") == F.col("xname")).withColumn("score", F.lit(1.0)).withColumn("match_type", F.lit("exact_name"))
    rest = vendors.where(F.length("vname") > 0).join(names.select(F.col("xname").alias("vname")), "vname", "left_anti")
    near = fuzzy_pairs(rest, "vname", names, "xname", p.debarment_name_similarity * 100)
    fuzzy = rest.join(near.select(F.col("left_name").alias("vname"), F.col("right_name").alias("xname"), (F.col("score") / 100).alias("score")), "vname").join(
        names, "xname").withColumn("match_type", F.lit("fuzzy_name"))
    cols = ["vendor_id", "match_type", F.col("xname").alias("matched"), "score", "exclusions", "exclusion_id", "total_payments"]
    by_name = exact.select(*cols).unionByName(fuzzy.select(*cols))

    at = listed.where(F.col("xaddr").isNotNull())
    per_address = at.groupBy("xaddr").agg(F.count("*").alias("here"), F.min("x_id").alias("exclusion_id"))
    per_both = at.where(F.length("xname") > 0).groupBy("xaddr", "xname").agg(F.count("*").alias("n"))
    known = (
        by_name.select("vendor_id", F.col("matched").alias("xname")).join(vendors.select("vendor_id", F.col("vaddr").alias("xaddr")), "vendor_id")
        .join(per_both, ["xaddr", "xname"]).groupBy("vendor_id").agg(F.sum("n").alias("known"))
    )
    left = F.col("here") - F.coalesce("known", F.lit(0))
    by_address = vendors.join(per_address, F.col("vaddr") == F.col("xaddr")).join(known, "vendor_id", "left").where(left > 0).select(
        "vendor_id", F.lit("address").alias("match_type"), F.col("xaddr").alias("matched"), F.lit(0.85).alias("score"),
        left.alias("exclusions"), "exclusion_id", "total_payments")
    return by_name.unionByName(by_address)


def debarred_vendors(t: dict, p: Params) -> DataFrame:
    """Findings of the screening, one per vendor and excluded name or address."""
    s = F.col("score")
    return debarred_matches(t, p).select(
        F.lit("debarred_vendor").alias("alert_type"),
        severity("low", ("medium", s >= 0.90), ("high", (s >= 0.95) | (F.col("match_type") == "exact_name"))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "match_type", "matched", "exclusion_id", "exclusions",
        F.round(s, 4).alias("match_score"), "total_payments")


def largest_payments(t: dict, findings: DataFrame, k: int | None = None) -> DataFrame:
    """The payments of each flagged vendor by amount, all or the k largest."""
    w = Window.partitionBy("vendor_id").orderBy(F.desc("amount"), "id")
    of = t["payment"].join(findings.select(F.col("entity_id").alias("vendor_id")).distinct(), "vendor_id", "left_semi")
    return first_places(of.withColumn("place", F.row_number().over(w)), k).select("vendor_id", "place", "id", "amount", "payment_date", "agency_id")


def _scored(listed: DataFrame, name, cutoff: float) -> DataFrame:
    key = F.coalesce("name_normalized", F.lit(""))
    score = F.when(F.col("_n") == key, F.lit(100.0)).otherwise(ratio(F.col("_n"), key))
    return (
        listed.withColumn("_n", name).where(possible(F.col("_n"), key, cutoff)).withColumn("score", score / 100)
        .where(F.col("score") >= cutoff / 100).withColumn("match_type", F.when(F.col("_n") == key, "exact").otherwise("fuzzy"))
        .select(F.col("id").alias("exclusion_id"), "entity_name", "source", "sam_number", "match_type", F.round("score", 4).alias("score"), "exclusion_type")
    )


def screen_vendor(t: dict, vendor_id: int, threshold: float = 0.85) -> DataFrame:
    """Active exclusions close to one vendor's name, best first."""
    name = t["vendor"].where(F.col("id") == vendor_id).select(F.coalesce("name_normalized", F.lit(""))).scalar()
    return _scored(_active(t), name, threshold * 100).orderBy(F.desc("score"), "exclusion_id")


def screen_name(t: dict, name: str, threshold: float = 0.90) -> DataFrame:
    """Active exclusions close to any given name, best first."""
    return _scored(_active(t), normalize_vendor_name(F.lit(name)), threshold * 100).orderBy(F.desc("score"), "exclusion_id")


def exclusion_stats(t: dict, alerts: DataFrame) -> DataFrame:
    """Rows (item, n): totals, active, per source, screening alerts."""
    d = t["debarred"]

    def one(label, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(label).alias("item"), "n")

    return one("total", d).unionByName(one("active", _active(t))).unionByName(
        d.groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("source "), "source").alias("item"), "n")).unionByName(
        one("alerts", alerts.where(F.col("alert_type") == "debarred_vendor")))
