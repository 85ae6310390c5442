"""Cross checks against addresses, employees, contributions and permits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_vendor_name
from ..functions.scalars import first_places, severity, share
from ..functions.similarity import possible, ratio
from ..operators.fuzzy_join import fuzzy_pairs
from ..params import Params


def _sum_by_vendor(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.sum(value).alias(name))


def _key():
    return F.coalesce("name_normalized", normalize_vendor_name(F.col("name")))


def raw_address_clusters(t: dict, p: Params, open_alerts: DataFrame | None = None) -> DataFrame:
    """Three or more vendors with exactly one address, city and state."""
    v = t["vendor"].where((F.length("address") > 0) & F.col("city").isNotNull()).select(F.col("id").alias("vendor_id"), "address", "city", "state")
    per = (
        v.join(_sum_by_vendor(t["payment"], "amount", "paid"), "vendor_id", "left")
        .join(_sum_by_vendor(t["contract"], "current_value", "worth"), "vendor_id", "left")
        .groupBy("address", "city", "state")
        .agg(F.count("*").alias("vendor_count"), F.min("vendor_id").alias("first_vendor"),
             F.coalesce(F.sum("paid"), F.lit(0)).alias("total_payments"), F.coalesce(F.sum("worth"), F.lit(0)).alias("total_contracts"))
        .where("vendor_count >= 3")
    )
    if open_alerts is not None:
        known = open_alerts.where(F.col("alert_type") == "address_cluster").select(
            *[F.get_json_object("evidence", f"$.{c}").alias(f"_{c}") for c in ("address", "city", "state")]).distinct()
        same = (F.col("address") == F.col("_address")) & (F.coalesce("_city", "city") == F.col("city")) & F.coalesce("_state", "state").eqNullSafe(F.col("state"))
        per = per.join(known, same, "left_anti")
    both = F.col("total_payments") + F.col("total_contracts")
    return per.select(
        F.lit("address_cluster").alias("alert_type"), severity("low", ("medium", both > 100000), ("high", both > 1000000)).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("first_vendor").alias("entity_id"), "address", "city", "state", "vendor_count",
        "total_payments", "total_contracts")


def raw_address_vendors(t: dict, findings: DataFrame, k: int | None = None) -> DataFrame:
    """The vendors of each clustered address by id, all or the first k."""
    f = findings.select(F.col("address").alias("a"), F.col("city").alias("c"), F.col("state").alias("s"))
    v = t["vendor"]
    at = v.join(f, (v["address"] == f["a"]) & (v["city"] == f["c"]) & v["state"].eqNullSafe(f["s"]), "left_semi")
    w = Window.partitionBy("address", "city", "state").orderBy("id")
    return first_places(at.withColumn("place", F.row_number().over(w)), k).select("address", "city", "state", "place", "id", "vendor_id", "name")


def employee_vendor_scan(t: dict, p: Params) -> DataFrame:
    """Older employee check: listed or scored vendors, all matches, a row per employee and vendor; an alert from 95 percent."""
    v = t["vendor"].where(F.col("in_cmbl") | F.col("risk_score").isNotNull()).select(F.col("id").alias("vendor_id"), _key().alias("right_name"))
    e = t["employee"].select(F.col("id").alias("employee_id"), _key().alias("left_name"))
    near = fuzzy_pairs(e, "left_name", v, "right_name", p.name_match_threshold)
    return e.join(near, "left_name").join(v, "right_name").select(
        "employee_id", "vendor_id", F.round(F.col("score") / 100, 4).alias("confidence"), (F.col("score") >= 95).alias("alerting"))


def pay_to_play(t: dict, p: Params) -> DataFrame:
    """Contributors whose name is close to a vendor's: a row per contributor name and vendor, every vendor of a name included."""
    gifts = (
        t["contribution"].where((F.col("contribution_amount") >= p.min_single_contribution) & (F.length("contributor_normalized") > 0))
        .groupBy(F.col("contributor_normalized").alias("contributor_name"))
        .agg(F.sum("contribution_amount").alias("total_contributions"), F.count_distinct("filer_name").alias("recipients"))
        .where(F.col("total_contributions") >= p.min_contribution_for_alert)
    )
    holder = t["vendor"].where(F.length("name_normalized") > 0).select("name_normalized", F.col("id").alias("vendor_id"))
    near = fuzzy_pairs(gifts, "contributor_name", holder, "name_normalized", p.name_match_threshold)
    paid, worth = F.coalesce("paid", F.lit(0)), F.coalesce("worth", F.lit(0))
    roi = share(paid + worth, F.col("total_contributions"))
    return (
        near.withColumnRenamed("left_name", "contributor_name").withColumnRenamed("right_name", "name_normalized")
        .join(gifts, "contributor_name").join(holder, "name_normalized")
        .join(_sum_by_vendor(t["payment"], "amount", "paid"), "vendor_id", "left")
        .join(_sum_by_vendor(t["contract"], "current_value", "worth"), "vendor_id", "left")
        .select(F.lit("pay_to_play").alias("alert_type"), severity("low", ("medium", roi > 10), ("high", roi > 100)).alias("severity"),
                F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "contributor_name", "total_contributions",
                "recipients", paid.alias("vendor_payments"), worth.alias("vendor_contracts"), F.round("score", 2).alias("match_score"),
                F.round(roi, 4).alias("roi"))
    )


def contribution_recipients(t: dict, p: Params, findings: DataFrame, k: int | None = None) -> DataFrame:
    """The recipients of each flagged contributor by name, all or the first k."""
    g = t["contribution"].where(F.col("contribution_amount") >= p.min_single_contribution).select(
        F.col("contributor_normalized").alias("contributor_name"), "filer_name").distinct()
    w = Window.partitionBy("contributor_name").orderBy("filer_name")
    of = g.join(findings.select("contributor_name").distinct(), "contributor_name", "left_semi")
    return first_places(of.withColumn("place", F.row_number().over(w)), k)


def unregistered_vendors(t: dict, p: Params) -> DataFrame:
    """Paid in-state vendors, off the bidder list, with no permit holder of a similar name."""
    permits = t["tax_permit"].where(F.length("taxpayer_normalized") > 0)
    v = t["vendor"].where(~F.col("in_cmbl") & (F.col("state") == "TX")).select(
        F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"), _key().alias("left_name"))
    paid = _sum_by_vendor(t["payment"], "amount", "total_payments").where(F.col("total_payments") >= p.ghost_vendor_min_amount)
    suspects = v.join(paid, "vendor_id")
    total = F.col("total_payments")
    shape = [F.lit("ghost_vendor").alias("alert_type"), severity("low", ("medium", total > 25000), ("high", total > 100000)).alias("severity"),
             F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "total_payments"]
    hits = fuzzy_pairs(suspects, "left_name", permits, "taxpayer_normalized", 90).select("left_name").distinct()
    some = permits.limit(1).agg(F.count("*").alias("n")).scalar()  # without any permit on file nobody is flagged
    return suspects.join(hits, "left_name", "left_anti").where(some > 0).select(*shape)


def entity_network(t: dict, vendor_id: int, entity_matches: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """Everything tied to one vendor as rows (kind, id, label, score)."""
    me = t["vendor"].where(F.col("id") == vendor_id)
    others = t["vendor"].where(F.col("id") != vendor_id)
    mine = me.select(F.col("address").alias("a"), F.col("city").alias("c"), _key().alias("n"), F.lit(1).alias("one"))
    none = F.lit(None).cast("double")

    def row(kind: str, id_, label, score=none):
        return [F.lit(kind).alias("kind"), F.col(id_).cast("bigint").alias("id"), F.col(label).alias("label"), score.alias("score")]

    near = others.join(mine, (F.col("address") == F.col("a")) & (F.col("city") == F.col("c")) & (F.length("address") > 0), "left_semi")
    name = me.select(_key().alias("n")).scalar()
    alike = (
        others.where(F.col("name_normalized").isNotNull()).withColumn("n", name)
        .where(possible(F.col("n"), F.col("name_normalized"), 85)).withColumn("s", ratio(F.col("n"), F.col("name_normalized")))
        .where("s >= 85 and s < 100")
    )
    out = near.select(*row("same_address", "id", "name")).unionByName(
        alike.select(*row("similar_name", "id", "name", F.round("s", 4)))).unionByName(
        t["contract"].where(F.col("vendor_id") == vendor_id).select(*row("contract", "id", "contract_number")))
    count = near.agg(F.count("*").alias("id")).where("id >= 2").withColumn("label", F.format_string("Shares address with %d other vendors", "id"))
    out = out.unionByName(count.select(*row("risk", "id", "label")))
    if entity_matches is not None:
        m = entity_matches.where((F.col("entity_type_1") == "employee") & (F.col("entity_type_2") == "vendor") & (F.col("entity_id_2") == vendor_id))
        e = t["employee"].select(F.col("id").alias("entity_id_1"), F.col("name").alias("who"))
        out = out.unionByName(m.join(e, "entity_id_1").select(*row("employee", "entity_id_1", "who", F.col("confidence_score").cast("double"))))
    if alerts is not None:
        a = alerts.where((F.col("entity_type") == "vendor") & (F.col("entity_id") == vendor_id))
        out = out.unionByName(a.withColumn("what", F.concat(F.upper("severity"), F.lit(": "), "title")).select(*row("alert", "id", "what")))
    return out
