"""Related parties: networks of vendors, employee-vendor-contributor triangles, shared paying agencies."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import first_places, severity
from ..operators.components import connected_components
from ..operators.fuzzy_join import fuzzy_fold, fuzzy_pairs
from ..operators.pair_folds import CommonPayers
from ..params import Params
from ..session import cut
from .clustering import graph_counts, name_cutoff, name_pair_counts, one_name_each, similar_names
from .network import vendor_links

_D = "decimal(38,2)"


def related_party_networks(t: dict, p: Params, pairs: DataFrame, members: DataFrame, matches: DataFrame, names: DataFrame | None,
                           graph: DataFrame | None = None) -> DataFrame:
    """Linked vendors, three or more, paid a lot together. matches: vendor to vendor entity matches. Similar names come as pairs (names)
    or as edges and counts (graph, of name_graph)."""
    vv = matches.where((F.col("entity_type_1") == "vendor") & (F.col("entity_type_2") == "vendor"))
    extra = vv.select(F.col("entity_id_1").alias("src"), F.col("entity_id_2").alias("dst"))
    label = connected_components(vendor_links(t, pairs, members, names, graph).unionByName(extra)).withColumnRenamed("node", "vendor_id")
    paid = t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.sum("amount").alias("paid"))
    per = (
        label.join(paid, "vendor_id", "left").groupBy("component")
        .agg(F.count("*").alias("network_size"), F.coalesce(F.sum("paid"), F.lit(0)).cast(_D).alias("total_value"))
        .where((F.col("network_size") >= p.related_party_min_network_size) & (F.col("total_value") >= p.related_party_min_value))
    )
    at = members.groupBy("address").agg(F.min("vendor_id").alias("vendor_id"), F.count("*").alias("n"))
    kinds = (
        pairs.select(F.col("vendor_id_1").alias("vendor_id"), F.col("relationship_type").alias("kind"), F.lit(1).cast("bigint").alias("n"))
        .unionByName(at.select("vendor_id", F.lit("same_address").alias("kind"), F.expr("n * (n - 1) div 2").alias("n")))
        .unionByName((name_pair_counts(t, names) if graph is None else graph_counts(graph)).select("vendor_id", F.lit("similar_name").alias("kind"), "n"))
        .unionByName(vv.select(F.col("entity_id_1").alias("vendor_id"), F.concat(F.lit("match "), "match_type").alias("kind"), F.lit(1).cast("bigint").alias("n")))
        .groupBy("vendor_id", "kind").agg(F.sum("n").alias("n")).join(label, "vendor_id")
        .groupBy("component", "kind").agg(F.sum("n").alias("n"))
        .groupBy("component").agg(F.count("*").alias("kinds"), F.sum("n").alias("relationship_count"))
    )
    return per.join(kinds, "component").select(
        F.lit("related_party_network").alias("alert_type"),
        severity("medium", ("high", (F.col("network_size") >= 5) | (F.col("total_value") >= 2000000) | (F.col("kinds") >= 3))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("component").alias("entity_id"), "network_size", "total_value", "kinds", "relationship_count")


def contributing_vendors(t: dict, p: Params) -> DataFrame:
    """Paid vendors with contributions under a similar name, all such contributor names added up."""
    gifts = (
        t["contribution"].where(F.length("contributor_normalized") > 0).groupBy(F.col("contributor_normalized").alias("right_name"))
        .agg(F.sum("contribution_amount").alias("given"), F.count("*").alias("gifts"))
    )
    paid = t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(
        F.sum("amount").alias("vendor_payments"), F.count("*").alias("payment_count")).where("vendor_payments <> 0")
    v = t["vendor"].where(F.length("name_normalized") > 0).select(F.col("id").alias("vendor_id"), "name_normalized").join(paid, "vendor_id")
    near = fuzzy_pairs(v, "name_normalized", gifts, "right_name", p.triangle_similarity * 100)
    named = v.join(near.withColumnRenamed("left_name", "name_normalized"), "name_normalized").join(gifts, "right_name")
    return named.groupBy("vendor_id").agg(
        F.sum("given").alias("total_contributions"), F.sum("gifts").alias("contribution_count"),
        F.first("vendor_payments").alias("vendor_payments"), F.first("payment_count").alias("payment_count"))


def contributor_triangles(t: dict, p: Params, name_matches: DataFrame, address_matches: DataFrame) -> DataFrame:
    """Employees tied to a paid vendor that also contributes.

    name_matches: (employee_id, vendor_id). address_matches: (address, side, id) with side employee or vendor; of the
    vendors at an address the one paid most is named, so no pairs within an address are built.
    """
    rich = cut(contributing_vendors(t, p))
    by_name = name_matches.select("employee_id", "vendor_id", F.lit("name").alias("match_type"))
    best = (
        address_matches.where("side = 'vendor'").select("address", F.col("id").alias("vendor_id")).join(rich, "vendor_id")
        .groupBy("address").agg(F.max(F.struct("vendor_payments", "vendor_id")).alias("b")).select("address", F.col("b.vendor_id").alias("vendor_id"))
    )
    by_address = address_matches.where("side = 'employee'").select("address", F.col("id").alias("employee_id")).join(best, "address").select(
        "employee_id", "vendor_id", F.lit("address").alias("match_type"))
    return by_name.unionByName(by_address).join(rich, "vendor_id").select(
        F.lit("employee_vendor_contributor_triangle").alias("alert_type"),
        severity("medium", ("high", (F.col("total_contributions") >= 10000) | (F.col("vendor_payments") >= 500000))).alias("severity"),
        F.lit("employee").alias("entity_type"), F.col("employee_id").alias("entity_id"), "vendor_id", "match_type",
        "vendor_payments", "payment_count", "contribution_count", "total_contributions")


def triangle_recipients(t: dict, p: Params, triangles: DataFrame, k: int | None = None) -> DataFrame:
    """Who received the contributions of each vendor in a triangle by amount, all or the first k."""
    names = cut(t["vendor"].join(triangles.select(F.col("vendor_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("vendor_id"), "name_normalized"))
    gifts = t["contribution"].where(F.length("contributor_normalized") > 0)
    near = fuzzy_pairs(names, "name_normalized", gifts, "contributor_normalized", p.triangle_similarity * 100)
    per = gifts.groupBy(F.col("contributor_normalized").alias("right_name"), "filer_name").agg(F.sum("contribution_amount").alias("amount"))
    total = names.join(near.withColumnRenamed("left_name", "name_normalized"), "name_normalized").join(per, "right_name").groupBy(
        "vendor_id", "filer_name").agg(F.sum("amount").alias("amount"))
    w = Window.partitionBy("vendor_id").orderBy(F.desc("amount"), "filer_name")
    return first_places(total.withColumn("place", F.row_number().over(w)), k)


def _named_payees(t: dict, paid: DataFrame) -> DataFrame:
    named = t["vendor"].where(F.col("name_normalized").isNotNull()).select(F.col("id").alias("vendor_id"), F.col("name_normalized").alias("name"))
    return named.join(paid, "vendor_id")


def _circles(mine: DataFrame, p: Params, names: DataFrame) -> DataFrame:
    """Vendors and similar names by what both got from the agencies they share, joined to pairs of names."""
    theirs = mine.groupBy(F.col("name").alias("other_name"), "agency_id").agg(F.min("vendor_id").alias("low"), F.sum("payment_total").alias("pool"))
    alike = names.where(F.col("confidence_score") >= p.circular_min_confidence).select("name", "other_name")
    return (
        mine.join(alike, "name").join(theirs, ["other_name", "agency_id"]).groupBy("vendor_id", "other_name")
        .agg(F.min("low").alias("related_vendor_id"), F.count("*").alias("common_agencies"), F.sum("payment_total").cast(_D).alias("total_1"), F.sum("pool").cast(_D).alias("total_2"))
        .select(F.col("vendor_id").alias("entity_id"), "related_vendor_id", F.lit("similar_name").alias("relationship_type"), "common_agencies", "total_1", "total_2"))


def name_circles(t: dict, p: Params, edges: DataFrame) -> DataFrame:
    """Vendors of similar names that share agencies and got enough from them, as circular_patterns takes them.

    Names carry what their vendors got from each agency, so pairs are judged where they are found. Only a vendor id of several rows, whose
    names would have to be taken together, and amounts that aren't decimals need the pairs themselves.
    """
    mine = _named_payees(t, edges.where("payment_count > 0").select("vendor_id", "agency_id", "payment_total"))
    kind = edges.schema["payment_total"].dataType
    if not isinstance(kind, T.DecimalType) or not one_name_each(t):
        return _circles(mine, p, cut(similar_names(t, p)))
    unit = 10**kind.scale
    cents = (F.col("payment_total") * F.lit(unit)).cast("bigint").alias("paid")
    lists = cut(mine.where("name <> ''").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("vendor_id", "agency_id", cents))).alias("l")).select(
        "name", F.col("l.vendor_id").alias("vendors"), F.col("l.agency_id").alias("payers"), F.col("l.paid").alias("paid")))
    least = int(-(-p.circular_min_total * unit // 1))
    found = fuzzy_fold(lists, lists, name_cutoff(p), partial(CommonPayers, least, p.circular_min_confidence))
    amount = lambda c: (F.col(c).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-kind.scale))).cast(_D)
    return found.select("entity_id", F.col("low").alias("related_vendor_id"), F.lit("similar_name").alias("relationship_type"), F.col("common").alias("common_agencies"),
                        amount("paid").alias("total_1"), amount("pool").alias("total_2"))


def circular_patterns(t: dict, p: Params, edges: DataFrame, pairs: DataFrame, members: DataFrame, names: DataFrame | None = None,
                      circles: DataFrame | None = None) -> DataFrame:
    """Related vendors well paid by the same agencies. Similar names come as pairs (names) or judged already (circles, of name_circles).

    Pairs of neighbouring ids are compared pair by pair. A vendor is compared with all others of its address, and with
    all vendors of a similar name, taken together: the same for two vendors, and for more it flags every vendor of every
    pair that qualifies. related_vendor_id is the lowest id of a similar name among the payees.
    """
    paid = edges.where("payment_count > 0").select("vendor_id", "agency_id", "payment_total")
    e1 = paid.toDF("vendor_id_1", "agency_id", "paid_1")
    e2 = paid.toDF("vendor_id_2", "agency_id", "paid_2")
    close = pairs.where(F.col("confidence_score") >= p.circular_min_confidence).select("vendor_id_1", "vendor_id_2", "relationship_type")
    both = (
        close.join(e1, "vendor_id_1").join(e2, ["vendor_id_2", "agency_id"])
        .groupBy("vendor_id_1", "vendor_id_2", "relationship_type")
        .agg(F.count("*").alias("common_agencies"), F.sum("paid_1").alias("total_1"), F.sum("paid_2").alias("total_2"))
        .select(F.col("vendor_id_1").alias("entity_id"), F.col("vendor_id_2").alias("related_vendor_id"), "relationship_type",
                "common_agencies", F.col("total_1").cast(_D).alias("total_1"), F.col("total_2").cast(_D).alias("total_2"))
    )
    if names is not None:
        both = both.unionByName(_circles(_named_payees(t, paid), p, names))
    if circles is not None:
        both = both.unionByName(circles)
    at = members.select("address", "vendor_id").join(paid, "vendor_id")
    pool = at.groupBy("address", "agency_id").agg(F.count("*").alias("payees"), F.sum("payment_total").alias("pool")).where("payees > 1")
    here = (
        at.join(pool, ["address", "agency_id"]).groupBy("address", "vendor_id")
        .agg(F.count("*").alias("common_agencies"), F.sum("payment_total").cast(_D).alias("total_1"),
             F.sum(F.col("pool") - F.col("payment_total")).cast(_D).alias("total_2"))
        .select(F.col("vendor_id").alias("entity_id"), F.lit(None).cast("bigint").alias("related_vendor_id"),
                F.lit("same_address").alias("relationship_type"), "common_agencies", "total_1", "total_2")
    )
    found = both.unionByName(here).where((F.col("total_1") >= p.circular_min_total) & (F.col("total_2") >= p.circular_min_total))
    return found.select(
        F.lit("circular_payment_pattern").alias("alert_type"),
        severity("medium", ("high", (F.col("common_agencies") >= 3) | (F.col("total_1") + F.col("total_2") >= 1000000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), "entity_id", "related_vendor_id", "relationship_type", "common_agencies", "total_1", "total_2")
