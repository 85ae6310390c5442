"""The vendor and agency network: spending edges, hubs, clusters, exclusive agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_places, severity, share
from ..functions.similarity import ratio
from ..operators.components import connected_components
from ..operators.fuzzy_join import fuzzy_fold_within
from ..operators.pair_folds import Crossings
from ..params import Params
from ..session import cut
from .clustering import graph_counts, graph_links, name_cutoff, name_graph, name_links, name_pair_counts, name_pairs, one_name_each, vendors_of_similar_names


def spending_edges(t: dict) -> DataFrame:
    """One row per vendor and agency with payment and contract counts and sums."""

    def side(df: DataFrame, value: str, n: str, total: str) -> DataFrame:
        return df.where(F.col("vendor_id").isNotNull() & F.col("agency_id").isNotNull()).groupBy("vendor_id", "agency_id").agg(
            F.count("*").alias(n), F.sum(value).alias(total))

    pay = side(t["payment"], "amount", "payment_count", "payment_total")
    con = side(t["contract"], "current_value", "contract_count", "contract_value")
    vendors = t["vendor"].select(F.col("id").alias("vendor_id"))
    agencies = t["agency"].select(F.col("id").alias("agency_id"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("payment_count", "payment_total", "contract_count", "contract_value")}
    return (
        pay.join(con, ["vendor_id", "agency_id"], "full_outer").join(vendors, "vendor_id", "left_semi").join(agencies, "agency_id", "left_semi")
        .select("vendor_id", "agency_id", *zero.values())
    )


def vendor_links(t: dict, pairs: DataFrame, members: DataFrame, names: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """Vendor to vendor edges that span the same components as all pairs: pairs, a star per address, a star per similar name.

    Similar names come as pairs (names) or as edges already (graph, of name_graph).
    """
    star = members.groupBy("address").agg(F.min("vendor_id").alias("src"))
    links = pairs.select(F.col("vendor_id_1").alias("src"), F.col("vendor_id_2").alias("dst")).unionByName(
        members.join(star, "address").where("vendor_id <> src").select("src", F.col("vendor_id").alias("dst")))
    if graph is not None:
        return links.unionByName(graph_links(graph))
    return links if names is None else links.unionByName(name_links(t, names))


def linked_vendors(t: dict, pairs: DataFrame, members: DataFrame, names: DataFrame | None, p: Params | None = None) -> DataFrame:
    """Every link once: the pairs, every two vendors of similar names, a star per address. For components vendor_links is enough.

    Without names, pairs of names as of similar_names, the names are compared here. Their vendors then are met once by themselves,
    so only links of the other kinds are looked at for being of similar names, too.
    """
    links = vendor_links(t, pairs, members)
    if names is not None:
        return links.unionByName(name_pairs(t, names)).distinct()
    alike = vendors_of_similar_names(t, p)
    if not one_name_each(t):
        return links.unionByName(alike).distinct()
    v = t["vendor"].select("id", "name_normalized")
    named = links.distinct().join(v.toDF("src", "name"), "src", "left").join(v.toDF("dst", "other_name"), "dst", "left")
    return named.where(~similar(F.col("name"), F.col("other_name"), p)).select("src", "dst").unionByName(alike)


def similar(a: Column, b: Column, p: Params) -> Column:
    """Whether similar_names has the pair; false where a name is missing."""
    said = (F.length(a) > 0) & (F.length(b) > 0) & (a != b)
    return F.coalesce(said & (ratio(a, b) >= name_cutoff(p)), F.lit(False))


def hub_vendors(t: dict, p: Params, edges: DataFrame) -> DataFrame:
    """Vendors dealing with far more agencies than the mean."""
    degree = edges.groupBy("vendor_id").agg(F.count("*").alias("agency_count"), F.sum("payment_total").alias("total_value"))
    mean, sd = F.avg("agency_count"), F.stddev_pop(F.col("agency_count").cast("double"))
    limit = degree.agg((mean + p.hub_sigmas * sd).alias("x")).scalar()
    strong = degree.agg((mean + (p.hub_sigmas + 1) * sd).alias("x")).scalar()
    v = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    hubs = degree.where((F.col("agency_count") > limit) & (F.col("agency_count") >= p.hub_min_degree))
    return hubs.join(v, "vendor_id").select(
        F.lit("hub_vendor").alias("alert_type"), severity("low", ("medium", F.col("agency_count") >= strong)).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "vendor_name", "agency_count", "total_value")


def hub_agencies(edges: DataFrame, hubs: DataFrame, k: int | None = None) -> DataFrame:
    """The agencies of each hub by what they pay, all or the first k."""
    w = Window.partitionBy("vendor_id").orderBy(F.desc("payment_total"), "agency_id")
    of = edges.join(hubs.select(F.col("entity_id").alias("vendor_id")), "vendor_id", "left_semi")
    return first_places(of.withColumn("place", F.row_number().over(w)), k)


def vendor_clusters(t: dict, p: Params, edges: DataFrame, pairs: DataFrame, members: DataFrame, names: DataFrame | None = None,
                    graph: DataFrame | None = None) -> DataFrame:
    """Small groups of linked vendors that share an agency. Similar names as for vendor_links."""
    label = connected_components(vendor_links(t, pairs, members, names, graph)).withColumnRenamed("node", "vendor_id")
    sized = label.groupBy("component").agg(F.count("*").alias("vendor_count")).where(
        F.col("vendor_count").between(p.cluster_min_size, p.cluster_max_size))
    shared = (
        label.join(sized, "component").join(edges, "vendor_id").groupBy("component", "vendor_count", "agency_id")
        .agg(F.count("*").alias("at"), F.sum("payment_total").alias("paid"))
        .groupBy("component", "vendor_count").agg(F.count_if(F.col("at") >= 2).alias("common_agencies"), F.sum("paid").alias("total_value"))
        .where("common_agencies > 0")
    )
    return shared.select(
        F.lit("vendor_cluster").alias("alert_type"),
        severity("medium", ("high", (F.col("vendor_count") >= 5) & (F.col("total_value") >= 1000000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("component").alias("entity_id"), "vendor_count", "common_agencies", "total_value")


def exclusive_relationships(t: dict, p: Params, edges: DataFrame) -> DataFrame:
    """Agencies that pay nearly everything to one vendor."""
    per = edges.groupBy("agency_id").agg(
        F.sum("payment_total").alias("total_value"), F.count("*").alias("vendor_count"),
        F.max(F.struct("payment_total", (-F.col("vendor_id")).alias("neg"))).alias("top"))
    part = share(F.col("top.payment_total"), F.col("total_value"))
    a = t["agency"].select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))
    hit = per.where((F.col("total_value") >= p.exclusive_min_total) & (part >= p.exclusive_share))
    return hit.join(a, "agency_id").select(
        F.lit("exclusive_relationship").alias("alert_type"),
        severity("medium", ("high", (part >= 0.95) | (F.col("top.payment_total") >= 5000000))).alias("severity"),
        F.lit("agency").alias("entity_type"), F.col("agency_id").alias("entity_id"), "agency_name",
        (-F.col("top.neg")).alias("top_vendor_id"), F.col("top.payment_total").alias("top_vendor_value"), "total_value",
        "vendor_count", F.round(part * 100, 1).alias("top_vendor_share"))


def linked_pair_count(t: dict, pairs: DataFrame, members: DataFrame, names: DataFrame | None, p: Params | None = None, graph: DataFrame | None = None) -> DataFrame:
    """Distinct linked vendor pairs, counted by group: pairs of an address, pairs of similar names elsewhere, other pairs.

    Without names, pairs of names as of similar_names, their number is read off a graph (of name_graph), and only names of one
    address and those of other pairs are compared again.
    """
    per = members.groupBy("address").agg(F.count("*").alias("n"))
    by_address = per.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
    counts = graph_counts(graph) if names is None else name_pair_counts(t, names)
    by_name = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    v = t["vendor"].select(F.col("id").alias("vendor_id"), F.col("name_normalized").alias("name"))
    here = members.select("address", "vendor_id").join(v, "vendor_id").groupBy("address", "name").agg(F.count("*").alias("n"))
    if names is None:
        place = cut(here.select("address").distinct().withColumn("place", F.monotonically_increasing_id()))
        at = here.where(F.length("name") > 0).join(place, "address").select("name", "place", F.col("n").alias("rows"))
        twice = fuzzy_fold_within(at, "place", name_cutoff(p), Crossings).agg(F.coalesce(-F.sum("n"), F.lit(0)).alias("pairs"))
    else:
        twice = here.join(names.where("name < other_name"), "name").join(
            here.select("address", F.col("name").alias("other_name"), F.col("n").alias("m")), ["address", "other_name"]).agg(
            F.coalesce(-F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))

    def side(n: int) -> DataFrame:
        return v.join(members.select("vendor_id", "address"), "vendor_id", "left").select(
            F.col("vendor_id").alias(f"vendor_id_{n}"), F.col("name").alias("name" if n == 1 else "other_name"), F.col("address").alias(f"a{n}"))

    other = pairs.select("vendor_id_1", "vendor_id_2").distinct().join(side(1), "vendor_id_1", "left").join(side(2), "vendor_id_2", "left")
    apart = other.where(~F.coalesce(F.col("a1") == F.col("a2"), F.lit(False)))
    rest = (apart.where(~similar(F.col("name"), F.col("other_name"), p)) if names is None else apart.join(names, ["name", "other_name"], "left_anti")).agg(F.count("*").alias("pairs"))
    return by_address.unionByName(by_name).unionByName(twice).unionByName(rest).agg(F.sum("pairs").alias("pairs"))


def network_stats(t: dict, edges: DataFrame, pairs: DataFrame, members: DataFrame, names: DataFrame | None, p: Params | None = None) -> DataFrame:
    """One row: nodes, edges, mean degrees and number of connected parts, lone nodes included. Without names, pairs of names as of
    similar_names, the names are compared here."""
    vendors, agencies = t["vendor"].select("id"), t["agency"].select("id")
    graph = cut(name_graph(t, p)) if names is None else None

    def node(kind: str, c: str):
        return F.concat(F.lit(kind), F.col(c).cast("string"))

    links = vendor_links(t, pairs, members, names, graph).select(node("v", "src").alias("src"), node("v", "dst").alias("dst")).unionByName(
        edges.select(node("v", "vendor_id").alias("src"), node("a", "agency_id").alias("dst")))
    parts = connected_components(links)
    one = [
        vendors.agg(F.count("*").alias("n")).select(F.lit("vendors").alias("k"), "n"),
        agencies.agg(F.count("*").alias("n")).select(F.lit("agencies").alias("k"), "n"),
        edges.agg(F.count("*").alias("n")).select(F.lit("spend").alias("k"), "n"),
        linked_pair_count(t, pairs, members, names, p, graph).select(F.lit("links").alias("k"), F.col("pairs").cast("bigint").alias("n")),
        parts.agg(F.count("*").alias("n")).select(F.lit("touched").alias("k"), "n"),
        parts.agg(F.count_distinct("component").alias("n")).select(F.lit("parts").alias("k"), "n"),
    ]
    all_ = one[0]
    for o in one[1:]:
        all_ = all_.unionByName(o)
    row = all_.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("vendors", "agencies", "spend", "links", "touched", "parts")])
    return row.select(
        (F.col("vendors") + F.col("agencies")).alias("total_nodes"), (F.col("spend") + F.col("links")).alias("total_edges"),
        F.col("vendors").alias("vendor_count"), F.col("agencies").alias("agency_count"),
        F.coalesce(share(F.col("spend") + 2 * F.col("links"), F.col("vendors")), F.lit(0.0)).alias("avg_vendor_degree"),
        F.coalesce(share(F.col("spend"), F.col("agencies")), F.lit(0.0)).alias("avg_agency_degree"),
        (F.col("parts") + F.col("vendors") + F.col("agencies") - F.col("touched")).alias("connected_components"))
