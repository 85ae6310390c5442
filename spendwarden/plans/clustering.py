"""Vendors that may be one party: same address, similar name, neighbouring ids.

Shared addresses are kept as membership rows (address, vendor), similar names as rows (name, other name): vendors belong to
a name by their cleaned name. Neither is ever spread to all pairs of vendors. A vendor is judged against all vendors of an
address or of a similar name at once, and where edges are wanted the members of a group are tied to its lowest vendor id.

Pairs of similar names grow with the square of the names where names are much alike. A rule by itself therefore works out what it
wants of them where they are found (name_graph, vendors_of_similar_names and the like); pairs are stored only to be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import normalize_address, parse_full_address
from ..functions.scalars import severity
from ..functions.similarity import possible, ratio
from ..operators.components import thinned
from ..operators.fuzzy_join import fuzzy_fold, fuzzy_pairs
from ..operators.pair_folds import Elsewhere, NameGraph, VendorNames, VendorPairs
from ..params import Params
from ..session import cut


def _key_name():
    return F.coalesce("name_normalized", "name")


def _paid(t: dict) -> DataFrame:
    return t["payment"].where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.sum("amount").alias("paid"))


def address_members(t: dict) -> DataFrame:
    """(address, vendor_id, vendors): vendors that share a cleaned address.

    Two vendors of nearly one name are taken for one vendor and left out.
    """
    norm = normalize_address(F.col("address"), F.col("city"), F.col("state"), F.col("zip_code"))["normalized"]
    at = cut(
        t["vendor"].where(F.length("address") > 0)
        .select(norm.alias("address"), F.col("id").alias("vendor_id"), _key_name().alias("name"))
    ).where("address <> ''")
    who = F.struct("vendor_id", "name")
    groups = at.groupBy("address").agg(F.count("*").alias("vendors"), F.min(who).alias("a"), F.max(who).alias("b")).where("vendors > 1")
    twins = (
        groups.where("vendors = 2").where(ratio(F.col("a.name"), F.col("b.name")) > 90).select("address")
    )
    kept = groups.select("address", "vendors").join(twins, "address", "left_anti")
    return at.select("address", "vendor_id").join(kept, "address")


def address_clusters(t: dict, p: Params, members: DataFrame) -> DataFrame:
    """Addresses of three or more vendors with what they were paid."""
    per = (
        members.where("vendors >= 3").join(_paid(t), "vendor_id", "left").groupBy("address")
        .agg(F.min("vendor_id").alias("first_vendor"), F.count("*").alias("vendor_count"),
             F.coalesce(F.sum("paid"), F.lit(0)).alias("total_payments"))
    )
    return per.select(
        F.lit("vendor_cluster_address").alias("alert_type"),
        severity("medium", ("high", (F.col("vendor_count") >= 5) | (F.col("total_payments") >= 1000000))).alias("severity"),
        F.lit("vendor").alias("entity_type"), F.col("first_vendor").alias("entity_id"), "address", "vendor_count", "total_payments")


def address_relationships(members: DataFrame) -> DataFrame:
    """Members tied to the lowest vendor id of their address."""
    first = members.groupBy("address").agg(F.min("vendor_id").alias("vendor_id_1"))
    return members.join(first, "address").where("vendor_id > vendor_id_1").select(
        "vendor_id_1", F.col("vendor_id").alias("vendor_id_2"), F.lit("same_address").alias("relationship_type"),
        F.lit(0.8).alias("confidence_score"), F.to_json(F.struct("address")).alias("evidence"))


def name_cutoff(p: Params) -> int:
    """Percent from which on names are similar."""
    return int(p.vendor_name_similarity * 100)


def similar_names(t: dict, p: Params) -> DataFrame:
    """(name, other_name, confidence_score): every pair of similar, not equal, vendor names, in both directions.

    first_id and held are the lowest vendor id and the number of vendors of the name, other_first_id and other_held those of the other.
    """
    named = t["vendor"].select("id", "name_normalized")
    near = fuzzy_pairs(named, "name_normalized", named, "name_normalized", name_cutoff(p), ids="id").where("left_name <> right_name")
    return near.select(
        F.col("left_name").alias("name"), F.col("right_name").alias("other_name"), (F.col("score") / 100).alias("confidence_score"),
        F.col("left_first").alias("first_id"), F.col("left_rows").alias("held"), F.col("right_first").alias("other_first_id"), F.col("right_rows").alias("other_held"))


def similar_names_of(t: dict, p: Params, vendor_id: int) -> DataFrame:
    """The rows of similar_names for the names of one vendor: all names are compared with these alone."""
    named = t["vendor"].select("id", "name_normalized")
    mine = named.where(F.col("id") == vendor_id).select("name_normalized")
    near = fuzzy_pairs(mine, "name_normalized", named, "name_normalized", name_cutoff(p)).where("left_name <> right_name")
    return near.select(F.col("left_name").alias("name"), F.col("right_name").alias("other_name"), (F.col("score") / 100).alias("confidence_score"))


def _holders(t: dict) -> DataFrame:
    """(name, first, rows, ids): each name with the least id and the number of its vendors, and all their ids."""
    ids = F.col("l.id").alias("ids")
    return t["vendor"].where(F.length("name_normalized") > 0).groupBy(F.col("name_normalized").alias("name")).agg(
        F.min("id").alias("first"), F.count("*").alias("rows"), F.collect_list(F.struct("id")).alias("l")).select("name", "first", "rows", ids)


def one_name_each(t: dict) -> bool:
    """Whether every vendor id is there and belongs to one row."""
    return t["vendor"].groupBy("id").count().where("count > 1 or id is null").isEmpty()


def name_graph(t: dict, p: Params) -> DataFrame:
    """(src, dst, n): without n edges that join the vendors of similar names, as name_links; with n the counts of name_pair_counts at src.

    Both come of one comparison of names, and no more rows than names of a cell leave it.
    """
    names = cut(_holders(t).select("name", "first", "rows", F.monotonically_increasing_id().alias("no")))
    found = cut(fuzzy_fold(names, names, name_cutoff(p), NameGraph))
    several = names.where("rows > 1").join(found.where("kind = 1").select(F.col("a").alias("no")).distinct(), "no", "left_semi")
    within = _named(t).join(several.select("name", F.col("first").alias("src")), "name").where("vendor_id <> src").select(
        "src", F.col("vendor_id").alias("dst"), F.lit(None).cast("bigint").alias("n"))
    across = found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")
    counts = found.where("kind = 2").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("src"), F.lit(None).cast("bigint").alias("dst"), "n")
    return within.unionByName(across).unionByName(counts)


def graph_links(graph: DataFrame) -> DataFrame:
    return graph.where("n is null").select("src", "dst")


def graph_counts(graph: DataFrame) -> DataFrame:
    return graph.where("n is not null").select(F.col("src").alias("vendor_id"), "n")


def vendors_of_similar_names(t: dict, p: Params) -> DataFrame:
    """(src, dst): the rows of name_pairs, made where the pairs of names are found."""
    names = cut(_holders(t).select("name", "ids"))
    found = fuzzy_fold(names, names, name_cutoff(p), VendorPairs)
    return found.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def name_relationships_of(t: dict, p: Params) -> DataFrame:
    """The rows of name_relationships, made where the pairs of names are found."""
    names = cut(_holders(t))
    return fuzzy_fold(names, names, name_cutoff(p), VendorNames).select(
        "vendor_id", "name", "other_name", "other_vendors", "first_vendor", F.lit("similar_name").alias("relationship_type"), (F.col("score") / 100).alias("confidence_score"))


def _named(t: dict) -> DataFrame:
    return t["vendor"].where(F.col("name_normalized").isNotNull()).select(F.col("id").alias("vendor_id"), F.col("name_normalized").alias("name"))


def name_relationships(t: dict, names: DataFrame) -> DataFrame:
    """A row per vendor and similar name, with how many vendors have that name and the lowest id of theirs."""
    mine = _named(t)
    group = mine.groupBy(F.col("name").alias("other_name")).agg(F.count("*").alias("other_vendors"), F.min("vendor_id").alias("first_vendor"))
    return names.join(group, "other_name").join(mine, "name").select(
        "vendor_id", "name", "other_name", "other_vendors", "first_vendor", F.lit("similar_name").alias("relationship_type"), "confidence_score")


def name_links(t: dict, names: DataFrame) -> DataFrame:
    """(src, dst) edges that join the vendors of similar names: each name's vendors to its lowest id, and these ids as far as they aren't joined yet."""
    mine = _named(t).join(names.select("name").distinct(), "name", "left_semi")
    low = mine.groupBy("name").agg(F.min("vendor_id").alias("src"))
    within = mine.join(low, "name").where("vendor_id <> src").select("src", F.col("vendor_id").alias("dst"))
    across = thinned(names.where("name < other_name").select("name", "other_name")).join(low, "name").join(low.select(F.col("name").alias("other_name"), F.col("src").alias("dst")), "other_name")
    return within.unionByName(across.select("src", "dst"))


def name_pairs(t: dict, names: DataFrame) -> DataFrame:
    """(src, dst): every two vendors of similar names, the lower id first. Names of one vendor each come with their ids, only the others are joined."""
    a, b = _named(t).toDF("a", "name"), _named(t).toDF("b", "other_name")
    ways, alone = names.where("name < other_name"), "held = 1 and other_held = 1"
    shared = ways.where(f"not ({alone})").select("name", "other_name").join(a, "name").join(b, "other_name")
    both = ways.where(alone).select(F.col("first_id").alias("a"), F.col("other_first_id").alias("b")).unionByName(shared.select("a", "b"))
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def name_pair_counts(t: dict, names: DataFrame) -> DataFrame:
    """(vendor_id, n): pairs of vendors with similar names, counted at the lowest vendor id of the name first in order."""
    size = _named(t).groupBy("name").agg(F.count("*").alias("n"), F.min("vendor_id").alias("vendor_id"))
    other = size.select(F.col("name").alias("other_name"), F.col("n").alias("m"))
    return names.where("name < other_name").join(size, "name").join(other, "other_name").groupBy("vendor_id").agg(F.sum(F.col("n") * F.col("m")).alias("n"))


CLOSE = 0.9  # similarity from which on vendors of two names are reported


def _placed(t: dict) -> DataFrame:
    at = parse_full_address(F.col("address"))["normalized"]
    return cut(t["vendor"].where((F.length("address") > 0) & F.col("name_normalized").isNotNull()).select(
        F.col("id").alias("vendor_id"), F.col("name").alias("spelled"), F.col("name_normalized").alias("name"), at.alias("at")).where(F.col("at").isNotNull()))


def _name_alert(entity_id, related, vendors, name_1, name_2, similarity) -> list:
    return [F.lit("vendor_cluster_name").alias("alert_type"), F.lit("medium").alias("severity"), F.lit("vendor").alias("entity_type"),
            entity_id.alias("entity_id"), related.alias("related_vendor_id"), vendors.alias("related_vendors"),
            name_1.alias("name_1"), name_2.alias("name_2"), F.round(similarity, 4).alias("similarity")]


def similar_name_alerts(t: dict, p: Params, names: DataFrame | None = None) -> DataFrame:
    """Nearly equal names at different addresses: a row per vendor and similar name with vendors elsewhere.

    A name's vendors are counted per address first, so a vendor meets addresses and not vendors. Without names, pairs of names as of
    similar_names, the pairs are found here and judged where they are found.
    """
    placed = _placed(t)
    who = F.struct("vendor_id", "spelled", "at")
    if names is None:
        lists = cut(placed.where("name <> ''").groupBy("name").agg(F.sort_array(F.collect_list(who)).alias("l")).select(
            "name", F.col("l.vendor_id").alias("ids"), F.col("l.spelled").alias("spelled"), F.col("l.at").alias("at")))
        found = fuzzy_fold(lists, lists, max(name_cutoff(p), 100 * CLOSE), Elsewhere).withColumn("confidence_score", F.col("score") / 100).where(F.col("confidence_score") >= CLOSE)
        return found.select(*_name_alert(*[F.col(c) for c in ("vendor_id", "other_id", "others", "spelled", "other_spelled", "confidence_score")]))
    close = names.where(F.col("confidence_score") >= CLOSE)
    there = placed.groupBy(F.col("name").alias("other_name"), "at").agg(F.count("*").alias("n"), F.min(who).alias("low"))
    total = there.groupBy("other_name").agg(F.sum("n").alias("total"), F.min("low").alias("first"))
    # the lowest id away from the first one's address, for vendors that share that address
    second = there.join(total, "other_name").where(F.col("at") != F.col("first.at")).groupBy("other_name").agg(F.min("low").alias("second"))
    groups = total.join(second, "other_name", "left")
    both = placed.join(close, "name").join(groups, "other_name").join(there.select("other_name", "at", "n"), ["other_name", "at"], "left")
    here = F.coalesce("n", F.lit(0))
    other = F.when(F.col("first.at") == F.col("at"), F.col("second")).otherwise(F.col("first"))
    return both.where(F.col("total") > here).select(
        *_name_alert(F.col("vendor_id"), other["vendor_id"], F.col("total") - here, F.col("spelled"), other["spelled"], F.col("confidence_score")))


def sequential_relationships(t: dict, p: Params) -> DataFrame:
    """Vendors with neighbouring state ids and similar names, by an equality join on id and id + 1."""
    num = F.regexp_replace("vendor_id", "[- ]", "").try_cast("decimal(38,0)")
    v = t["vendor"].select(F.col("id"), num.alias("num"), _key_name().alias("name")).where(F.col("num").isNotNull())
    a = v.select(F.col("id").alias("vendor_id_1"), (F.col("num") + 1).cast("decimal(38,0)").alias("num"), F.col("name").alias("n1"))
    b = v.select(F.col("id").alias("vendor_id_2"), "num", F.col("name").alias("n2"))
    near = a.join(b, "num").where(possible(F.col("n1"), F.col("n2"), p.sequential_similarity * 100))
    return near.withColumn("confidence_score", ratio(F.col("n1"), F.col("n2")) / 100).where(
        F.col("confidence_score") >= p.sequential_similarity
    ).select(F.least("vendor_id_1", "vendor_id_2").alias("vendor_id_1"), F.greatest("vendor_id_1", "vendor_id_2").alias("vendor_id_2"),
             F.lit("sequential_id").alias("relationship_type"), "confidence_score",
             F.to_json(F.struct("n1", "n2")).alias("evidence"), F.col("vendor_id_1").alias("first_vendor"))


def sequential_alerts(relationships: DataFrame) -> DataFrame:
    return relationships.where((F.col("relationship_type") == "sequential_id") & (F.col("confidence_score") >= 0.85)).select(
        F.lit("vendor_cluster_sequential").alias("alert_type"), F.lit("low").alias("severity"), F.lit("vendor").alias("entity_type"),
        F.col("first_vendor").alias("entity_id"),
        F.when(F.col("first_vendor") == F.col("vendor_id_1"), F.col("vendor_id_2")).otherwise(F.col("vendor_id_1")).alias("related_vendor_id"),
        F.round("confidence_score", 4).alias("similarity"))


def related_to(t: dict, vendor_id: int, pairs: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """All vendors related to one vendor: neighbouring ids on either side of a pair, similar names, the same address."""
    me = F.lit(vendor_id)
    out = pairs.where(F.col("vendor_id_1") == me).select(F.col("vendor_id_2").alias("id"), "relationship_type", "confidence_score")
    back = pairs.where(F.col("vendor_id_2") == me).select(F.col("vendor_id_1").alias("id"), "relationship_type", "confidence_score")
    mine = _named(t).where(F.col("vendor_id") == me).select("name")
    close = names.join(mine, "name", "left_semi").select(F.col("other_name").alias("name"), "confidence_score")
    alike = _named(t).join(close, "name").select(F.col("vendor_id").alias("id"), F.lit("similar_name").alias("relationship_type"), "confidence_score")
    home = members.where(F.col("vendor_id") == me).select("address")
    there = members.join(home, "address", "left_semi").where(F.col("vendor_id") != me).select(
        F.col("vendor_id").alias("id"), F.lit("same_address").alias("relationship_type"), F.lit(0.8).alias("confidence_score"))
    v = t["vendor"].select("id", F.col("vendor_id").alias("vendor_vid"), "name")
    return out.unionByName(back).unionByName(alike).unionByName(there).join(v, "id")
