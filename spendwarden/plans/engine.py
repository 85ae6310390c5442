"""All rules over one set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from . import anomalies, clustering, confidentiality, crossref, duplicates, employee_match, fiscal, ghost, network, related, screening, splitting
from .rulebook import Rulebook

# fixed values: public rule names and the rule each stands for
RULE_NAMES = {
    "contract-splitting": "contract_splitting", "duplicate-payments": "duplicates", "vendor-clustering": "vendor_clustering",
    "payment-anomalies": "anomalies", "confidentiality": "confidentiality", "network-analysis": "network", "crossref": "crossref",
    "address-clusters": "crossref", "pay-to-play": "crossref", "employee-vendor": "employee_vendor", "ghost-vendors": "ghost_vendors",
    "fiscal-year-rush": "fiscal_year_rush", "related-party": "related_party", "debarment": "debarment", "sam-exclusions": "debarment",
}


def matches_of(t: dict) -> DataFrame:
    """Employee matches of this run and stored matches of any kind."""
    made = employee_match.entity_match_rows(t["employee_names"], t["sides"])
    if "entity_match" not in t:
        return made
    return made.drop("evidence").unionByName(t["entity_match"].select(*[c for c in made.columns if c != "evidence"]))


BOOK = Rulebook()
BOOK.shared("members", "vendor", lambda t, p: clustering.address_members(t))
BOOK.shared("names", "vendor", clustering.similar_names, beside="vendor_clustering network related_party")  # kept by detect; rules meet pairs where they are found
BOOK.shared("name_graph", "vendor", clustering.name_graph)
BOOK.shared("sequential", "vendor", clustering.sequential_relationships)
BOOK.shared("edges", "payment contract vendor agency", lambda t, p: network.spending_edges(t))
BOOK.shared("employee_names", "employee vendor payment", employee_match.name_matches)
BOOK.shared("sides", "employee vendor", lambda t, p: employee_match.address_sides(t))
BOOK.shared("matches", "employee_names sides entity_match?", lambda t, p: matches_of(t))


def _pairs(t: dict) -> DataFrame:
    return t["sequential"].drop("first_vendor")


@BOOK.rule("contract_splitting", "contract vendor agency")
def _(t, p):
    return [splitting.contract_splitting(t, p), splitting.contract_splitting_small(t, p)]


@BOOK.rule("duplicates", "payment vendor members")
def _(t, p):
    return [duplicates.exact_duplicates(t, p), duplicates.near_duplicates(t, p), duplicates.related_vendor_duplicates(t, p, t["members"])]


@BOOK.rule("vendor_clustering", "vendor payment members sequential")
def _(t, p):
    return [clustering.address_clusters(t, p, t["members"]), clustering.similar_name_alerts(t, p), clustering.sequential_alerts(t["sequential"])]


@BOOK.rule("anomalies", "payment vendor agency contract")
def _(t, p):
    return [anomalies.round_numbers(t, p), anomalies.large_first_payments(t, p), anomalies.over_contract_payments(t, p), anomalies.unlisted_vendors(t, p), anomalies.august_spikes(t, p)]


@BOOK.rule("confidentiality", "payment vendor agency")
def _(t, p):
    return [confidentiality.high_confidentiality(t, p), confidentiality.confidentiality_spikes(t, p), confidentiality.vendor_confidentiality(t, p)]


@BOOK.rule("network", "vendor agency edges sequential members name_graph")
def _(t, p):
    return [network.hub_vendors(t, p, t["edges"]), network.vendor_clusters(t, p, t["edges"], _pairs(t), t["members"], graph=t["name_graph"]), network.exclusive_relationships(t, p, t["edges"])]


@BOOK.rule("crossref", "vendor payment contract contribution tax_permit alert?")
def _(t, p):
    return [crossref.raw_address_clusters(t, p, t.get("alert")), crossref.pay_to_play(t, p), crossref.unregistered_vendors(t, p)]


@BOOK.rule("employee_vendor", "payment employee_names sides")
def _(t, p):
    return [employee_match.name_alerts(t["employee_names"]), employee_match.address_alerts(t, t["sides"])]


@BOOK.rule("ghost_vendors", "vendor payment")
def _(t, p):
    return [ghost.ghost_vendors(t, p), ghost.incomplete_addresses(t, p), ghost.suspicious_addresses(t, p)]


@BOOK.rule("fiscal_year_rush", "payment vendor agency")
def _(t, p):
    return [fiscal.spending_rush(t, p), fiscal.vendor_year_end(t, p), fiscal.year_end_clusters(t, p)]


@BOOK.rule("related_party", "vendor payment contribution sequential members name_graph matches employee_names sides edges")
def _(t, p):
    return [related.related_party_networks(t, p, _pairs(t), t["members"], t["matches"], None, t["name_graph"]), related.contributor_triangles(t, p, t["employee_names"], t["sides"]),
            related.circular_patterns(t, p, t["edges"], _pairs(t), t["members"], circles=related.name_circles(t, p, t["edges"]))]


@BOOK.rule("debarment", "vendor payment debarred")
def _(t, p):
    return screening.debarred_vendors(t, p)


def run_rule(name: str, t: dict, p: Params, book: Rulebook = BOOK) -> DataFrame:
    """Findings of one rule by its public name, or by the name it has in the book; an error of the rule is raised."""
    found, outcome = book.run(t, p, [RULE_NAMES.get(name, name)])
    if outcome[0]["status"] == "failed":
        raise RuntimeError(outcome[0]["error"])
    return found


def run_all(t: dict, p: Params, book: Rulebook = BOOK, shared: dict | None = None) -> tuple[DataFrame | None, list[dict]]:
    """Findings of all rules and, per rule, success or the error. A failing rule does not stop the others."""
    return book.run(t, p, shared=shared)


def for_vendor(findings: DataFrame, vendor_id: int) -> DataFrame:
    """Findings about one vendor."""
    return findings.where((F.col("entity_type") == "vendor") & (F.col("entity_id") == vendor_id))
