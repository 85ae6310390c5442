"""Rules that take what they want of pairs of similar names where the pairs are found: same results as from stored pairs."""

import datetime as dt
import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import table

from spendwarden.functions.similarity import _lcs_one
from spendwarden.operators import fuzzy_join, pair_folds
from spendwarden.operators.components import connected_components
from spendwarden.params import Params
from spendwarden.plans import clustering, network, related
from spendwarden.session import cut

P = Params(as_of=dt.date(2001, 7, 31))
PAIRS = "vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string, confidence_score double"
MEMBERS = "address string, vendor_id bigint, vendors bigint"


def _vendors(repeated: bool = False, many: int = 90):
    """Vendors of names that differ in digits or words, names of several vendors, names and addresses missing."""
    dice = random.Random(7)
    rows = []
    for i in range(1, many + 1):
        name = dice.choice(["ACME WORKS {} INC", "ACME WORK {} INC", "BOLT & NUT {} LLC", "ZEBRA {}"]).format(dice.randrange(100, 140))
        name = dice.choice([name] * 12 + [None, "", "ÉCOLE"])
        rows.append({"id": i, "name": f"{name} x{i % 2}", "name_normalized": name, "address": dice.choice(["1 Elm St", "2 Elm St", "9 Oak Rd", None, ""]), "city": "AUSTIN", "state": "TX"})
    if repeated:
        rows += [{**rows[3], "name_normalized": rows[8]["name_normalized"]}, dict(rows[5]), {**rows[9], "id": None}]
    return rows


def _tables(spark, repeated=False):
    v = _vendors(repeated)
    dice = random.Random(3)
    pay = [{"vendor_id": x["id"], "agency_id": dice.randrange(4), "amount": dice.choice([30000, 45000.25, 60000, -20000])} for x in v if x["id"] and x["id"] % 5 for _ in range(3)]
    t = {"vendor": table(spark, "vendor", *v), "payment": table(spark, "payment", *pay), "contract": table(spark, "contract"),
         "agency": table(spark, "agency", *[{"id": i} for i in range(4)])}
    members = spark.createDataFrame([("A", i, 4) for i in (1, 2, 3, 4)] + [("B", i, 5) for i in range(10, 60)], MEMBERS)
    pairs = spark.createDataFrame([(i, i + 1, "sequential_id", 0.9) for i in range(1, 60, 3)], PAIRS)
    return t, pairs, members


def _all(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


LAYOUTS = {"keys": {}, "cells": {"cell_rows": 8, "class_names": 1}, "blocks": {"cell_rows": 8, "class_names": 1}, "split": {"cell_rows": 1, "class_names": 1}}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("both", [False, True])
def test_folds_see_every_pair_once(spark, monkeypatch, layout, both):
    left = sorted({x["name_normalized"] for x in _vendors() if x["name_normalized"]})
    right = [f"ACME WORKS {i} INC" for i in range(100, 130)] + ["ZEBRA 1", "ÉCOLE"] if both else left
    if layout in ("blocks", "split"):
        monkeypatch.setattr(fuzzy_join, "_blocks", lambda lc, rc, cell_rows: (3, 3 if lc is rc else 2, 0.0))
        monkeypatch.setattr(fuzzy_join, "BLOCK_CELLS", 16)
    else:
        monkeypatch.setattr(fuzzy_join, "_blocks", lambda lc, rc, cell_rows: (1, 1, 1e18))
    monkeypatch.setattr(fuzzy_join, "FEW_NAMES", 0)
    l = cut(spark.createDataFrame([(x, [i]) for i, x in enumerate(left)], "name string, ids array<bigint>"))
    r = cut(spark.createDataFrame([(x, [i]) for i, x in enumerate(right)], "name string, ids array<bigint>")) if both else l
    got = [(x["a"], x["b"]) for x in fuzzy_join.fuzzy_fold(l, r, 85, pair_folds.VendorPairs, **LAYOUTS[layout]).collect()]
    near = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if 200.0 * _lcs_one(a, b) / (len(a) + len(b)) >= 85}
    if both:
        assert sorted(got) == sorted(near)
    else:
        assert sorted(tuple(sorted(x)) for x in got) == sorted((i, j) for i, j in near if i < j)
    plain = fuzzy_join.fuzzy_pairs(l, "name", r, "name", 85, **LAYOUTS[layout])
    assert sorted((left.index(x["left_name"]), right.index(x["right_name"])) for x in plain.collect()) == sorted(near)


@pytest.mark.parametrize("repeated", [False, True])
def test_rules_find_the_same_without_stored_pairs(spark, repeated):
    t, pairs, members = _tables(spark, repeated)
    names = cut(clustering.similar_names(t, P))
    assert names.count() > 100
    assert _all(clustering.name_relationships_of(t, P)) == _all(clustering.name_relationships(t, names))
    assert _all(clustering.similar_name_alerts(t, P)) == _all(clustering.similar_name_alerts(t, P, names))
    assert _all(network.linked_vendors(t, pairs, members, None, P)) == _all(network.linked_vendors(t, pairs, members, names))
    for i in (4, 6, 9, 77):
        assert _all(clustering.related_to(t, i, pairs, members, clustering.similar_names_of(t, P, i))) == _all(clustering.related_to(t, i, pairs, members, names))
    graph = cut(clustering.name_graph(t, P))
    assert _all(connected_components(clustering.graph_links(graph))) == _all(connected_components(clustering.name_links(t, names)))
    assert _all(clustering.graph_counts(graph)) == _all(clustering.name_pair_counts(t, names))
    edges = network.spending_edges(t)
    assert _all(network.network_stats(t, edges, pairs, members, None, P)) == _all(network.network_stats(t, edges, pairs, members, names))
    assert _all(network.vendor_clusters(t, P, edges, pairs, members, graph=graph)) == _all(network.vendor_clusters(t, P, edges, pairs, members, names))
    matches = spark.createDataFrame([], "entity_type_1 string, entity_id_1 bigint, entity_type_2 string, entity_id_2 bigint, match_type string")
    assert _all(related.related_party_networks(t, P, pairs, members, matches, None, graph)) == _all(related.related_party_networks(t, P, pairs, members, matches, names))
    circles = related.circular_patterns(t, P, edges, pairs, members, circles=related.name_circles(t, P, edges))
    assert _all(circles) == _all(related.circular_patterns(t, P, edges, pairs, members, names))
    assert circles.where("relationship_type = 'similar_name'").count() > 20


@pytest.mark.parametrize("dense", [0, 1 << 20])
def test_payers_two_names_share(monkeypatch, dense):
    monkeypatch.setattr(pair_folds, "DENSE", dense)
    dice = random.Random(5)
    lists = [sorted({(v, a): dice.choice([-40, 10, 30, 70]) for v in dice.sample(range(100), dice.randrange(1, 4)) for a in dice.sample(range(6), 3)}.items()) for _ in range(30)]
    t = pa.table({"name": [f"N{i}" for i in range(30)], **{c: pa.array([[f(x) for x in rows] for rows in lists], pa.list_(pa.int64()))
                                                         for c, f in (("vendors", lambda x: x[0][0]), ("payers", lambda x: x[0][1]), ("paid", lambda x: x[1]))}})
    fold = pair_folds.CommonPayers(40, 0.7)
    fold.open(t)
    left, right = np.array([(i, j) for i in range(30) for j in range(i + 1, 30)]).T
    got = sorted(tuple(r.values()) for b in fold.pairs(left, right, np.full(len(left), 90.0)) for r in b.to_pylist())
    want = []
    for i, j in [*zip(left, right), *zip(right, left)]:
        pool = {}
        for (v, a), x in lists[j]:
            pool.setdefault(a, []).append((v, x))
        for vendor in {v for (v, _), _ in lists[i]}:
            both = [(x, pool[a]) for (v, a), x in lists[i] if v == vendor and a in pool]
            paid, got_ = sum(x for x, _ in both), sum(y for _, other in both for _, y in other)
            if both and paid >= 40 and got_ >= 40:
                want.append((vendor, min(v for _, other in both for v, _ in other), len(both), paid, got_))
    assert got == sorted(want) and len(got) > 30
    assert not list(fold.pairs(left, right, np.full(len(left), 69.0)))


def test_queries_of_similar_names_store_no_pairs(spark, sf, monkeypatch):
    from checks import catalogue

    def refuse(*_, **__):
        raise AssertionError("pairs of names were listed")

    monkeypatch.setattr(clustering, "fuzzy_pairs", refuse)
    for key in ("d08_similar_names", "d08_similar_name_alerts", "d20_vendor_links", "d22_vendor_clusters", "d24_network_stats", "d38_related_party_networks", "d40_circular_patterns"):
        catalogue.QUERIES[key](spark, sf)


def test_one_vendor_is_compared_with_all_by_its_names_only(spark, monkeypatch):
    t, pairs, members = _tables(spark)
    seen = []
    plain = clustering.fuzzy_pairs
    monkeypatch.setattr(clustering, "fuzzy_pairs", lambda left, *rest, **how: seen.append(left.count()) or plain(left, *rest, **how))
    assert clustering.related_to(t, 4, pairs, members, clustering.similar_names_of(t, P, 4)).count() > 0
    assert seen == [1]


@pytest.mark.parametrize("cell_rows", [2, 4096])
def test_names_of_one_group_only(spark, cell_rows):
    rows = [(g, f"ACME WORKS {i} INC", 1 + i % 3) for g in (1, 2, 3) for i in range(20, 20 + 4 * g)] + [(4, "ACME WORKS 20 INC", 1)]
    df = spark.createDataFrame(rows, "place bigint, name string, rows bigint")
    got = fuzzy_join.fuzzy_fold_within(df, "place", 85, pair_folds.Crossings, cell_rows).agg(F.sum("n")).first()[0]
    assert got == sum(m * n for i, (g, a, m) in enumerate(rows) for h, b, n in rows[:i] if g == h and 200.0 * _lcs_one(a, b) / (len(a) + len(b)) >= 85)


def test_partial_is_kept_for_folds_with_settings(spark):
    names = cut(spark.createDataFrame([("ACME WORKS 1", 1, 1, 0), ("ACME WORKS 2", 5, 3, 1)], "name string, first bigint, rows bigint, no bigint"))
    got = fuzzy_join.fuzzy_fold(names, names, 85, partial(pair_folds.NameGraph, False)).collect()
    assert sorted((r["kind"], r["a"], r["b"]) for r in got) in ([(0, 1, 5), (1, 1, None)], [(0, 5, 1), (1, 1, None)])
