import datetime as dt

from helpers import table

from spendwarden.params import Params
from spendwarden.plans import alerts, anomalies, clustering, confidentiality, crossref, duplicates, engine, fiscal, network, related, screening, splitting

P = Params(as_of=dt.date(2001, 7, 31))


def vendors(spark, n, **more):
    return table(spark, "vendor", *[{"id": i, "name": f"V{i}", "name_normalized": f"VENDOR {i}", "in_cmbl": True, **{k: f(i) for k, f in more.items()}} for i in range(1, n + 1)])


def test_splitting_boundaries(spark):
    day = (P.as_of - dt.timedelta(days=360)).isoformat()
    rows = [{"vendor_id": 1, "agency_id": 1, "current_value": v, "start_date": day} for v in (45000, 50000, 47000)]
    rows += [{"vendor_id": 2, "agency_id": 1, "current_value": 46000, "start_date": day}] * 2  # two are not enough
    rows += [{"vendor_id": 3, "agency_id": None, "current_value": 46000, "start_date": day}] * 3  # no agency is a group
    early = (P.as_of - dt.timedelta(days=361)).isoformat()
    rows += [{"vendor_id": 4, "agency_id": 1, "current_value": 46000, "start_date": early}] * 3
    rows += [{"vendor_id": 5, "agency_id": 1, "current_value": 50000.01, "start_date": day}] * 3
    t = {"contract": table(spark, "contract", *rows), "vendor": vendors(spark, 5), "agency": table(spark, "agency", {"name": "A"})}
    got = {r["entity_id"]: r for r in splitting.contract_splitting(t, P).collect()}
    assert set(got) == {1, 3} and got[3]["agency_name"] == "Unknown" and got[1]["severity"] == "high"
    items = splitting.splitting_contracts(t, P, splitting.contract_splitting(t, P), 45000, 50000)
    assert items.count() == 6


def test_small_band_severity_is_per_row(spark):
    rows = [{"vendor_id": 1, "agency_id": 1, "current_value": 24000, "start_date": "2001-06-01"}] * 5
    rows += [{"vendor_id": 2, "agency_id": 1, "current_value": v, "start_date": "2001-06-01"} for v in (22000, 25000, 23000)]
    t = {"contract": table(spark, "contract", *rows), "vendor": vendors(spark, 2), "agency": table(spark, "agency", {"name": "A"})}
    assert {r["entity_id"]: r["severity"] for r in splitting.contract_splitting_small(t, P).collect()} == {1: "high", 2: "medium"}


def test_duplicates(spark):
    rows = [{"vendor_id": 1, "amount": 100, "payment_date": "2001-01-01"}] * 2  # too small
    rows += [{"vendor_id": 1, "amount": 100.01, "payment_date": "2001-01-01"}] * 2
    rows += [{"vendor_id": 2, "amount": 60000, "payment_date": None}] * 2
    rows += [{"vendor_id": 3, "amount": 6000, "payment_date": d} for d in ("2001-01-01", "2001-01-31", "2001-03-03")]  # 30 days in, 31 out
    rows += [{"vendor_id": 4, "amount": 6000, "payment_date": "2001-01-01"}] * 3  # one day only
    t = {"payment": table(spark, "payment", *rows), "vendor": vendors(spark, 4)}
    exact = {(r["entity_id"], float(r["amount"])): r["severity"] for r in duplicates.exact_duplicates(t, P).collect()}
    assert exact == {(1, 100.01): "low", (2, 60000.0): "high", (4, 6000.0): "medium"}
    near = duplicates.near_duplicates(t, P).collect()
    assert [(r["entity_id"], r["payment_count"], str(r["first_date"]), str(r["last_date"])) for r in near] == [(3, 2, "2001-01-01", "2001-01-31")]
    assert duplicates.near_duplicate_payments(t, P).count() == 2


def test_related_duplicates_with_and_without_dates(spark):
    rows = [(1, 1, "2001-01-01"), (2, 2, "2001-01-31"), (3, 3, "2001-03-03"), (4, 4, None)]
    t = {"payment": table(spark, "payment", *[{"id": i, "vendor_id": v, "amount": 1000, "payment_date": d} for i, v, d in rows])}
    m = spark.createDataFrame([("X", 1), ("X", 2), ("X", 3), ("Y", 4)], "address string, vendor_id bigint")
    got = {r["entity_id"]: r["related_vendor_id"] for r in duplicates.related_vendor_duplicates(t, P, m).collect()}
    assert got == {1: 2}
    m = spark.createDataFrame([("X", 1), ("X", 3), ("X", 4)], "address string, vendor_id bigint")
    assert {r["entity_id"]: r["related_vendor_id"] for r in duplicates.related_vendor_duplicates(t, P, m).collect()} == {1: 4, 3: 4}


def test_over_contract_is_null_safe_and_strict(spark):
    c = [{"id": 1, "vendor_id": 1, "agency_id": None, "max_value": 100}, {"id": 2, "vendor_id": 1, "agency_id": 1, "max_value": 100}]
    p = [{"vendor_id": 1, "agency_id": None, "amount": 150}, {"vendor_id": 1, "agency_id": 1, "amount": 100}]
    t = {"contract": table(spark, "contract", *c), "payment": table(spark, "payment", *p)}
    got = anomalies.over_contract_payments(t, P).collect()
    assert [(r["entity_id"], r["severity"], float(r["excess_amount"])) for r in got] == [(1, "high", 50.0)]


def test_confidentiality_spike_needs_more_than_the_delta(spark):
    def pays(agency, recent, past):
        out = [{"agency_id": agency, "amount": 1, "payment_date": "2001-07-01", "is_confidential": i < recent} for i in range(50)]
        return out + [{"agency_id": agency, "amount": 1, "payment_date": "2001-01-01", "is_confidential": i < past} for i in range(100)]

    t = {"payment": table(spark, "payment", *[{"id": i, **r} for i, r in enumerate(pays(1, 10, 10) + pays(2, 11, 10))]),
         "agency": table(spark, "agency", {"name": "A"}, {"name": "B"})}
    assert [r["entity_id"] for r in confidentiality.confidentiality_spikes(t, P).collect()] == [2]


def test_cluster_sizes(spark):
    sizes, links, next_id = (2, 3, 20, 21), [], 1
    for n in sizes:
        links += [(next_id + i, next_id + i + 1, "similar_name") for i in range(n - 1)]
        next_id += n
    pairs = spark.createDataFrame(links, "vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string")
    edges = spark.createDataFrame([(v, 1, 10.0) for v in range(1, next_id)], "vendor_id bigint, agency_id bigint, payment_total double")
    none = spark.createDataFrame([], "address string, vendor_id bigint, vendors bigint")
    got = network.vendor_clusters({}, P, edges, pairs, none).collect()
    assert sorted(r["vendor_count"] for r in got) == [3, 20]


def test_exclusive_share_boundary(spark):
    e = [(1, 1, 80000.0), (2, 1, 20000.0), (1, 2, 79999.0), (2, 2, 20001.0)]
    edges = spark.createDataFrame(e, "vendor_id bigint, agency_id bigint, payment_total double")
    got = network.exclusive_relationships({"agency": table(spark, "agency", {"name": "A"}, {"name": "B"})}, P, edges).collect()
    assert [(r["entity_id"], r["top_vendor_id"]) for r in got] == [(1, 1)]


def test_no_permits_means_no_unregistered_vendors(spark):
    t = {"vendor": table(spark, "vendor", {"name": "A", "name_normalized": "ALPHA WORKS", "state": "TX", "in_cmbl": False}),
         "payment": table(spark, "payment", {"vendor_id": 1, "amount": 20000}), "tax_permit": table(spark, "tax_permit")}
    assert crossref.unregistered_vendors(t, P).count() == 0
    t["tax_permit"] = table(spark, "tax_permit", {"taxpayer_normalized": "BETA"})
    assert crossref.unregistered_vendors(t, P).count() == 1


def test_screening_severity(spark):
    v = [{"id": 1, "name_normalized": "A" * 20, "address": "9 Elm"}, {"id": 2, "name_normalized": "A" * 18 + "BB"}, {"id": 3, "name_normalized": "C" * 10, "address": "9 ELM"}]
    t = {"vendor": table(spark, "vendor", *v), "payment": table(spark, "payment", *[{"vendor_id": i, "amount": 1000} for i in (1, 2, 3)]),
         "debarred": table(spark, "debarred", {"id": 7, "name_normalized": "A" * 20, "address": "9 Elm", "is_active": True},
                           {"id": 8, "name_normalized": "A" * 20, "address": "x", "is_active": False})}
    got = {r["entity_id"]: (r["match_type"], r["severity"], r["match_score"]) for r in screening.debarred_vendors(t, P).collect()}
    assert got == {1: ("exact_name", "high", 1.0), 2: ("fuzzy_name", "medium", 0.9), 3: ("address", "low", 0.85)}


def test_two_like_named_vendors_at_one_address_are_one(spark):
    v = [{"id": 1, "name_normalized": "ACME SUPPLY COMPANY", "address": "1 Elm", "city": "X"}, {"id": 2, "name_normalized": "ACME SUPPLY COMPANYS", "address": "1 elm", "city": "x"},
         {"id": 3, "name_normalized": "ALPHA", "address": "2 Elm Street", "city": "X"}, {"id": 4, "name_normalized": "BETA", "address": "2 Elm St.", "city": "X"}]
    m = clustering.address_members({"vendor": table(spark, "vendor", *v)})
    assert {r["vendor_id"] for r in m.collect()} == {3, 4}


def test_sequential_ids_skip_text(spark):
    v = [{"id": 1, "vendor_id": "10-01", "name_normalized": "ACME ONE"}, {"id": 2, "vendor_id": "1002", "name_normalized": "ACME ONES"}, {"id": 3, "vendor_id": "X9", "name_normalized": "ACME ONE"}]
    got = clustering.sequential_relationships({"vendor": table(spark, "vendor", *v)}, P).collect()
    assert [(r["vendor_id_1"], r["vendor_id_2"]) for r in got] == [(1, 2)]


def test_circular_patterns_flag_every_vendor_of_a_qualifying_pair(spark):
    e = [(1, 1, 60000.0), (2, 1, 60000.0), (3, 2, 99999.0)]
    edges = spark.createDataFrame([(v, a, x, 1) for v, a, x in e], "vendor_id bigint, agency_id bigint, payment_total double, payment_count int")
    members = spark.createDataFrame([("X", 1), ("X", 2), ("X", 3)], "address string, vendor_id bigint")
    pairs = spark.createDataFrame([], "vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string, confidence_score double")
    assert {r["entity_id"] for r in related.circular_patterns({}, P, edges, pairs, members).collect()} == {1, 2}


def test_alert_dedupe(spark):
    f = spark.createDataFrame([("t", "low", "a", "d", "vendor", 1, "{}", 0), ("t", "high", "a", "d", "vendor", 1, "{}", 0), ("t", "low", "a", "d", "vendor", 2, "{}", 0),
                               ("t", "low", "a", "d", "vendor", 3, "{}", 0), ("t", "low", "a", "d", "vendor", None, "{}", 0), ("t", "low", "a", "d", "vendor", None, "{}", 0),
                               ("t", "low", "a", "d", "vendor", 0, "{}", 0), ("t", "high", "a", "d", "vendor", 3, "{}", 1)],
                              "alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, rule_order int")
    old = table(spark, "alert", {"alert_type": "t", "entity_type": "vendor", "entity_id": 2, "status": "acknowledged"},
                {"alert_type": "t", "entity_type": "vendor", "entity_id": 1, "status": "resolved"}, {"alert_type": "t", "entity_type": "vendor", "entity_id": 0, "status": "new"})
    fresh = alerts.new_alerts(f, old)
    got = sorted((r["entity_id"] or -1, r["severity"]) for r in fresh.collect())
    # 2 is open, 1 was resolved, 0 is an ordinary id, rule order beats severity for 3
    assert got == [(-1, "low"), (-1, "low"), (1, "high"), (3, "low")]
    rows = alerts.to_alert_rows(fresh, dt.datetime(2001, 8, 1))
    assert alerts.new_alerts(f.where("entity_id is not null"), old.unionByName(rows)).count() == 0


def test_fiscal_year_end(spark):
    rows = [{"agency_id": 1, "vendor_id": 1, "amount": 1000, "payment_date": f"{1999 if m >= 9 else 2000}-{m:02d}-15"} for m in range(1, 13) if m not in (7, 8)]
    rows += [{"agency_id": 1, "vendor_id": 2, "amount": 120000, "payment_date": "2000-08-31"}]
    rows += [{"agency_id": 1, "vendor_id": 2, "amount": 900000, "payment_date": "2001-07-15"}]  # current year does not count
    t = {"payment": table(spark, "payment", *rows), "agency": table(spark, "agency", {"name": "A"}), "vendor": vendors(spark, 2)}
    assert [(r["fiscal_year"], r["severity"]) for r in fiscal.spending_rush(t, P).collect()] == [(2000, "high")]
    assert [(r["entity_id"], r["fiscal_year"]) for r in fiscal.vendor_year_end(t, P).collect()] == [(2, 2000)]
    assert [r["vendor_id"] for r in fiscal.year_end_top_vendors(t, P).collect()] == [2]


def test_unknown_rule_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        engine.run_rule("no-such-rule", {}, P)
