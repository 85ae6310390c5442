"""Cases that reviews found wrong: gaps in numbered codes, notes, long addresses, file headers."""

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import table

from checks import source_queries
from spendwarden.operators import fuzzy_join, resolve
from spendwarden.params import Params
from spendwarden.plans import alerts, clustering, crossref, duplicates, employee_match, network, related
from spendwarden.sources import readers


def test_codes_fill_gaps(spark):
    agencies = spark.createDataFrame([("FED_DN", "old one"), ("FED_DN_3", "old three")], "agency_code string, name string")
    rows = spark.createDataFrame([("Depot North",), ("Dock Nine",), ("Dam Nora",)], "agency_name string")
    got = {r["name"]: r["agency_code"] for r in resolve.coded_agencies(rows, agencies).collect()}
    assert sorted(got.values()) == ["FED_DN_2", "FED_DN_4", "FED_DN_5"]


def test_notes_are_kept_in_order(spark):
    a = spark.createDataFrame([(1, "new", "first"), (2, "new", None)], "id bigint, status string, notes string")
    at = dt.datetime(2020, 1, 1)
    events = spark.createDataFrame([(1, "resolved", "third", at.replace(day=3)), (1, "acknowledged", "second", at), (2, "acknowledged", None, at)], "alert_id bigint, status string, note string, at timestamp")
    got = {r["id"]: (r["status"], r["notes"]) for r in alerts.current_alerts(a, events).collect()}
    assert got == {1: ("resolved", "first\nsecond\nthird"), 2: ("acknowledged", None)}


def test_clusters_of_like_beginning_are_told_apart(spark):
    one, two = "SUITE " * 10 + "A", "SUITE " * 10 + "B"
    rows = [{"name": f"V{i}", "address": one if i < 3 else two, "city": "AUSTIN", "state": "TX"} for i in range(6)]
    t = {"vendor": table(spark, "vendor", *rows), "payment": table(spark, "payment"), "contract": table(spark, "contract")}
    known = spark.createDataFrame([("address_cluster", f'{{"address": "{one}"}}')], "alert_type string, evidence string")
    got = crossref.raw_address_clusters(t, Params(as_of=dt.date(2020, 1, 1)), known).collect()
    assert [r["address"] for r in got] == [two]


def test_quoted_line_ends_and_other_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text('name,city\n"ACME\nINC",AUSTIN\n')
    assert [r["name"] for r in readers.read_csv(spark, str(tmp_path)).collect()] == ["ACME\nINC"]
    (tmp_path / "two.csv").write_text("city,name\nDALLAS,OTHER\n" * 1)
    with pytest.raises(Exception, match="CSV"):
        readers.read_csv(spark, str(tmp_path)).collect()


P = Params(as_of=dt.date(2001, 7, 31))


def test_every_vendor_of_a_name_counts(spark):
    """The vendor with the highest id is not the paid one; employees see all paid vendors of the name together."""
    v = [{"id": i, "name": "ACME INC", "name_normalized": "ACME INC"} for i in (5, 7, 9)]
    t = {"vendor": table(spark, "vendor", *v), "employee": table(spark, "employee", {"id": 1, "name": "ACME INC", "name_normalized": "ACME INC"}),
         "payment": table(spark, "payment", {"id": 1, "vendor_id": 5, "amount": 60}, {"id": 2, "vendor_id": 7, "amount": 50})}
    got = employee_match.name_matches(t, P).collect()
    assert [(r["employee_id"], r["vendor_id"], r["vendors"], r["payment_count"], float(r["total_payments"])) for r in got] == [(1, 5, 2, 2, 110.0)]


def test_similar_names_have_no_limit_and_link_all_holders(spark):
    names = [f"{c}ACME BUILDING SUPPLIES" for c in "ABCDEFGHIJKLM"]  # more than ten equally close to each other
    v = [{"id": i + 1, "name": n, "name_normalized": n} for i, n in enumerate([*names, names[0]])]
    t = {"vendor": table(spark, "vendor", *v)}
    got = {(r["vendor_id"], r["other_name"]): (r["other_vendors"], r["first_vendor"]) for r in clustering.name_relationships(t, clustering.similar_names(t, P)).collect()}
    ids = {n: [x["id"] for x in v if x["name"] == n] for n in names}
    assert got == {(x["id"], n): (len(ids[n]), min(ids[n])) for x in v for n in names if n != x["name"]}


TWO_NAMES = [{"id": i, "name": n, "name_normalized": n, "address": a} for i, n, a in
             ((1, "ABLE BUILDING", "1 Elm St"), (5, "ABLE BUILDING", "2 Elm St"), (2, "ABLEE BUILDING", "1 Elm St"), (6, "ABLEE BUILDING", "9 Oak St"))]


def test_all_vendors_of_two_shared_names_are_judged(spark):
    t = {"vendor": table(spark, "vendor", *TWO_NAMES)}
    names = clustering.similar_names(t, P)
    none = spark.createDataFrame([], "vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string, confidence_score double")
    alone = spark.createDataFrame([], "address string, vendor_id bigint, vendors bigint")
    related_ids = lambda i: sorted(r["id"] for r in clustering.related_to(t, i, none, alone, names).collect())
    assert [related_ids(i) for i in (1, 2, 5, 6)] == [[2, 6], [1, 5], [2, 6], [1, 5]]
    got = {r["entity_id"]: (r["related_vendor_id"], r["related_vendors"]) for r in clustering.similar_name_alerts(t, P, names).collect()}
    assert got == {1: (6, 1), 5: (2, 2), 2: (5, 1), 6: (1, 2)}  # 1 and 2 share an address
    edges = spark.createDataFrame([(5, 1, 60000.0, 1), (6, 1, 70000.0, 1), (1, 2, 90000.0, 1)], "vendor_id bigint, agency_id bigint, payment_total double, payment_count int")
    circles = {r["entity_id"]: (r["related_vendor_id"], r["relationship_type"]) for r in related.circular_patterns(t, P, edges, none, alone, names).collect()}
    assert circles == {5: (6, "similar_name"), 6: (5, "similar_name")}
    links = {(r["src"], r["dst"]) for r in network.vendor_links(t, none, alone, names).collect()}
    assert links == {(1, 5), (2, 6), (1, 2)}
    both = spark.createDataFrame([("1 ELM ST", 1, 2), ("1 ELM ST", 2, 2)], "address string, vendor_id bigint, vendors bigint")
    twice = spark.createDataFrame([(5, 6, "sequential_id", 0.9), (1, 5, "sequential_id", 0.9)], none.schema)
    assert network.linked_pair_count(t, twice, both, names).first()["pairs"] == 5  # (1,2) (1,6) (2,5) (5,6) by name, (1,5) by id


def test_seven_equally_close_vendors_of_a_contributor(spark):
    names = [f"ACME BUILDING SUPPLIES{c}" for c in "ABCDEFG"]
    t = {"vendor": table(spark, "vendor", *[{"id": i + 1, "name": n, "name_normalized": n} for i, n in enumerate(names)]),
         "contribution": table(spark, "contribution", {"id": 1, "contributor_normalized": "ACME BUILDING SUPPLIES", "contribution_amount": 6000, "filer_name": "F"}),
         "payment": table(spark, "payment"), "contract": table(spark, "contract")}
    assert {r["entity_id"] for r in crossref.pay_to_play(t, P).collect()} == set(range(1, 8))


def test_every_payment_day_is_compared(spark):
    rows = [(1, 1, "2001-01-01"), (2, 1, "2001-06-01"), (3, 2, "2001-01-02")]  # the payment with the highest id is far away
    t = {"payment": table(spark, "payment", *[{"id": i, "vendor_id": v, "amount": 1000, "payment_date": d} for i, v, d in rows])}
    m = spark.createDataFrame([("X", 1), ("X", 2)], "address string, vendor_id bigint")
    got = [(r["entity_id"], r["related_vendor_id"], str(r["payment_date"])) for r in duplicates.related_vendor_duplicates(t, P, m).collect()]
    assert got == [(1, 2, "2001-01-01")]


def test_contributors_and_exclusions_are_alerts_of_their_own(spark):
    cols = "alert_type string, severity string, title string, description string, entity_type string, entity_id bigint, evidence string, rule_order int"
    found = spark.createDataFrame([("pay_to_play", "low", "t", "d", "vendor", 1, f'{{"contributor_name": "{c}"}}', 0) for c in "AB"]
                                  + [("debarred_vendor", "low", "t", "d", "vendor", 1, f'{{"exclusion_id": {i}}}', 0) for i in (1, 2, 2)]
                                  + [("ghost_vendor", "low", "t", "d", "vendor", 1, f'{{"n": {i}}}', 0) for i in (1, 2)], cols)
    open_ = spark.createDataFrame([("pay_to_play", "vendor", 1, '{"contributor_name": "A"}', "new"), ("debarred_vendor", "vendor", 1, '{"exclusion_id": 1}', "resolved")],
                                  "alert_type string, entity_type string, entity_id bigint, evidence string, status string")
    got = sorted((r["alert_type"], r["evidence"]) for r in alerts.new_alerts(found, open_).collect())
    assert got == [("debarred_vendor", '{"exclusion_id": 1}'), ("debarred_vendor", '{"exclusion_id": 2}'), ("ghost_vendor", '{"n": 1}'), ("pay_to_play", '{"contributor_name": "B"}')]


def test_every_link_of_two_shared_names_is_listed(spark):
    t = {"vendor": table(spark, "vendor", *TWO_NAMES)}
    none = spark.createDataFrame([], "vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string, confidence_score double")
    at = spark.createDataFrame([("1 ELM ST", i, 3) for i in (3, 8, 9)], "address string, vendor_id bigint, vendors bigint")
    links = sorted((r["src"], r["dst"]) for r in network.linked_vendors(t, none, at, clustering.similar_names(t, P)).collect())
    assert links == [(1, 2), (1, 6), (2, 5), (3, 8), (3, 9), (5, 6)]


def test_an_employee_meets_every_vendor_of_a_name(spark):
    t = {"vendor": table(spark, "vendor", *[{"id": i, "name": "ABLE WORKS", "name_normalized": "ABLE WORKS", "in_cmbl": True} for i in (4, 7, 9)]),
         "employee": table(spark, "employee", *[{"id": i, "name": "ABLE WORKS", "name_normalized": "ABLE WORKS"} for i in (1, 2)])}
    got = sorted((r["employee_id"], r["vendor_id"], r["alerting"]) for r in crossref.employee_vendor_scan(t, P).collect())
    assert got == [(e, v, True) for e in (1, 2) for v in (4, 7, 9)]


def test_crowded_cells_keep_their_partitions(spark):
    """Few bytes of names, much to compare: adaptive execution may not join these partitions."""
    names = spark.range(60).selectExpr("concat('ACME PAPER ', id) as name", "id % 30 as key", "cast(-1 as bigint) as own")
    rows = fuzzy_join._in_cells(names, names, 8, True)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert rows.count() == 60


def test_triangles_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = {"vendor": table(spark, "vendor", {"id": 1, "name_normalized": "ACME"}),
         "contribution": table(spark, "contribution", {"contributor_normalized": "ACME", "filer_name": "F", "contribution_amount": 5})}
    triangles = spark.range(1, 2).selectExpr("id as vendor_id").mapInArrow(count, "vendor_id bigint")
    got = related.triangle_recipients(t, Params(as_of=dt.date(2020, 1, 1)), triangles).collect()
    assert [(r["vendor_id"], r["filer_name"], r["place"]) for r in got] == [(1, "F", 1)]
    assert seen.value == 1


def counted(spark, df):
    """df and how many of its rows were read so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def test_pairs_of_names_carry_their_ids(spark):
    rows = [(f"ACME PAPER {n}", 10 * n + k) for n in range(1, 40) for k in range(1 + (n % 5 == 0))] + [("ZEBRA", None)]
    held = {}
    for name, i in rows:
        held.setdefault(name, []).append(i)
    df = spark.createDataFrame(rows, "name string, id bigint")
    plain = {(r["left_name"], r["right_name"], r["score"]) for r in fuzzy_join.fuzzy_pairs(df, "name", df, "name", 85).collect()}
    assert len(plain) > 100
    for more in ({}, {"cell_rows": 8, "class_names": 1}, {"cell_rows": 8, "grams": 1}):  # by keys, by classes, by keys in many cells
        got = fuzzy_join.fuzzy_pairs(df, "name", df, "name", 85, ids="id", **more).collect()
        assert {(r["left_name"], r["right_name"], r["score"]) for r in got} == plain and len(got) == len(plain)
        for r in got:
            for side in ("left", "right"):
                of = held[r[f"{side}_name"]]
                assert (r[f"{side}_first"], r[f"{side}_rows"]) == (min(of, default=None) if None not in of else None, len(of))


def test_a_spelling_is_cleaned_once(spark, monkeypatch):
    seen, clean = spark.sparkContext.accumulator(0), resolve.normalize_vendor_name

    def look(batches):
        for texts in batches:
            seen.add(len(texts))
            yield texts

    look.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    monkeypatch.setattr(resolve, "normalize_vendor_name", lambda c: clean(F.pandas_udf(look, "string")(c)))
    rows = spark.range(200).selectExpr("id as _pos", "case when id % 4 = 0 then 'Acme, Inc.' when id % 4 = 1 then 'Best Co' when id % 4 = 2 then '' end as vendor_name")
    none = spark.createDataFrame([(7, "BEST CO")], "id bigint, name_normalized string")
    got = [(r["name"], r["name_normalized"]) for r in resolve.new_vendors(rows, none, dt.date(2020, 1, 1)).collect()]
    linked = {(r["vendor_name"], r["vendor_id"]): r["n"] for r in resolve.link_vendors(rows, none).groupBy("vendor_name", "vendor_id").agg(F.count("*").alias("n")).collect()}
    assert got == [("Acme, Inc.", "ACME INC")]
    assert linked == {("Acme, Inc.", None): 50, ("Best Co", 7): 50, ("", None): 50, (None, None): 50}
    assert 0 < seen.value < 50


def test_matches_are_worked_out_once_for_both_writes(spark, monkeypatch):
    df, seen = counted(spark, spark.createDataFrame([(1, "A", 2, 0.9)], "employee_id bigint, employee_name string, vendor_id bigint, confidence double"))
    monkeypatch.setattr(source_queries.employee_match, "name_matches", lambda t, p: df)
    monkeypatch.setattr(source_queries.employee_match, "address_sides", lambda t: spark.createDataFrame([], "address string, side string, id bigint"))
    t = {"agency": table(spark, "agency", {"name": "ONE"}), "payment": table(spark, "payment")}
    got = sorted((r["kind"], r["id"], r["other"]) for r in source_queries._learned(t, P).collect())
    assert got == [("agency", 1, None), ("name", 1, 2)] and seen.value == 1
