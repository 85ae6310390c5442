import datetime as dt

from spendwarden.params import Params
from spendwarden.jobs import detect, load_bids, load_contracts, load_payments, write_learned
from spendwarden.schema import TABLES, conform, read_tables, schema_of, write_table
from spendwarden.sources import contracts, payments

DAY = dt.date(2001, 7, 31)


def test_every_table_has_a_schema(spark):
    assert len(TABLES) >= 17
    for name in TABLES:
        assert spark.createDataFrame([], schema_of(name)).count() == 0


def test_files_to_alerts(spark, tmp_path):
    root = str(tmp_path / "audit")
    t = read_tables(spark, root, *TABLES)
    raw = spark.createDataFrame([(i, f"P{i}", "20000", "2001-03-01" if i < 3 else "2001-03-15", "Acme Supply Co", "Dept of Roads") for i in range(5)],
                                "_pos int, id string, amount string, date string, payee_name string, agency_name string")
    got = load_payments(payments.map_payments(raw), t, DAY)
    assert got["payment"].count() == 5 and got["vendor"].count() == 1 and got["agency"].count() == 1
    c = spark.createDataFrame([(i, f"C{i}", "Acme Supply Company", "Dept of Roads", "46000", "2001-06-01") for i in range(3)],
                              "_pos int, `Contract` string, `Vendor` string, `Agency` string, `Current Contract Value` string, `Award Date` string")
    more = load_contracts(contracts.map_contract_csv(c), {**t, **got}, DAY)
    assert more["vendor"].count() == 1 and more["agency"].count() == 1
    for name, df in {**got, **more}.items():
        write_table(df, name, f"{root}/{name}")
    stored = read_tables(spark, root, *TABLES)
    again = load_payments(payments.map_payments(raw), stored, DAY)
    assert again["payment"].count() == 5 and again["vendor"].count() == 1

    outcome = detect(spark, root, Params(as_of=DAY), dt.datetime(2001, 8, 1))
    assert {o["status"] for o in outcome} == {"success"}, outcome
    learned = read_tables(spark, root, "address_member", "name_relationship", "entity_match", "agency")
    assert learned["agency"].count() == 1 and learned["entity_match"].count() == 0
    alerts = read_tables(spark, root, "alert")["alert"]
    kinds = {r["alert_type"] for r in alerts.collect()}
    assert {"contract_splitting", "duplicate_payment", "near_duplicate_payment", "ghost_vendor"} <= kinds
    n = alerts.count()
    detect(spark, root, Params(as_of=DAY), dt.datetime(2001, 8, 2))  # all alerts are open, so none is new
    assert read_tables(spark, root, "alert")["alert"].count() == n


def test_bids_link_without_creating(spark):
    raw = spark.createDataFrame([(1, "J1", "Acme, Inc.", "1.0"), (2, "J1", "Other", "2")], "_pos int, control_section_job_csj string, vendor_name string, bid_rank_sequence_number string")
    v = conform(spark.createDataFrame([(4, "ACME INC")], "id bigint, name_normalized string"), "vendor")
    got = {r["contractor_name"]: (r["vendor_id"], r["is_winner"]) for r in load_bids(contracts.map_bids(raw), {"vendor": v}).collect()}
    assert got == {"Acme, Inc.": (4, True), "Other": (None, False)}


def test_what_rules_learned_is_written_once(spark, tmp_path):
    root = str(tmp_path / "audit")
    make = spark.createDataFrame
    shared = {
        "sequential": make([(1, 2, "sequential_id", 0.8, "e", 2)], "vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string, confidence_score double, evidence string, first_vendor bigint"),
        "names": make([("A", "B", 0.9), ("B", "A", 0.9)], "name string, other_name string, confidence_score double"),
        "members": make([("X", 1, 2), ("X", 2, 2)], "address string, vendor_id bigint, vendors bigint"),
        "employee_names": make([(7, "Ann", 1, 0.95)], "employee_id bigint, employee_name string, vendor_id bigint, confidence double"),
        "sides": make([("X", "employee", 7), ("X", "vendor", 1)], "address string, side string, id bigint")}
    write_table(make([(3, "A", "Agency"), (4, "B", "Other")], "id bigint, agency_code string, name string"), "agency", f"{root}/agency")
    found = make([("high_confidentiality_rate", 3, '{"rate":0.25}'), ("other", 4, '{"rate":0.5}')], "alert_type string, entity_id bigint, evidence string")
    assert write_learned(spark, root, shared, found) == {"vendor_relationship": 1, "name_relationship": 2, "address_member": 2, "entity_match": 2, "agency": 1}
    assert set(write_learned(spark, root, shared, found).values()) == {0}
    got = {r["id"]: r["confidentiality_rate"] for r in read_tables(spark, root, "agency")["agency"].collect()}
    assert float(got[3]) == 0.25 and got[4] is None
    assert write_learned(spark, root, {}, None) == {}
