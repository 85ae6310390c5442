"""From landed files to stored tables, for every source: what is added, what changes, what stays."""

import datetime as dt
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spendwarden import schema
from spendwarden.loads import SOURCES, load
from spendwarden.operators import tables
from spendwarden.schema import read_tables

AT = dt.datetime(2024, 5, 1, 12)
HOUR = dt.timedelta(hours=1)


def land(folder: Path, name: str, text: str, when: dt.datetime = AT - HOUR, encoding: str = "utf-8") -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    stamp = when.replace(tzinfo=dt.timezone.utc).timestamp()
    os.utime(folder / name, (stamp, stamp))
    return str(folder)


def lines(*rows: dict) -> str:
    return "\n".join(map(json.dumps, rows))


def files(root: str) -> dict[str, int]:
    """Data files of the tables (not of the log) and when they were written."""
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("part-*") if "sync_status" not in str(p)}


def rows(spark, root, name, *columns):
    return sorted((tuple(r) for r in read_tables(spark, root, name)[name].selectExpr(*columns).collect()), key=str)


# source: options, files, table, columns, rows expected
PAGE = ("<table id='contracts-table'><thead><tr><th>Contract #</th><th>Vendor Name</th><th>Start Date</th></tr></thead><tbody>"
        "<tr><td>H1</td><td>Acme Inc</td><td>5/1/2020</td></tr><tr><td>H1</td><td>Other</td><td></td></tr></tbody></table>")
CASES = {
    "bidders": ({}, {"a.csv": "WEB_VID,WEB_NAME_VENDOR_NAME,WEB_ADDR1,WEB_CITY,WEB_STATE\n1,Acme Inc,1 Elm,Waco,TX\n2,Beta Co,,,\n,No Id,,,\n1,Acme Inc.,1 Elm,Waco,TX\n"},
                "vendor", ("vendor_id", "name", "in_cmbl", "hub_status"), [("1", "Acme Inc.", True, None), ("2", "Beta Co", True, None)]),
    "certified_bidders": ({}, {"a.csv": "VENDOR ID NUMBER,VENDOR NAME, STATUS CODE\n1,Acme Inc,\n2,Beta Co,BL\n"}, "vendor", ("vendor_id", "hub_status"), [("1", "HUB"), ("2", "BL")]),
    "expenditures": ({"fiscal_year": 2023}, {"a.json": lines({"amount": "10.50", "agency_name": "Dept Of Roads", "agency_number": "601", "major_spending_category": "Fuel"},
                                                             {"amount": "4", "agency_name": "Dept Of Roads", "agency_number": "601", "major_spending_category": "Fuel"}, {"amount": "0"})},
                     "payment", ("source_id", "fiscal_year_state", "cast(amount as double)"), [("2023-601-Fuel", 2023, 10.5)]),
    "payments": ({}, {"a.json": lines({"id": "1", "amount": "5", "date": "2023-09-01", "payee_name": "Acme Inc", "agency_name": "Dept"},
                                      *[{"amount": "7", "date": "2023-08-01", "payee_name": "Acme, Inc.", "agency_name": "Dept"}] * 2)},
                 "payment", ("fiscal_year_state", "cast(amount as double)", "vendor_id is not null", "agency_id is not null"),
                 [(2023, 7.0, True, True), (2023, 7.0, True, True), (2024, 5.0, True, True)]),
    "payee_payments": ({"dataset": "spend_2023"}, {"a.json": lines({"payee": "Acme", "agency": "Dept", "amount": "5", "payment_date": "2023-01-02"}, {"payee_name": "ACME", "agency": "Dept", "amount": "5.00", "payment_date": "2023-01-02T00:00"},
                                                                   {"payee": "Acme", "amount": "5", "payment_date": "2023-01-02"})},
                       "payment", ("fiscal_year_state", "cast(amount as double)", "agency_id is not null"), [(2023, 5.0, False), (2023, 5.0, True)]),
    "contracts": ({}, {"a.csv": "Contract,Vendor,Agency,Subject,Current Contract Value\nC1,Acme,Dept," + "long " * 200 + ",5\nC1,Acme,Dept,again,6\n"},
                  "contract", ("contract_number", "length(description)", "cast(current_value as double)"), [("C1", 999, 5.0)]),
    "contract_sheet": ({}, {"a.csv": "Contract Number,Vendor Name,Value,Max Value\nC1,Acme,5,9\nC1,Acme,nan,8\n"}, "contract", ("contract_number", "cast(max_value as double)"), [("C1", 8.0)]),
    "awards": ({"award_type": "grants", "fiscal_year": 2023}, {"a.json": lines({"Award ID": "A1", "Recipient Name": "Acme", "Awarding Agency": "Department of Energy", "Award Amount": "7"},
                                                                               {"Award ID": "A1", "Recipient Name": "Other", "Award Amount": "8"})},
               "grant", ("grant_number", "source", "cast(amount_awarded as double)", "recipient_id is not null"), [("A1", "usaspending_grants", 7.0, True)]),
    "cooperative_contracts": ({}, {"a.json": lines({"contract_number": "D1", "primary_vendor_name": "Acme", "rfo_description": "Laptops", "contract_type": "Tech", "contract_subtype": "HW"})},
                              "contract", ("contract_number", "description"), [("D1", "Laptops [Tech/HW]")]),
    "contract_sales": ({}, {"a.json": lines({"contract_number": "D1", "purchase_amount": "5", "vendor_name": "Acme", "customer_name": "City"}, {"contract_number": "D1", "purchase_amount": "2.5"}, {"contract_number": "D1", "purchase_amount": "-1"})},
                       "contract", ("contract_number", "cast(current_value as double)"), [("D1", 7.5)]),
    "salaries": ({}, {"a.csv": "FIRST NAME,LAST NAME,AGENCY NAME,AGENCY,ANNUAL\nAnn,Lee,Dept,601,10\nANN,LEE,Dept,601,20\n"}, "employee", ("name", "cast(annual_salary as double)"), [("Ann Lee", 20.0)]),
    "permits": ({"permit_type": "sales"}, {"a.json": lines({"taxpayer_name": "Acme", "taxpayer_number": "1"}, {"taxpayer_name": "Acme Two", "taxpayer_number": "1"}, *[{"taxpayer_name": "Bare"}] * 2)},
                "tax_permit", ("taxpayer_name",), [("Acme Two",), ("Bare",), ("Bare",)]),
    "contributions": ({}, {"contribs_1.csv": "filerName,contributorNameOrganization,contributionAmount,contributionDate\nPAC,Acme,600,20230102\nPAC,Acme,600,20230102\nPAC,Acme,400,20230102\n", "other.csv": "filerName\nX\n"},
                      "contribution", ("filer_name", "contributor_name", "cast(contribution_amount as double)"), [("PAC", "Acme", 600.0)]),
    "exclusions": ({}, {"a.csv": "SAM Number,Name,Termination Date\nS1,Acme,2020-01-01\nS2,,\n,X,\n"}, "debarred", ("sam_number", "entity_name", "is_active"), [("S1", "Acme", False), ("S2", "Unknown", True)]),
    "exclusions_json": ({}, {"a.json": lines({"samNumber": "S1", "exclusionIdentification": {"name": "Acme", "ueiSAM": "U"}, "exclusionAddress": {"city": "Waco"}})},
                        "debarred", ("sam_number", "entity_name", "uei", "city"), [("S1", "Acme", "U", "Waco")]),
    "bids": ({}, {"a.json": lines({"control_section_job_csj": "J1", "vendor_name": "Acme", "bid_total_amount": "5", "bid_rank_sequence_number": "1.0", "project_actual_let_date": "2023-02-01"},
                                  {"control_section_job_csj": "J2", "vendor_name": "Acme", "project_actual_let_date": "2019-02-01"})},
             "construction_bid", ("project_id", "is_winner", "vendor_id"), [("J1", True, None)]),
    "construction_contracts": ({}, {"a.json": lines({"contract_number": "7", "controlling_project_id_ccsj": "8", "contractor": "Acme", "final_contract_amount": "", "original_contract_amount": "9"})},
                               "contract", ("contract_number", "cast(max_value as double)"), [("TXDOT-7-8", 9.0)]),
    "health_contracts": ({}, {"a.html": PAGE}, "hhs_contract", ("contract_number", "vendor_name", "start_date"), [("H1", "Acme Inc", dt.date(2020, 5, 1))]),
}


@pytest.mark.parametrize("source", sorted(CASES))
def test_files_to_table_and_again(spark, tmp_path, source, monkeypatch):
    monkeypatch.setattr(schema, "PARTS", 2)
    options, landed, name, columns, want = CASES[source]
    root = str(tmp_path / "audit")
    for file, text in landed.items():
        path = land(tmp_path / "landed", file, text)
    got = load(spark, root, source, path, AT, **options)
    assert rows(spark, root, name, *columns) == want and got["records"] > 0
    before = files(root)
    again = load(spark, root, source, path, AT + HOUR, full=True, **options)  # the same files, read again
    assert again["records"] == 0 and files(root) == before and rows(spark, root, name, *columns) == want
    newer = load(spark, root, source, path, AT + 2 * HOUR, **options)  # no file is new
    assert newer["records"] == 0 and files(root) == before
    log = rows(spark, root, "sync_status", "status", "records_synced")
    assert [x[0] for x in log] == ["in_progress"] * 3 + ["success"] * 3
    ids = read_tables(spark, root, name)[name]
    assert ids.select("id").distinct().count() == ids.count() and ids.where("id is null").isEmpty()


def test_every_source_has_a_case():
    assert set(CASES) | {"class_codes"} == set(SOURCES)


def test_class_codes_reach_known_vendors(spark, tmp_path):
    root = str(tmp_path / "audit")
    load(spark, root, "bidders", land(tmp_path / "v", "a.csv", "WEB_VID,WEB_NAME_VENDOR_NAME\n1,Acme\n2,Beta\n"), AT)
    assert load(spark, root, "class_codes", land(tmp_path / "c", "a.csv", "CLASS_VID,CLASS_CODE\n1,915\n1,015\n1,915\n9,1\n"), AT)["records"] == 1
    assert rows(spark, root, "vendor", "vendor_id", "nigp_codes") == [("1", ["015", "915"]), ("2", None)]


def test_only_new_files_are_read_and_only_changed_partitions_written(spark, tmp_path):
    root, folder = str(tmp_path / "audit"), tmp_path / "v"
    head = "WEB_VID,WEB_NAME_VENDOR_NAME,WEB_ADDR1,WEB_PHONE\n"
    path = land(folder, "a.csv", head + "".join(f"{i},Vendor {i},{i} Elm,\n" for i in range(200)))
    load(spark, root, "bidders", path, AT)
    before = files(root)
    assert len({Path(f).parent for f in before}) > 8
    land(folder, "a.csv", "broken file that no load may read again\n" * 3)
    land(folder, "b.csv", head + "7,Vendor Seven,,555\n201,New,1 Oak,\n", AT + HOUR)
    got = load(spark, root, "bidders", path, AT + 2 * HOUR)
    assert got["since"] == AT.replace(tzinfo=dt.timezone.utc) and got["records"] == 2
    v = {r["vendor_id"]: r for r in read_tables(spark, root, "vendor")["vendor"].collect()}
    assert len(v) == 201 and (v["7"]["name"], v["7"]["address"], v["7"]["phone"]) == ("Vendor Seven", "7 Elm", "555") and v["8"]["name"] == "Vendor 8"
    gone = {Path(f).parent for f in set(before) - set(files(root))}
    assert 1 <= len(gone) <= 2  # the partitions of 7 and, if it lies in an old one, of 201
    assert all(files(root)[f] == t for f, t in before.items() if Path(f).parent not in gone)


def test_a_failed_load_is_logged_and_done_again(spark, tmp_path):
    root = str(tmp_path / "audit")
    path = land(tmp_path / "p", "a.json", lines({"id": "1", "amount": "5", "payee_name": "Acme", "agency_name": "Dept"}))
    with pytest.raises(KeyError):
        load(spark, root, "payee_payments", path, AT)  # the dataset's name is missing
    log = read_tables(spark, root, "sync_status")["sync_status"].where("status = 'failed'").collect()
    assert len(log) == 1 and "dataset" in log[0]["error_message"] and log[0]["read_until"] is None
    assert load(spark, root, "payee_payments", path, AT + HOUR, dataset="y_2023")["records"] == 1
    assert load(spark, root, "payee_payments", str(tmp_path / "nowhere"), AT + 2 * HOUR, dataset="y")["records"] == 0
    with pytest.raises(ValueError, match="unknown source"):
        load(spark, root, "nothing", path, AT)


def test_files_of_different_headers_load_whole(spark, tmp_path):
    """Two files of different order and columns, in Latin-1, one with quoted line ends, one with a byte order mark."""
    folder = tmp_path / "c"
    land(folder, "contrib_a.csv", "filerName,contributorNameLast,contributorNameFirst,contributionAmount,contributionDate\nPAC A,Díaz,Ana,700,01/02/2023\n", encoding="latin-1")
    land(folder, "contrib_b.csv", "date,amount,extra,organisation,contributor,recipientName,recipientName\n2023-03-04,\"$1,800.00\",\"two\nlines\",x,Acme Inc,PAC B,PAC C,beyond\n,,,,,,\n20230506,900,,,\"Beta, Co\",PAC B\n")
    land(folder, "contrib_c.csv", "filerName\n")
    path = land(folder, "contrib_d.csv", "﻿filerName,contributorName,amount\nPAC D,Solo,500\n")
    root = str(tmp_path / "audit")
    load(spark, root, "contributions", path, AT)
    assert rows(spark, root, "contribution", "filer_name", "contributor_name", "cast(contribution_amount as double)", "cast(contribution_date as string)") == [
        ("PAC A", "Ana Díaz", 700.0, "2023-01-02"), ("PAC B", "Acme Inc", 1800.0, "2023-03-04"), ("PAC B", "Beta, Co", 900.0, "2023-05-06"), ("PAC D", "Solo", 500.0, None)]
    raw = {r["filer_name"]: json.loads(r["raw_data"]) for r in read_tables(spark, root, "contribution")["contribution"].where("contributor_name = 'Acme Inc'").collect()}
    assert raw["PAC B"]["extra"] == "two\nlines" and raw["PAC B"]["7"] == "beyond" and raw["PAC B"]["recipientName"] == "PAC B"


def test_sheet_updates_and_sales_add_up(spark, tmp_path):
    root = str(tmp_path / "audit")
    sheet, sold = tmp_path / "s", tmp_path / "d"
    load(spark, root, "contract_sheet", land(sheet, "a.csv", "Contract Number,Vendor Name,Value,Description\nD1,Acme,100,First\n"), AT)
    load(spark, root, "contract_sales", land(sold, "a.json", lines({"contract_number": "D1", "purchase_amount": "5", "vendor_name": "Acme", "customer_name": "City"})), AT)
    load(spark, root, "contract_sales", land(sold, "b.json", lines({"contract_number": "D1", "purchase_amount": "7"}, {"contract_number": "D2", "purchase_amount": "3", "vendor_name": "Beta", "customer_name": "City"}), AT + HOUR), AT + 2 * HOUR)
    worth = lambda: {r["contract_number"]: (float(r["current_value"]), r["description"]) for r in read_tables(spark, root, "contract")["contract"].collect()}
    assert worth() == {"D1": (112.0, "First"), "D2": (3.0, None)}
    assert load(spark, root, "contract_sales", str(sold), AT + 3 * HOUR, full=True)["records"] == 0 and worth()["D1"][0] == 112.0
    load(spark, root, "contract_sheet", land(sheet, "b.csv", "Contract Number,Description,Value\nD2,Second,nan\n", AT + 3 * HOUR), AT + 4 * HOUR)
    assert worth()["D2"] == (3.0, "Second")


def test_an_id_taken_by_another_key_drops_nothing(spark, tmp_path):
    root = str(tmp_path / "audit")
    made = lambda *r: spark.createDataFrame(r, "id bigint, source_system string, source_id string, amount decimal(15,2), _pos int")
    from decimal import Decimal as D
    put = lambda df: tables.insert_into(spark, root, "payment", df, ["source_system", "source_id"], F.col("_pos"))
    assert put(made((1, "a", "x", D(1), 1), (1, "a", "y", D(2), 2), (2, "a", "z", D(3), 3))) == 3
    assert put(made((2, "a", "w", D(4), 1), (9, "a", "x", D(1), 2))) == 1
    got = read_tables(spark, root, "payment")["payment"].collect()
    assert len(got) == 4 == len({r["id"] for r in got}) and {r["source_id"] for r in got} == set("xyzw") and all(r["id"] >= 0 for r in got)


def test_best_scores_and_rows_without_change(spark, tmp_path):
    root, keys = str(tmp_path / "audit"), schema.KEYS["vendor_relationship"]
    made = lambda *r: spark.createDataFrame(r, "vendor_id_1 bigint, vendor_id_2 bigint, relationship_type string, confidence_score double, evidence string")
    put = lambda df: tables.update_in(spark, root, "vendor_relationship", df, keys, F.struct("confidence_score", "evidence"), score="confidence_score")
    assert put(made((1, 2, "t", 0.8, "a"), (1, 2, "t", 0.9, "b"), (1, 3, "t", 0.5, "c"))) == 2
    assert put(made((1, 2, "t", 0.9, "z"), (1, 3, "t", 0.4, "z"))) == 0
    assert put(made((1, 3, "t", 0.7, "d"), (2, 3, "t", 0.1, "e"))) == 2
    got = {(r["vendor_id_1"], r["vendor_id_2"]): (float(r["confidence_score"]), r["evidence"]) for r in read_tables(spark, root, "vendor_relationship")["vendor_relationship"].collect()}
    assert got == {(1, 2): (0.9, "b"), (1, 3): (0.7, "d"), (2, 3): (0.1, "e")}
    with pytest.raises(ValueError, match="not stored by key"):
        tables.update_in(spark, root, "payment", made(), ["id"], F.lit(1))
