import datetime as dt
import json
import random

from pyspark.sql import functions as F

from helpers import table

from spendwarden.operators import resolve
from spendwarden.params import Params
from spendwarden.plans import reports, requests, splitting
from spendwarden.sources import contracts, html_tables, parties, payments, readers, vendors

DAY = dt.date(2024, 5, 1)


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


def test_vendor_csv_latin1_and_drift(spark, tmp_path):
    write(tmp_path, "a.csv", "VENDOR ID NUMBER, VENDOR NAME,VENDOR ADDRESS LINE 1,CITY,STATE,ZIP CODE,STATUS CODE\n"
          "17, Señor Díaz Company ,1 North Main Street,austin,Texas,78701-1,\n18,Plain Co,,Waco,TX,1,HI\n,No Id,,,,,\n", "latin-1")
    got = {r["vendor_id"]: r for r in vendors.map_vendors(readers.read_csv(spark, str(tmp_path)), DAY, certified=True).collect()}
    assert set(got) == {"17", "18"}
    assert (got["17"]["name_normalized"], got["17"]["city"], got["17"]["state"], got["17"]["hub_status"]) == ("SEÑOR DÍAZ CO", "AUSTIN", "TX", "HUB")
    assert (got["18"]["city"], got["18"]["hub_status"]) == (None, "HI")
    old = spark.createDataFrame([(5, "18", "Old", dt.date(2020, 1, 1), "555", "Elm")], "id bigint, vendor_id string, name string, first_seen date, phone string, address string")
    up = {r["vendor_id"]: r for r in vendors.upsert_vendors(old, vendors.map_vendors(readers.read_csv(spark, str(tmp_path)), DAY)).collect()}
    assert (up["18"]["id"], up["18"]["name"], up["18"]["first_seen"], up["18"]["phone"], up["18"]["address"]) == (5, "Plain Co", dt.date(2020, 1, 1), "555", "Elm")
    assert up["17"]["first_seen"] == DAY


def test_first_row_in_file_order_wins(spark, tmp_path):
    write(tmp_path, "c.csv", "Contract-ID,Vendor,Agency,Subject,Current Contract Value,Award Date,Completion Date,NGIP Codes and Categories\n"
          "\"<a href=\"\"/x\"\">C 1</a>\",V,A,First,\"$1,000.50\",2024-01-02,3/4/2025,915-01 a; 920-22\nC 1,V,A,Second,5,,,\n,V,A,None,5,,,\n")
    got = contracts.map_contract_csv(readers.read_csv(spark, str(tmp_path))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["contract_number"], r["description"], str(r["current_value"]), r["start_date"], r["end_date"], r["nigp_codes"]) == (
        "C 1", "First", "1000.50", dt.date(2024, 1, 2), dt.date(2025, 3, 4), ["915-01", "920-22"])


def test_payments_json(spark, tmp_path):
    rows = [{":id": "1", "amount": "$10.00", "date": "2023-09-01T00:00:00.000", "payee_name": "Acme Co", "agency_name": "Dept", "confidential": "y"},
            {":id": "1", "amount": "11", "date": "2023-09-02"}, {"amount": "0"}, {"amount": "bad"}, {"amount": 5, "date": "9/30/2023"}, {"amount": 5}]
    write(tmp_path, "p.json", "\n".join(map(json.dumps, rows)))
    got = sorted(payments.map_payments(readers.read_json(spark, str(tmp_path))).collect(), key=lambda r: (r["amount"], str(r["payment_date"])))
    assert [float(r["amount"]) for r in got] == [5, 5, 10]
    assert (got[2]["fiscal_year_state"], got[2]["fiscal_year_federal"], got[2]["is_confidential"], got[2]["source_id"]) == (2024, 2023, True, "1")
    v = table(spark, "vendor", {"id": 9, "name_normalized": "OTHER"})
    linked, all_vendors = resolve.resolve_vendors(payments.map_payments(readers.read_json(spark, str(tmp_path))), v, DAY)
    assert {r["name_normalized"] for r in all_vendors.collect()} == {"OTHER", "ACME CO"}
    assert linked.where("vendor_id is not null").count() == 1
    again, same = resolve.resolve_vendors(payments.map_payments(readers.read_json(spark, str(tmp_path))), all_vendors, DAY)
    assert same.count() == 2


def test_payee_year_from_dataset_name(spark):
    df = spark.createDataFrame([(1, "Acme", "", "7", "2023-01-05Z"), (2, "Acme", "Dept", "x", None), (3, "", "Dept", "7", None)],
                               "_pos int, payee_name string, agency string, expenditure_amount string, check_date string")
    got = payments.map_payee_payments(df, "spend_2023").collect()
    assert [(r["fiscal_year_state"], r["agency_name"], r["payment_date"]) for r in got] == [(2023, None, dt.date(2023, 1, 5))]


def test_sheet_updates_and_sales_are_idempotent(spark):
    df = spark.createDataFrame([(1, "N1", "5", "nan"), (2, "N1", "nan", "9"), (3, "nan", "1", "1")], "_pos int, `Contract No` string, `Contract Value` string, `Value` string")
    got = contracts.map_contract_sheet(df.withColumnRenamed("Contract No", "Contract Number")).collect()
    assert [(r["contract_number"], float(r["current_value"])) for r in got] == [("N1", 9.0)]
    base = spark.createDataFrame([("N1", 100.0)], "contract_number string, v double").selectExpr("contract_number", "cast(v as decimal(15,2)) as current_value")
    sold = contracts.sales_rollup(spark.createDataFrame([(1, "N1", "10"), (2, "N1", "-3"), (3, "N2", "4"), (4, "N2", "6")], "_pos int, contract_number string, purchase_amount string"))
    once = contracts.apply_sales(base, sold)
    twice = contracts.apply_sales(once, sold)
    for df in (once, twice):
        assert {r["contract_number"]: float(r["current_value"]) for r in df.collect()} == {"N1": 110.0, "N2": 10.0}


def test_salaries_last_row_wins(spark):
    df = spark.createDataFrame([(1, "Ann", "Lee", "", "$10", "01-02-2003"), (2, "ANN", "LEE", "", "20", "2003/01/05"), (3, "", "", "Bo Oz", "", "")],
                               "_pos int, `FIRST NAME` string, `LAST NAME` string, `Name` string, `ANNUAL` string, `HIRE DATE` string")
    rows = resolve.link_agencies(payments.map_salaries(df), table(spark, "agency", {"name": "A", "agency_code": "A"}))
    got = {r["name_normalized"]: r for r in payments.last_salaries(rows).collect()}
    assert (got["ANN LEE"]["name"], float(got["ANN LEE"]["annual_salary"]), got["ANN LEE"]["hire_date"]) == ("Ann Lee", 20.0, dt.date(2003, 1, 5))
    assert got["BO OZ"]["annual_salary"] is None


def test_contribution_files_prefer_contrib(spark, tmp_path):
    head = "filerName,contributorNameOrganization,contributorNameFirst,contributorNameLast,contributionAmount,contributionDate\n"
    write(tmp_path, "other.csv", head + "X,Y,,,900,20240101\n")
    assert parties.map_contributions(readers.contribution_files(spark, str(tmp_path))).count() == 1
    write(tmp_path, "MyContribs.CSV", head + "F,,Jo,Fox,\"$1,500\",20240102\nF,,Jo,Fox,1500.00,01/02/2024\nF,Org,,,499.99,\n")
    got = parties.map_contributions(readers.contribution_files(spark, str(tmp_path))).collect()
    assert [(r["contributor_name"], float(r["contribution_amount"]), r["contribution_date"]) for r in got] == [("Jo Fox", 1500.0, dt.date(2024, 1, 2))]


def test_exclusions(spark, tmp_path):
    write(tmp_path, "x.csv", "SAM Number,Name,First,Last,Address 1,Address 3,Active Date,Termination Date\n"
          "S1,Bad Co,,,1 Elm,Unit 2,2020-01-01,05/01/2024\nS1,Other,,,,,,\nS2,,Jo,Fox,,,1-Feb-2020,30 Apr 2024\nS3,,,,,,,Indefinite\n,No,,,,,,\n")
    got = {r["sam_number"]: r for r in parties.map_exclusions(readers.read_csv(spark, str(tmp_path), "UTF-8"), DAY).collect()}
    assert (got["S1"]["entity_name"], got["S1"]["address"], got["S1"]["is_active"]) == ("Bad Co", "1 Elm, Unit 2", True)
    assert (got["S2"]["entity_name"], got["S2"]["start_date"], got["S2"]["is_active"]) == ("Jo Fox", dt.date(2020, 2, 1), False)
    assert (got["S3"]["entity_name"], got["S3"]["is_active"]) == ("Unknown", True)
    nested = [{"exclusionIdentification": {"samNumber": "S9", "firstName": "A", "lastName": "B"}, "exclusionActions": {"terminationDate": "2024-04-30"}, "exclusionAddress": {"addressLine1": "1 Elm"}}]
    (tmp_path / "j").mkdir()
    write(tmp_path / "j", "x.json", json.dumps(nested[0]))
    r = parties.map_exclusions_json(readers.read_json(spark, str(tmp_path / "j")), DAY).first()
    assert (r["sam_number"], r["entity_name"], r["address"], r["is_active"]) == ("S9", "A B", "1 Elm", False)


def test_html_tables(spark):
    table_html = ("<table id='other'><tr><td>no</td></tr></table><table id='contracts-table'><thead><tr><th>Contract #</th><th>Vendor</th></tr></thead>"
                  "<tbody><tr><td> <a href='/c1'>HH 1</a></td><td>Acme <i>Co</i></td><td>Jan 5, 2024</td><td>RFP&amp;9</td></tr><tr><td>only</td><td>two</td></tr></tbody></table>")
    plain = "<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>HH 2</td><td>Beta</td><td>2024-02-03</td></tr></table>"
    pages = spark.createDataFrame([(1, table_html), (2, plain), (3, "<p>none</p>"), (4, None)], "page_id bigint, html string")
    rows = html_tables.table_rows(pages)
    got = {r["page_id"]: r["cells"] for r in rows.collect()}
    assert got[1] == {"contract_#": "HH 1", "contract_#_link": "/c1", "vendor": "AcmeCo", "col_2": "Jan 5, 2024", "col_3": "RFP&9"}
    assert got[2] == {"col_0": "HH 2", "col_1": "Beta", "col_2": "2024-02-03"}
    out = {r["contract_number"]: r for r in html_tables.map_health_contracts(rows).collect()}
    assert (out["HH 1"]["start_date"], out["HH 1"]["solicitation_number"], out["HH 2"]["start_date"]) == (dt.date(2024, 1, 5), "RFP&9", dt.date(2024, 2, 3))


def test_agency_codes(spark):
    a = table(spark, "agency", {"name": "Department of Energy", "agency_code": "FED_DOE"}, {"name": "Dept of Old Eggs", "agency_code": "FED_DOOE"})
    rows = spark.createDataFrame([(1, "Department of Education"), (2, "Division of Eels"), (3, "Department of Energy"), (4, "")], "_pos int, agency_name string")
    got = {r["name"]: r["agency_code"] for r in resolve.coded_agencies(rows, a).collect()}
    assert got == {"Department of Education": "FED_DOE_2", "Division of Eels": "FED_DOE_3"}
    rows = spark.createDataFrame([(1, "One", "X"), (2, "Two", "X"), (3, "One", "Y"), (4, "Three", "")], "_pos int, agency_name string, agency_code string")
    linked, all_ = resolve.resolve_agencies(rows, a.where("id < 0"))
    names = {r["id"]: (r["agency_code"], r["name"]) for r in all_.collect()}
    assert set(names.values()) == {("X", "One"), ("T", "Three")}
    assert {r["_pos"]: names[r["agency_id"]][1] for r in linked.collect()} == {1: "One", 2: "One", 3: "One", 4: "Three"}


def test_requests_and_reports(spark):
    alert = table(spark, "alert", {"id": 1, "alert_type": "contract_splitting", "title": "T", "description": "D", "entity_id": 4, "evidence": '{"vendor_name": "Acme", "agency_id": 3}'},
                  {"id": 2, "alert_type": "hub_vendor", "title": "H", "description": "Hub text", "evidence": "{}"})
    own = [{"vendor_id": 4, "agency_id": 3, "contract_number": f"N{i:02d}", "current_value": 46000 + i, "start_date": "2024-01-02"} for i in range(12)]
    others = [{**own[0], "contract_number": "N90", **x} for x in ({"agency_id": 2}, {"vendor_id": 5}, {"current_value": 44999}, {"start_date": "2020-01-01"})]
    c = splitting.alert_contracts(alert, table(spark, "contract", *own, *others), Params(as_of=DAY))
    got = {r["related_alert_id"]: r for r in requests.draft_requests(alert, c).collect()}
    assert got[1]["letter"] == "splitting" and got[1]["agency_id"] == 3 and got[1]["request_text"].count("  - N") == 12 and "Acme" in got[1]["request_text"]
    assert "N90" not in got[1]["request_text"] and requests.draft_requests(alert, c, 3).where("related_alert_id = 1").first()["request_text"].count("  - N") == 3
    assert got[2]["letter"] == "general" and "Hub text" in got[2]["request_text"]
    r = spark.createDataFrame([(1, "draft", None, None)], "id bigint, status string, submitted_date date, due_date date")
    sent = requests.submit(r, dt.date(2024, 5, 3))
    assert (sent.first()["status"], sent.first()["due_date"]) == ("pending", dt.date(2024, 5, 17))
    assert requests.mark_overdue(sent, dt.date(2024, 5, 17)).first()["status"] == "pending"
    assert requests.mark_overdue(sent, dt.date(2024, 5, 18)).first()["status"] == "overdue"
    v = table(spark, "vendor", {"id": 1, "name": "A"}, {"id": 2, "name": "B"})
    p = table(spark, "payment", {"vendor_id": 1, "amount": 5})
    assert [x["id"] for x in reports.vendors_page({"vendor": v, "payment": p}).collect()] == [2, 1]
    assert reports.show_vendor({"vendor": v}, "99999999999999999999x").count() == 0



def test_position_follows_rows(spark, tmp_path):
    write(tmp_path, "n.csv", "n\n" + "\n".join(str(i) for i in range(50)) + "\n")
    rows = readers.read_csv(spark, str(tmp_path)).orderBy("_pos").select(F.col("n").cast("int")).collect()
    assert [r[0] for r in rows] == list(range(50))


def test_plain_pages_read_as_the_parser_reads_them():
    bits = ["<table>", '<TABLE id="contracts-table">', '<table class="x dataTable">', "</table>", "<tr>", "</tr >", "<td>", '<td a="1" b="2">', "</td>", "<th>", "</th>", "<thead>", "</thead>",
            "<tbody\n>", "</tbody>", '<a href="/x">', '<a HREF="/y" href="/z">', "<a href='q'>", '<a href="a&amp;b">', "</a>", "<br/>", "text", " more ", "&lt;", "&amp", "a < b", "<!-- c <td> -->",
            '<script>if (a<b) x="<td>"</script>', "<title>", "</title>", "\0", "<", ">", "&", "</", "<b x>", '<td x = "1">', "</td foo>", '<p title="a>b">', "</table"]
    rng, plain = random.Random(4), 0
    for n in range(4000):
        page = "".join(rng.choice(bits[: 17 if n % 2 else None]) for _ in range(rng.randint(1, 20)))
        parser = html_tables._Tables()
        parser.feed(page)
        plain += html_tables._plain(page, html_tables._Tables())
        assert html_tables._tables(page) == parser.tables, page
    assert plain > 500
