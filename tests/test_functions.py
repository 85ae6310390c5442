import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendwarden.functions import addresses, names, scalars, similarity
from spendwarden.plans.reports import hub_category


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("ACME, INC.", "ACME INC"), ("The Widget Company LLC", "WIDGET CO LLC"), ("ABC CORP", "ABC CORP"), ("A&B", "B"), ("AT&T", "AT T"),
    ("The", "THE"), ("THE A", None), ("ACME SVCS.", "ACME SVCS"), ("ACME SVCS", "ACME SERVICES"), (None, None), ("", None),
    ("Int'l  Mgmt (Grp)", "INTERNATIONAL MANAGEMENT GRP"), ("Smith d/b/a Best\tCorporation", "SMITH DBA BEST CORP"), ("Señor & Co.", "SEÑOR CO"),
    ("L.L.C.X Works", "LLCX WORKS"), ("  Bank of the West ", "BANK WEST"),
])
def test_normalize_vendor_name(spark, raw, want):
    assert one(spark, names.normalize_vendor_name(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("ACME, INC.", "acme"), ("The Widget Company LLC", "widget"), ("ABC CORP", "abc")])
def test_plain_name(spark, raw, want):
    assert one(spark, names.normalize_vendor_name(F.lit(raw), strip_suffix=True, lower=True)) == want


def test_name_components_and_variants(spark):
    c = one(spark, names.name_components(F.lit("Joe Smith, Inc. dba Joe's Diner")))
    assert (c["base_name"], c["suffix"], c["dba_name"]) == ("JOE SMITH", "INC", "JOE'S DINER")
    assert set(one(spark, names.name_variants(F.lit("The Best Co")))) == {"BEST CO", "BEST", "BESTCO", "THE BEST CO"}
    assert one(spark, names.name_variants(F.lit(""))) == []


def test_addresses(spark):
    n = lambda *a: one(spark, addresses.normalize_address(*[F.lit(x).cast("string") for x in a]))
    assert n("100 North Main Street", "Austin", "Texas", "78701-1234")["normalized"] == "100 N MAIN ST AUSTIN TX 78701"
    assert n("P.O. Box 7", "Waco", None, None)["normalized"] == "PO BOX 7 WACO"
    full = n("12 OAK LANE, DALLAS TX 75201")
    assert (full["street"], full["city"], full["state"], full["zip_code"]) == ("12 OAK LN", "DALLAS", "TX", "75201")
    assert n(None, None, None, None)["normalized"] == ""
    assert n("1 A", "", "", "New")["zip_code"] == ""
    assert one(spark, addresses.red_flag_texts(F.lit("P.O. Box 5, Unit 0"))) == ["p.o. box", "unit 0"]


def test_match_addresses(spark):
    rows = [("12 Oak Lane", "12 oak ln", True), ("12 Oak Lane 75201", "12 Oak Lane 75202", False), ("12 Oak Lane", "13 Oak Lane", True),
            ("12 Oak Lane", "99 Elm Road", False), (None, "12 Oak", False), ("", "", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in similarity.match_addresses(df, "a", "b", "got").collect())


@pytest.mark.parametrize("day, state, federal", [("2023-08-31", 2023, 2023), ("2023-09-01", 2024, 2023), ("2023-10-01", 2024, 2024)])
def test_fiscal_years(spark, day, state, federal):
    d = F.lit(dt.date.fromisoformat(day))
    assert one(spark, scalars.state_fiscal_year(d)) == state
    assert one(spark, scalars.federal_fiscal_year(d)) == federal
    assert scalars.fiscal_year_of(dt.date.fromisoformat(day)) == state


def test_business_days_match_counting(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, 5, 10, 13):
        for r in df.select("d", scalars.add_business_days(F.col("d"), n).alias("x")).collect():
            day, left = r["d"], n
            while left:
                day += dt.timedelta(days=1)
                left -= day.weekday() < 5
            assert r["x"] == day


def test_money_dates_and_fallbacks(spark):
    assert str(one(spark, scalars.parse_money(F.lit("$1,234.50")))) == "1234.50"
    assert one(spark, scalars.parse_money(F.lit("n/a"))) is None
    fmts = ("yyyy-M-d'T'H:m:s", "yyyy-M-d", "M/d/yyyy")
    for text in ("2024-03-05T00:00:00.000", "2024-03-05", "3/5/2024"):
        assert one(spark, scalars.parse_date(F.lit(text), *fmts, cut=19)) == dt.date(2024, 3, 5)
    assert one(spark, scalars.parse_date(F.lit("soon"), *fmts)) is None
    assert one(spark, scalars.first_nonempty(F.lit(""), F.lit(" "), F.lit("x"))) == ""
    assert one(spark, scalars.initials_code(F.lit("Department of  Public Safety Office"))) == "DOPS"


@pytest.mark.parametrize("a, b, want", [("ACME INC", "ACME CORP", 70.588), ("KITTEN", "SITTING", 61.538), ("ABC", "ABC", 100), ("AB", "CD", 0),
                                        ("", "", 100), ("A" * 70, "A" * 69 + "B", 98.571)])
def test_ratio(spark, a, b, want):
    assert one(spark, similarity.ratio(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-3)


def test_hub_category(spark):
    for code, want in {"X": "Multiple Certs", None: "Unknown", "Black Female LLC": "Black American - Woman", "some veteran": "Disabled Vet",
                       "nonprofit": "Non-HUB", "ZZ": "ZZ"}.items():
        assert one(spark, hub_category(F.lit(code).cast("string"))) == want
