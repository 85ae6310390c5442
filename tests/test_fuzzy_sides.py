"""Which side of a join of names is repeated, and joins with few names."""

import datetime as dt

import pytest

from helpers import table

from spendwarden.functions.similarity import _lcs_one
from spendwarden.operators import fuzzy_join
from spendwarden.params import Params
from spendwarden.plans import employee_match

P = Params(as_of=dt.date(2001, 7, 31))


def _brute(left, right, cutoff):
    score = {(a, b): 200.0 * _lcs_one(a, b) / (len(a) + len(b)) for a in set(left) for b in set(right)}
    return {pair: round(s, 9) for pair, s in score.items() if s >= cutoff}


def _pairs(spark, left, right, cutoff, **how):
    l, r = (spark.createDataFrame([(x,) for x in names], f"{c} string") for names, c in ((left, "l"), (right, "r")))
    return {(x["left_name"], x["right_name"]): round(x["score"], 9) for x in fuzzy_join.fuzzy_pairs(l, "l", r, "r", cutoff, **how).collect()}


@pytest.mark.parametrize("turn", [False, True])
@pytest.mark.parametrize("cutoff", [60, 85])
def test_few_names_meet_all_without_keys(spark, monkeypatch, turn, cutoff):
    def refuse(*_):
        raise AssertionError("keys were made")

    many = [f"ACME WORKS {i} INC" for i in range(90)] + ["ACME", "A", "", None, "ÉCOLE 7"]
    few = ["ACME WORKS 17 INC", "ACME WORKS 8 INC", "ECOLE 7", None]
    left, right = (few, many) if turn else (many, few)
    want = _brute([x for x in left if x], [x for x in right if x], cutoff)
    monkeypatch.setattr(fuzzy_join, "_key_maker", refuse)
    monkeypatch.setattr(fuzzy_join, "_by_classes", refuse)
    assert _pairs(spark, left, right, cutoff, cell_rows=4) == want


def test_matches_of_one_vendor_are_those_of_all(spark):
    v = [{"id": i, "name": n, "name_normalized": n} for i, n in ((4, "ACME SUPPLY INC"), (2, "ACME SUPPLY INC"), (3, "ACME SUPPLIES INC"), (5, "OTHER LLC"), (6, None), (9, "ACME SUPPLY INC"))]
    e = [{"id": i, "name": n, "name_normalized": n} for i, n in ((1, "ACME SUPPLY INC"), (2, "ACME SUPPLY INCX"), (3, "OTHER LLC"), (4, None))]
    t = {"vendor": table(spark, "vendor", *v), "employee": table(spark, "employee", *e),
         "payment": table(spark, "payment", *[{"vendor_id": i, "amount": 10 * i} for i in (4, 3, 5, 9)])}
    whole = employee_match.name_matches(t, P).collect()
    for vendor in (2, 3, 4, 5, 6, 9, 77):  # 2 isn't paid, so 4 stands for the name
        assert sorted(employee_match.name_matches(t, P, vendor).collect()) == sorted(r for r in whole if r["vendor_id"] == vendor)
    assert {r["vendor_id"] for r in whole} == {4, 5}


@pytest.mark.parametrize("turn", [False, True])
@pytest.mark.parametrize("cutoff", [60, 90])
def test_the_side_that_makes_fewer_rows_is_repeated(spark, monkeypatch, turn, cutoff):
    many = [f"{w} {i} INC" for w in ("ACME WORKS", "ACME WORKSHOP", "BOLT") for i in range(60)]
    few = [f"{w} {i} INC" for w in ("ACME WORKS", "ACME WORK", "BOLT") for i in range(0, 60, 6)]
    left, right = (many, few) if turn else (few, many)
    met = []
    plain = fuzzy_join._in_cells

    def seen(lk, rk, *rest):
        met.append((lk.count(), rk.select("name").distinct().count()))
        return plain(lk, rk, *rest)

    monkeypatch.setattr(fuzzy_join, "_in_cells", seen)
    monkeypatch.setattr(fuzzy_join, "FEW_NAMES", 0)
    assert _pairs(spark, left, right, cutoff, cell_rows=8, class_names=1) == _brute(left, right, cutoff)
    assert len(met) == 2 and met[1][0] > met[1][1] and met[1][1] <= len(few)
