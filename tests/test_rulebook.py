"""Rules added by a user: inputs, order, side by side, failures."""

import datetime as dt
import threading

import pytest
from helpers import table
from pyspark.sql import functions as F

from spendwarden.params import Params
from spendwarden.plans import engine
from spendwarden.plans.rulebook import Rulebook

P = Params(as_of=dt.date(2001, 7, 31))


def finding(kind):
    return lambda t, p: t["vendor"].select(F.lit(kind).alias("alert_type"), F.lit("low").alias("severity"), F.lit("vendor").alias("entity_type"), F.col("id").alias("entity_id"))


def test_a_user_rule_beside_the_others(spark):
    book = engine.BOOK.copy()
    made = []

    @book.shared("sunday", "payment")
    def _(t, p):
        made.append(1)
        assert set(t) == {"payment"}  # nothing but what was declared
        return t["payment"].where(F.dayofweek("payment_date") == 1)

    @book.rule("sunday_payments", "sunday vendor", before="duplicates")
    def _(t, p):
        per = t["sunday"].groupBy("vendor_id").agg(F.count("*").alias("payments")).where("payments > 1")
        return per.select(F.lit("sunday_payments").alias("alert_type"), F.lit("low").alias("severity"), F.lit("vendor").alias("entity_type"), F.col("vendor_id").alias("entity_id"), "payments")

    book.rule("sunday_again", "sunday", lambda t, p: [])
    assert "sunday_payments" not in engine.BOOK.steps and book.rules[:3] == ["contract_splitting", "sunday_payments", "duplicates"]
    days = ["2001-07-01", "2001-07-08", "2001-07-09"]
    t = {"vendor": table(spark, "vendor", {"id": 1}), "agency": table(spark, "agency"), "contract": table(spark, "contract"),
         "payment": table(spark, "payment", *[{"vendor_id": 1, "amount": 500, "payment_date": d} for d in days])}
    found, outcome = book.run(t, P, ["sunday_payments", "sunday_again", "contract_splitting"])
    assert [(r["alert_type"], r["entity_id"], r["rule_order"], r["evidence"]) for r in found.collect()] == [("sunday_payments", 1, 1, '{"payments":2}')]
    assert [(o["rule"], o["status"], o["findings"]) for o in outcome] == [("contract_splitting", "success", 0), ("sunday_payments", "success", 1), ("sunday_again", "success", 0)]
    assert made == [1]
    assert engine.run_rule("sunday_payments", t, P, book).count() == 1


def test_order_is_the_same_whatever_ends_first(spark):
    book = Rulebook()
    meet = threading.Barrier(3, timeout=60)  # passes only if all three run at once
    for name in "abc":
        def make(t, p, name=name):
            meet.wait()
            return finding(name)(t, p)

        book.rule(name, "vendor", make)
    t = {"vendor": table(spark, "vendor", {"id": 5})}
    found, outcome = book.run(t, P, at_once=3)
    assert sorted((r["rule_order"], r["alert_type"]) for r in found.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert [o["rule"] for o in outcome] == ["a", "b", "c"]
    alone = Rulebook()
    for name in "abc":
        alone.rule(name, "vendor", finding(name))
    assert sorted(map(tuple, alone.run(t, P, at_once=1)[0].collect())) == sorted(map(tuple, found.collect()))


def test_steps_come_after_what_they_need():
    book = Rulebook()
    book.rule("last", "z y table", lambda t, p: [])
    book.shared("y", "z", lambda t, p: None)
    book.shared("z", "table", lambda t, p: None)
    book.shared("unused", "table", lambda t, p: None)
    assert book.order() == ["z", "y", "last"]
    default = engine.BOOK.order()
    assert default == engine.BOOK.order() and all(default.index(n) < default.index(s) for s in default for n in engine.BOOK.steps[s].needs if n in default)
    assert engine.BOOK.order(["debarment"]) == ["debarment"]


def test_a_failing_step_stops_only_what_needs_it(spark):
    book = Rulebook()

    def broken(t, p):
        raise RuntimeError("x" * 2000)

    book.shared("bad", "vendor", broken)
    book.rule("one", "bad", finding("one"))
    book.rule("two", "vendor", finding("two"))
    book.rule("three", "vendor nowhere", finding("three"))
    book.rule("four", "vendor nowhere?", finding("four"))
    book.rule("five", "vendor", lambda t, p: t["payment"])
    t = {"vendor": table(spark, "vendor", {"id": 1}), "payment": table(spark, "payment")}
    found, outcome = book.run(t, P)
    assert [(o["rule"], o["status"]) for o in outcome] == [("one", "failed"), ("two", "success"), ("three", "failed"), ("four", "success"), ("five", "failed")]
    assert outcome[0]["error"] == "bad: " + "x" * 2000 and "nowhere" in outcome[2]["error"] and "payment" in outcome[4]["error"]
    assert {r["alert_type"] for r in found.collect()} == {"two", "four"}
    with pytest.raises(RuntimeError, match="bad"):
        engine.run_rule("one", t, P, book)
    assert Rulebook().run(t, P) == (None, [])


def test_wrong_books():
    book = Rulebook()
    book.shared("a", "b", lambda t, p: None)
    book.shared("b", "a", lambda t, p: None)
    book.rule("r", "a", lambda t, p: [])
    with pytest.raises(ValueError, match="need each other"):
        book.order()
    with pytest.raises(ValueError, match="already"):
        book.rule("a", "", lambda t, p: [])
    for wrong in (lambda: book.order(["a"]), lambda: book.rule("x", "", lambda t, p: [], before="nobody"), lambda: engine.run_rule("no-such-rule", {}, P)):
        with pytest.raises(ValueError, match="unknown rule"):
            wrong()


def test_pairs_of_names_are_listed_only_to_be_kept(spark, monkeypatch):
    """Rules meet similar names where they are found; the list of pairs is made for those who ask for shared results."""
    book = engine.BOOK
    assert "names" not in book.order() and "names" in book.order(keep=True)
    assert "names" in book.order(["network"], keep=True) and "names" not in book.order(["debarment"], keep=True)
    small = Rulebook()
    small.shared("listed", "vendor", lambda t, p: t["vendor"].select(F.raise_error(F.lit("no list")).alias("x")), beside="one")
    small.rule("one", "vendor", lambda t, p: t["vendor"].select(F.lit("a").alias("alert_type"), F.lit("low").alias("severity"), F.lit("vendor").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(None).alias("nothing")))
    small.rule("two", "vendor", lambda t, p: t["vendor"].select(F.lit("b").alias("alert_type"), F.lit("low").alias("severity"), F.lit("vendor").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(7).alias("n")))
    t = {"vendor": spark.range(3)}
    found, outcome = small.run(t, P)
    assert [(o["status"], o["findings"]) for o in outcome] == [("success", 3)] * 2
    assert {(r["alert_type"], r["evidence"], r["description"]) for r in found.collect()} == {("a", "{}", "a {}"), ("b", '{"n":7}', 'b {"n":7}')}
    shared = {}
    found, outcome = small.run(t, P, shared=shared)
    assert [o["status"] for o in outcome] == ["failed", "success"] and "no list" in outcome[0]["error"] and not shared
    assert {r["alert_type"] for r in found.collect()} == {"b"}
