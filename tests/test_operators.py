import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendwarden.functions.similarity import _ratio_batch
from spendwarden.operators.components import connected_components
from spendwarden.operators.fuzzy_join import best_matches, fuzzy_join, fuzzy_pairs
from spendwarden.operators.tables import insert_absent, keep_best, upsert


def brute(left, right, cutoff):
    out = {}
    for a in left:
        scores = _ratio_batch(pd.Series([a] * len(right)), pd.Series(right))
        out.update({(a, b): s for b, s in zip(right, scores) if s >= cutoff})
    return out


def some_names(seed, n, letters, longest):
    r = random.Random(seed)
    out = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(n)}
    for s in list(out)[: n // 2]:  # near copies
        i = r.randrange(len(s) + 1)
        out.add(s[:i] + r.choice(letters) + s[i + r.randint(0, 1):])
    return sorted(out)


@pytest.mark.parametrize("cutoff, grams, cell_rows, letters, longest", [
    (90, 1, 4096, "ABCD ", 30), (85, 1, 5, "ABC", 16), (80, 2, 7, "ABCDEF", 24), (85, 3, 4096, "ABCDEé ", 40), (75, 2, 4096, "AB", 12)])
def test_self_pairs_equal_brute_force(spark, cutoff, grams, cell_rows, letters, longest):
    names = some_names(cutoff + grams, 120, letters, longest)
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r[0], r[1]): r[2] for r in fuzzy_pairs(df, "n", df, "n", cutoff, grams, cell_rows).collect()}
    assert got == pytest.approx(brute(names, names, cutoff))


@pytest.mark.parametrize("cutoff, grams, cell_rows", [(90, 1, 4096), (85, 2, 6), (80, 1, 5)])
def test_two_sided_pairs_equal_brute_force(spark, cutoff, grams, cell_rows):
    left, right = some_names(1, 90, "ABCDE ", 22), some_names(2, 70, "ABCDE ", 22)
    right += left[:10]
    l, r = spark.createDataFrame([(n,) for n in left], "a string"), spark.createDataFrame([(n,) for n in right], "b string")
    got = {(x[0], x[1]): x[2] for x in fuzzy_pairs(l, "a", r, "b", cutoff, grams, cell_rows).collect()}
    assert got == pytest.approx(brute(left, sorted(set(right)), cutoff))


def test_a_key_shared_by_most_names_is_spread_and_exact(spark):
    names = [f"ACME WORKS {i:04d} INC" for i in range(300)] + ["ZEBRA HALL", "ZEBRA HALLS"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = set(brute(names, names, 90))
    for crowd_cells in (1, 4, 64):
        assert {(r[0], r[1]) for r in fuzzy_pairs(df, "n", df, "n", 90, 1, 16, crowd_cells).collect()} == want
    other = spark.createDataFrame([(n,) for n in names[::7]], "m string")
    got = {(r[0], r[1]) for r in fuzzy_pairs(df, "n", other, "m", 85, 1, 8, 2).collect()}
    assert got == set(brute(names, names[::7], 85))


def test_join_kinds_and_top_k(spark):
    l = spark.createDataFrame([(1, "ACME SUPPLY INC"), (2, "NOBODY HERE"), (3, "ACME SUPPLY INC")], "lid int, a string")
    r = spark.createDataFrame([(10, "ACME SUPPLY INC"), (11, "ACME SUPPLY INC."), (12, "ACME SUPPLYS INC"), (13, "")], "rid int, b string")
    pairs = {(x["lid"], x["rid"]) for x in fuzzy_join(l, "a", r, "b", 90).collect()}
    assert pairs == {(i, j) for i in (1, 3) for j in (10, 11, 12)}
    assert [x["lid"] for x in fuzzy_join(l, "a", r, "b", 90, how="anti").collect()] == [2]
    assert {x["lid"] for x in fuzzy_join(l, "a", r, "b", 90, how="semi").collect()} == {1, 3}
    best = best_matches(fuzzy_pairs(l, "a", r, "b", 90), 2).collect()
    assert sorted(x["right_name"] for x in best) == ["ACME SUPPLY INC", "ACME SUPPLY INC."]


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in up}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 5), (1, 2), (2, 1), (7, 9)],
    [(random.Random(3).randrange(200) + 0 * i, i) for i in range(5)], [((i * 37) % 150, (i * 91 + 4) % 150) for i in range(110)]])
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == components(edges)


def test_upsert_insert_and_keep_best(spark):
    old = spark.createDataFrame([("a", 1, "x", "first"), ("b", 2, None, "first")], "k string, v int, w string, s string")
    new = spark.createDataFrame([("a", 5, None, "later", 1), ("a", 6, None, "later", 2), ("c", 7, "y", "later", 3), (None, 8, "z", "later", 4)], "k string, v int, w string, s string, _pos int")
    got = {r["k"]: (r["v"], r["w"], r["s"]) for r in upsert(old, new, ["k"], F.col("_pos"), keep_if_null=("w",), keep_always=("s",)).collect()}
    assert got == {"a": (6, "x", "first"), "b": (2, None, "first"), "c": (7, "y", "later"), None: (8, "z", "later")}
    put = {r["k"]: r["v"] for r in insert_absent(old, new.drop("s"), ["k"], F.col("_pos")).collect()}
    assert put == {"a": 1, "b": 2, "c": 7, None: 8}
    rel = spark.createDataFrame([(1, 2, 0.8, "old"), (1, 3, 0.7, "old")], "a int, b int, c double, e string")
    add = spark.createDataFrame([(1, 2, 0.8, "new"), (1, 3, 0.9, "new"), (4, 5, 0.1, "new")], "a int, b int, c double, e string")
    once = keep_best(rel, add, ["a", "b"], "c")
    want = {(1, 2): (0.8, "old"), (1, 3): (0.9, "new"), (4, 5): (0.1, "new")}
    assert {(r["a"], r["b"]): (r["c"], r["e"]) for r in once.collect()} == want
    assert {(r["a"], r["b"]): (r["c"], r["e"]) for r in keep_best(once, add, ["a", "b"], "c").collect()} == want


@pytest.mark.parametrize("cutoff", [40, 50, 60, 67, 70, 74])
def test_low_cutoffs_equal_brute_force(spark, cutoff, monkeypatch):
    from spendwarden.operators import fuzzy_join as module

    monkeypatch.setattr(module, "CELL_ROWS", 40)
    rng = random.Random(cutoff)
    words = ["ACME", "SUPPLY", "CO", "INC", "BUILDERS", "AB", "BA", "A", "OF", "TEXAS", "ÉLAN", "AAAA", "ROADS", "DOORS"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4)))[: rng.randrange(1, 22)].strip() or "X" for _ in range(160)})
    left, right = names[::2] + names[:20], names[1::2] + names[10:30]
    l, r = spark.createDataFrame([(n,) for n in left], "a string"), spark.createDataFrame([(n,) for n in right], "b string")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    score = lambda a, b: 200.0 * lcs(a, b) / (len(a) + len(b))
    want = {(a, b) for a in left for b in right if score(a, b) >= cutoff}
    got = [(x["left_name"], x["right_name"]) for x in module.fuzzy_pairs(l, "a", r, "b", cutoff, cell_rows=40).collect()]
    assert set(got) == want and len(got) == len(set(got))
    if cutoff == 70:
        same = {(x["left_name"], x["right_name"]) for x in module.fuzzy_pairs(l, "a", l, "a", cutoff, cell_rows=40).collect()}
        assert same == {(a, b) for a in left for b in left if score(a, b) >= cutoff}


def test_a_cutoff_of_nothing_is_refused(spark):
    df = spark.createDataFrame([("A",)], "a string")
    with pytest.raises(ValueError, match="matches everything"):
        fuzzy_pairs(df, "a", df, "a", 0)


def _numbered(seed, n):
    rng = random.Random(seed)
    words = ["HOT BOLT", "HOT GEAR", "OLD BOLT", "COLD GEAR", "É"]
    return sorted({f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(10 ** rng.randrange(1, 7))}{rng.choice([' INC', 'S INC', '', ' 7'])}" for _ in range(n)} | {"12", "123", "1234"})


@pytest.mark.parametrize("cutoff, cell_rows", [(90, 30), (80, 8), (60, 200)])
def test_classes_of_numbered_names_equal_brute_force(spark, cutoff, cell_rows):
    from spendwarden.operators import fuzzy_join as module

    left, right = _numbered(cutoff, 300), _numbered(cutoff + 1, 200)
    l, r = spark.createDataFrame([(n,) for n in left], "a string"), spark.createDataFrame([(n,) for n in right], "b string")
    for a, b, x, y in ((l, "a", left, left), (l, "a", left, right)):
        other = (l, "a") if y is left else (r, "b")
        got = [(p["left_name"], p["right_name"], p["score"]) for p in module.fuzzy_pairs(a, b, *other, cutoff, cell_rows=cell_rows, class_names=1).collect()]
        assert len(got) == len({g[:2] for g in got})
        assert {g[:2]: g[2] for g in got} == pytest.approx(brute(x, y, cutoff))
        names = a.select("a").toDF("name")
        rows = module._by_classes(names, names, 300, cutoff, cell_rows, 1, lambda: 0)
        assert rows is not None


def test_a_pair_of_numbered_names_is_made_once(spark, monkeypatch):
    from spendwarden.operators import fuzzy_join as module

    df = spark.createDataFrame([(f"ACME WORKS {i:04d} INC",) for i in range(200)], "n string")
    monkeypatch.setattr(module, "_by_keys", lambda *a: pytest.fail("keys that nearly all names have"))
    names = [f"ACME WORKS {i:04d} INC" for i in range(200)]
    assert {(r[0], r[1]) for r in fuzzy_pairs(df, "n", df, "n", 90, cell_rows=50).collect()} == set(brute(names, names, 90))


@pytest.mark.parametrize("remembered", [1 << 18, 3])
def test_thinned_edges_join_the_same_nodes(spark, monkeypatch, remembered):
    from spendwarden.operators import components as module

    monkeypatch.setattr(module, "FOREST_NODES", remembered)
    rng = random.Random(5)
    edges = [(f"N{rng.randrange(40)}", f"N{rng.randrange(40)}") for _ in range(30)] + [(f"A{i}", f"A{j}") for i in range(20) for j in range(i)]
    edges = [(a, b) for a, b in edges if a != b]
    got = [tuple(r) for r in module.thinned(spark.createDataFrame(edges, "src string, dst string").coalesce(1)).collect()]
    assert set(got) <= set(edges) and components(got) == components(edges)
    if remembered > 3:
        assert len(got) == len(components(edges)) - len(set(components(edges).values()))
