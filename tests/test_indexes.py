"""Components folded batch by batch, and substring search by trigrams."""

import random

from pyspark.sql import functions as F

from spendwarden.operators import substring
from spendwarden.operators.components import connected_components, fold_edges


def test_folded_components_equal_a_new_run(spark):
    rng = random.Random(4)
    batches = [[(1, 2), (3, 4), (10, 11)], [(2, 3), (20, 20), (None, 5)], [(rng.randrange(60), rng.randrange(60)) for _ in range(12)], [(4, 11), (0, 1)], [],
               [(i, i + 1) for i in range(100, 130)], [(115, 1), (999, 998)]]
    labels, seen = spark.createDataFrame([], "node bigint, component bigint"), []
    for batch in batches:
        edges = spark.createDataFrame(batch, "src bigint, dst bigint")
        changed = {r["node"]: r["component"] for r in fold_edges(labels, edges).collect()}
        old = {r["node"]: r["component"] for r in labels.collect()}
        assert all(old.get(n) != c for n, c in changed.items())  # nothing that stays is touched
        seen += batch
        want = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(seen, "src bigint, dst bigint")).collect()}
        assert old | changed == want
        labels = spark.createDataFrame(list(want.items()), "node bigint, component bigint")


def test_only_merged_components_move(spark):
    labels = spark.createDataFrame([(n, n // 10 * 10) for n in range(1000)], "node bigint, component bigint")
    got = {(r["node"], r["component"]) for r in fold_edges(labels, spark.createDataFrame([(15, 27)], "src bigint, dst bigint")).collect()}
    assert got == {(n, 10) for n in range(20, 30)}


def test_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(5)
    words = ["Acme", "ACME", "widget", "Ring", "Straße", "İzmir", "50%", "a_b", "é", "of", "supply", "x\\y", "naïve"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 5)))) for i in range(400)] + [(900, None), (901, ""), (902, "ac"), (903, "a" * 5000 + "zebra")]
    df = spark.createDataFrame(rows, "id bigint, name string")
    path = str(tmp_path / "index")
    substring.write_index(df, "id", "name", path)
    for needle in ("acme", "WIDGET", "me wid", "zebra", "aaaa", "nowhere", "ac", "", "straße", "izmir", "İzmir", "50%", "a_b", "%", "ring%acme", "x\\\\y", "naïve of", "éé"):
        want = sorted(r["id"] for r in df.where(F.ilike("name", F.lit(f"%{needle}%"))).collect())
        assert sorted(r["id"] for r in substring.search(df, "id", "name", path, needle).collect()) == want, needle
    assert substring.candidates(spark, path, "zebra").count() == 1  # one row is looked at, not 404
    assert substring.candidates(spark, path, "ac") is None and substring.candidates(spark, path, "qqq").count() == 0


def test_index_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id bigint, name string")
    substring.write_index(df, "id", "name", str(tmp_path / "index"))
    for needle in ("acme", "a"):
        assert substring.search(df, "id", "name", str(tmp_path / "index"), needle).count() == 0
