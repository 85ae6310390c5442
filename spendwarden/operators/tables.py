"""Keyed table maintenance: insert-if-absent, upsert, first or last row per key, in memory of a plan or in stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PARTITION_BY, conform, placed, schema_of, store
from ..session import cut


def pick_per_key(df: DataFrame, keys: list[str], order, last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by order; null keys are ordinary keys.

    Each task keeps one row per key before the shuffle, so hot keys shrink there.
    """
    by = Window.partitionBy(*keys).orderBy(order.desc() if last else order.asc())
    return df.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order) -> DataFrame:
    """existing plus the first incoming row of each new key."""
    first = pick_per_key(incoming, keys, order)
    cond = [first[k].eqNullSafe(existing[k]) for k in keys]
    fresh = first.join(existing, cond, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order, keep_if_null: tuple = (),
           keep_always: tuple = ()) -> DataFrame:
    """Last incoming row per key replaces the existing one.

    keep_if_null: columns that keep the old value where the new one is null.
    keep_always: columns the first writer sets for good.
    """
    last = pick_per_key(incoming, keys, order, last=True).alias("n")
    old = existing.alias("o")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.withColumn("_old", F.lit(True)).alias("o").join(last.withColumn("_new", F.lit(True)).alias("n"), cond, "full_outer")

    def value(c: str):
        if c not in incoming.columns:
            return F.col(f"o.{c}")
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_always:
            return F.coalesce(o, n)
        if c in keep_if_null:
            return F.when(F.col("n._new"), F.coalesce(n, o)).otherwise(o)
        return F.when(F.col("n._new"), n).otherwise(o)

    return both.select(*[value(c).alias(c) for c in existing.columns])


def ordered_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """The same rows with the smaller id in column a."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def keep_best(existing: DataFrame, incoming: DataFrame, keys: list[str], score: str) -> DataFrame:
    """One row per key, the one with the highest score; on equal scores the existing one. Running twice changes nothing."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.select(*existing.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in (*keys, score)]
    best = both.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("_score"), (-F.col("_new")).alias("_old"), *rest)).alias("_row"))  # carries no column twice
    return best.select(*[F.col(c) if c in keys else F.col("_row._score" if c == score else f"_row.{c}").alias(c) for c in existing.columns])


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The stored table with its partition column; empty if it was never written."""
    schema = schema_of(name) if name in PARTITION_BY else schema_of(name).add("_part", "integer")
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _same(keys: Sequence[str]) -> Column:
    """Equality of the keys of two sides, the second one's named _o_key; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return out


def _keys_of(old: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [old[k].alias(f"_o_{k}") for k in keys]


def _with_own_ids(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """fresh with ids hashed once more where another row, stored or new, has the same id for another key."""
    taken = old.select(F.col("id").alias("_o_id")).distinct()
    for again in range(1, 9):
        by = Window.partitionBy("id").orderBy(*[c for c in fresh.columns if c != "id" and not c.startswith("_")])
        marked = fresh.withColumn("_place", F.row_number().over(by)).join(taken, _same(["id"]), "left")
        clash = (F.col("_place") > 1) | F.col("_o_id").isNotNull()
        if marked.where(clash).isEmpty():
            return fresh
        other = F.xxhash64("id", "_place", F.lit(again)).bitwiseAND(F.lit((1 << 63) - 1))
        fresh = cut(marked.withColumn("id", F.when(clash, other).otherwise(F.col("id"))).select(*fresh.columns))
    raise RuntimeError("ids clash again and again")


def insert_into(spark: SparkSession, root: str, name: str, incoming: DataFrame, keys: Sequence[str], order: Column) -> int:
    """Add the first incoming row of each key that the stored table lacks; returns how many. No stored file is touched.

    Rows are known by their keys, never by their hashed id; an id that is taken by another key is hashed again.
    """
    old = stored(spark, root, name)
    first = pick_per_key(incoming, list(keys), order)
    fresh = cut(conform(first.join(old.select(*_keys_of(old, keys)), _same(keys), "left_anti"), name))
    if "id" in fresh.columns:
        fresh = _with_own_ids(fresh, old)
    n = fresh.count()
    if n:
        store(placed(fresh, name), name, f"{root}/{name}", "append")
    return n


def update_in(spark: SparkSession, root: str, name: str, incoming: DataFrame, keys: Sequence[str], order: Column, keep_if_null: Sequence[str] = (),
              keep_always: Sequence[str] = (), only_known: bool = False, score: str | None = None) -> int:
    """The last incoming row of each key replaces the stored one; returns how many rows are new or changed.

    Columns that incoming lacks stay. keep_if_null: the old value stays where the new one is null. keep_always: the first
    value stays for good. only_known: keys that aren't stored are left out. score: a stored row stays unless the new one's
    score is higher. Only partitions that hold a changed row are written anew; without changes nothing is written.
    """
    if name in PARTITION_BY:
        raise ValueError(f"{name} is not stored by key")
    columns = schema_of(name).names
    old = stored(spark, root, name)
    last = pick_per_key(incoming, list(keys), order, last=True)
    kinds = {f.name: f.dataType for f in schema_of(name).fields}
    side = old.select(*_keys_of(old, keys), F.struct(*[old[c] for c in columns]).alias("_old"), F.col("_part").alias("_at"))
    both = last.join(side, _same(keys), "left")

    def value(c: str) -> Column:
        before = F.col(f"_old.{c}")
        if c not in incoming.columns:
            return before
        new = F.col(c).cast(kinds[c])
        return F.coalesce(before, new) if c in keep_always else F.coalesce(new, before) if c in keep_if_null else new

    row = F.struct(*[value(c).alias(c) for c in columns])
    known = F.col("_at").isNotNull()
    both = both.where(known) if only_known else both
    if score:
        both = both.where(~known | (F.col(score).cast(kinds[score]) > F.col(f"_old.{score}")))
    changed = cut(placed(both.where(~known | ~row.eqNullSafe(F.col("_old"))).select(row.alias("_new"), "_at").select("_new.*", "_at"), name).withColumn(
        "_part", F.coalesce("_at", "_part")).drop("_at"))
    touched = [r["_part"] for r in changed.select("_part").distinct().collect()]  # at most as many as the table has partitions
    if touched:
        stay = old.where(F.col("_part").isin(touched)).join(changed.select(*_keys_of(changed, keys)), _same(keys), "left_anti")
        store(stay.unionByName(changed), name, f"{root}/{name}", "overwrite")
    return changed.count()
