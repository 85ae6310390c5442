"""Mixing sources to target weights with DataFrame functions only.

Sizes (words) are summed per source, each source gets a target by its weight, and every document of a source is taken
floor(target / size of the source) times plus once more with the remaining probability, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

WORD = r"[^\x20\x09-\x0D]+"
SMALL = 100_000  # sources up to which their table is broadcast


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source of sizes(source, size): source, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    cap times its source's size; what is above is shared again by weight until no target is above. The order comes from
    a range partitioning with counts per partition, so there may be any number of sources.
    """
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    parts = 1 + per.count() // SMALL
    ranged = written(per.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources-ranged")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.expr("sum(n) over (order by part)") - F.col("n")).alias("before"))  # a row per partition
    place = F.col("before") + F.expr("row_number() over (partition by part order by source nulls last)") - 1
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    s = written(ranged.join(F.broadcast(before), "part").withColumn("place", place).select("source", "source_size", pick.cast("long").alias("weight")), "weights")

    top = F.col("source_size") * cap
    total, weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    left, share = total or 0, weight or 0

    def above(left: int, share: int) -> Column:
        big = "decimal(19,0)"
        return F.col("weight").cast(big) * F.lit(left).cast(big) > top.cast(big) * F.lit(share).cast(big)

    while share:
        full, free = s.agg(F.sum(F.when(above(left, share), top)), F.sum(F.when(~above(left, share), F.col("weight")))).first()
        now = ((total or 0) - (full or 0), free or 0)
        if now == (left, share) or not now[1]:
            break
        left, share = now
    target = F.when(above(left, share), top.cast("double")).otherwise((F.col("weight") * F.lit(left)).cast("double") / F.lit(float(share or 1)))
    return s.withColumn("target", target)


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows joined with their source's figures; broadcast where the sources are known to be few."""
    t = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if targets.count() <= SMALL:
        t = F.broadcast(t)
    return rows.join(t, rows["source"].eqNullSafe(t["_source"]), "left").drop("_source")


def copies(doc_id: Column, source_size: Column, target: Column, cap: int = 3, seed: str = "mix") -> Column:
    """How often a document is taken: floor(rate), and once more if its hash falls below the rest of the rate."""
    rate = F.coalesce(F.least(F.try_divide(target, source_size.cast("double")), F.lit(float(cap))), F.lit(0.0))
    toss = F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return F.floor(rate) + F.when(toss < rate - F.floor(rate), 1).otherwise(0)


def counted(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, keep_text: bool = False) -> DataFrame:
    """doc_id, source, _size (or with keep_text the whole row as _row), _source_size, _target and _copies of every row.

    Null texts have no words, a null source is a source of its own, rows of one id are all taken equally often and
    rows without id share one toss. An empty table gives an empty table. Other columns, whatever their names, stay in _row.
    """
    size = word_count(F.col("text")).alias("_size")
    light = written(docs.select("doc_id", "source", size), "sizes")
    targets = source_targets(light.select("source", F.col("_size").alias("size")), weights, cap)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), "doc_id", "source") if keep_text else light
    return with_targets(rows, targets).withColumn("_copies", copies(F.col("doc_id"), F.col("_source_size"), F.col("_target"), cap))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mixed corpus: each document of docs as often as it is taken, with the columns of docs."""
    return counted(docs, weights, cap, keep_text=True).withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(_copies as int))"))).select("_row.*")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document) of every row."""
    return counted(docs, weights, cap).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"))
