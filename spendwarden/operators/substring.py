"""Substring search by an index of trigrams: the rarest trigrams of the needle name the rows to look at."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # folders of the posting table
LOOK_UP = 3  # trigrams of a needle that are looked up


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the text in lower case; none of a shorter text."""
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(df: DataFrame, key: str, text: str, path: str) -> None:
    """Posting rows (gram, key) in folders by gram, sorted so that a look-up reads few row groups, and how many each gram has."""
    rows = df.select(F.col(key).alias("key"), F.explode(trigrams(F.col(text))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    found = _postings(df.sparkSession, path, df.schema[key].dataType.simpleString())
    found.groupBy("gram").agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def _postings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"key {kind}, gram string, bucket int").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, needle: str, kind: str = "bigint") -> DataFrame | None:
    """(key) of rows that may hold the needle; None where it has no trigram without a wildcard, so all rows may."""
    pieces = [p for p in re.split(r"[%_\\]", needle.lower()) if len(p) >= 3]
    grams = sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})
    if not grams:
        return None
    known = spark.read.schema("gram string, n bigint").parquet(f"{path}/grams").where(F.col("gram").isin(grams)).collect()  # as many as the needle has letters at most
    if len(known) < len(grams):
        return spark.createDataFrame([], f"key {kind}")
    rare = [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:LOOK_UP]]
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in rare], "gram string").select(_bucket(F.col("gram"))).collect()]
    hits = _postings(spark, path, kind).where(F.col("bucket").isin(folders) & F.col("gram").isin(rare))
    return hits.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")


def search(df: DataFrame, key: str, text: str, path: str, needle: str) -> DataFrame:
    """Rows of df whose text holds the needle, whatever the case, as a scan with ilike finds them; df must be what was indexed."""
    near = candidates(df.sparkSession, path, needle, df.schema[key].dataType.simpleString())
    rows = df if near is None else df.join(near.withColumnRenamed("key", key), key, "left_semi")
    return rows.where(F.ilike(text, F.lit(f"%{needle}%")))
