"""Bounded, repeatable samples of labelled rows for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 5  # every fifth document by its checksum is never learned from


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves no remainder by HELD_OUT; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def sample_ids(rows: DataFrame, label: str, per_label: int) -> list[tuple]:
    """At most per_label (doc_id, label) of each label, those with the smallest hashes; rows without id or label take no part.

    The labels are counted first, and a threshold on the hash lets only about one and a half times as many rows reach the driver.
    """
    known = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    span = 1 << 40
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(span))
    limit = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(span, int(span * (1.5 * per_label + 50) / n)))])
    near = known.withColumn("place", place).where(F.col("place") < F.element_at(limit, F.col("label"))).distinct().collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(near, key=lambda r: (r["place"], r["doc_id"], r["label"])):
        if taken[r["label"]] < per_label:
            taken[r["label"]] += 1
            out.append((r["doc_id"], r["label"]))
    return out


def texts_of(docs: DataFrame, ids: list[tuple]) -> list[tuple]:
    """(doc_id, label, text) of sampled ids in order of id and label; null texts are left out, of repeated ids the least text counts."""
    if not ids:
        return []
    kind = docs.schema["doc_id"].dataType.simpleString()
    label = {int: "bigint", str: "string"}[type(ids[0][1])]
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, f"doc_id {kind}, label {label}"))  # as many rows as the sample may have
    rows = docs.where("text is not null").select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r["doc_id"], r["label"], r["text"]) for r in rows)
