"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters.

Every window of WINDOW bytes has an entropy, that of second order, which depends on the number of equal pairs of bytes in it.
A count over all texts says how rare each entropy is. Of the windows near one another the rarest is a feature; features go
in order into Bloom filters, a new one whenever the last is full. Two digests are compared by the overlap of their
filters' bits, less what chance would give, relative to the most that is possible.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import flat, mix, slices

WINDOW = 32
NEAR = 64  # a feature is the rarest of the windows that begin within about so many bytes
FULL = 128  # features of a filter
BITS = 2048  # of a filter
PROBES = 4
PAIRS = WINDOW * (WINDOW - 1) // 2
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """Equal pairs of bytes in the window that begins at each byte; exact, by one comparison for each distance."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int32)
    for lag in range(1, WINDOW):
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(data[:-lag] == data[lag:], dtype=np.int32)])
        out += total[WINDOW - lag :][:n] - total[:n]
    return out


def _window_hash(data: np.ndarray) -> np.ndarray:
    n = len(data) - WINDOW + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data)), dtype=np.uint64)])
    return mix((total[WINDOW:] - total[:-WINDOW]) * _power(_INVERSE, n))


def _lowest_near(rank: np.ndarray) -> np.ndarray:
    """Places whose rank is the lowest of those up to NEAR // 2 away; a repeated window counts wherever it is."""
    half = NEAR // 2
    least = np.concatenate([np.full(half, rank.max(), rank.dtype), rank, np.full(half, rank.max(), rank.dtype)])
    width = 1
    while width < NEAR:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.flatnonzero(rank == np.minimum(least[: len(rank)], rank))


def digests(data: np.ndarray, at: np.ndarray, rarity: np.ndarray) -> list[np.ndarray]:
    """Filters of each text, of shape (filters, BITS // 8); none for an empty text.

    rarity ranks the numbers of equal pairs, 0 for the rarest. A text shorter than a window is one feature itself.
    """
    texts, hashes = [], []
    if len(data) >= WINDOW:
        value = _window_hash(data)
        order = (rarity[equal_pairs(data)].astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16))
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= WINDOW:
            spot = _lowest_near(order[a : b - WINDOW + 1])
            own = value[a:][spot]
        elif b > a:
            own = np.frombuffer(hashlib.sha256(data[a:b].tobytes()).digest()[:8], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        own = own[np.sort(np.unique(own, return_index=True)[1])]
        texts.append(-(-len(own) // FULL))
        hashes.append(own)
    first = np.concatenate([[0], np.cumsum(texts)]).astype(np.int64)
    flags = np.zeros(int(first[-1]) * BITS, bool)
    if len(flags):
        own = np.concatenate(hashes)
        size = np.array([len(h) for h in hashes])
        nth = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        filter_ = np.repeat(first[:-1], size) + nth // FULL
        for k in range(PROBES):
            flags[filter_ * BITS + ((own >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = True
    packed = np.packbits(flags).reshape(-1, BITS // 8)
    return [packed[first[i] : first[i + 1]] for i in range(len(at) - 1)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how well the filters of the shorter digest are found in the other, weighted by their bits; 1 for two empty ones."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if np.array_equal(a, b):
        return 1.0
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(1), y.sum(1)
    chance = nx[:, None] * ny / BITS
    most = np.minimum(nx[:, None], ny)
    score = np.where(most > chance, (x @ y.T - chance) / np.maximum(most - chance, 1e-9), 0).max(1)
    return float(round(float(np.clip((np.clip(score, 0, 1) * nx).sum() / nx.sum(), 0, 1)), 6))


def _text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def rarities(docs: DataFrame) -> np.ndarray:
    """Rank of each number of equal pairs by how often it occurs in the windows of all texts; PAIRS + 1 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(PAIRS + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                data, at = flat(part.column(0))
                pairs = equal_pairs(data)
                whole = np.ones(len(pairs), bool)
                for end in at[1:-1]:
                    whole[max(end - WINDOW + 1, 0) : end] = False  # windows that cross a border of texts
                count += np.bincount(pairs[whole], minlength=PAIRS + 1)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], names=["pairs", "n"])

    total = np.zeros(PAIRS + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "pairs bigint, n bigint").groupBy("pairs").agg(F.sum("n").alias("n")).collect():
        total[r["pairs"]] = r["n"]
    rank = np.empty(PAIRS + 1, np.int64)
    rank[np.lexsort((np.arange(PAIRS + 1), total))] = np.arange(PAIRS + 1)
    return rank


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, tail, doc_id, text), sorted by descending id within buckets that lie whole in partitions; after each
    bucket's rows a tail row repeats the first row of the next one. Null texts are empty; rows without id come last; rows of one id go by text.

    Only the cuts between buckets and one id per bucket reach the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(below))
    heads = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(heads, reverse=True)
    asks = [(order[i - 1], heads[b], b) for i, b in enumerate(order)]  # the bucket before asks for this one's first row; the last asks for the first
    if not asks:
        return rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "text")
    wanted = F.broadcast(spark.createDataFrame(asks, "asker int, top bigint, b int"))  # a row per bucket
    tails = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("top")) & (F.col("bucket") == F.col("b"))).groupBy("asker", "top").agg(F.min("text").alias("text"))
    both = rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails.select(F.col("asker").alias("bucket"), F.lit(1).alias("tail"), F.col("top").alias("doc_id"), "text"))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last half replaced by the beginning of the next document's text, in descending order of id.
    An empty text has an empty fingerprint; equal texts have equal ones. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarities(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        held = None  # bucket, id, text, filters of the row that waits for its next one
        for batch in batches:
            for part in slices(batch):
                bucket, tail, ids, texts = (c.to_pylist() for c in part.columns)
                own = digests(*flat(part.column(3)), rarity)
                chain = ([held] if held else []) + list(zip(bucket, tail, ids, texts, own, strict=True))
                pairs = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if a[0] == b[0] and not a[1]]
                held = chain[-1]
                if not pairs:
                    continue
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                other = digests(*flat(pa.array(edited, pa.large_string())), rarity)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([_text(a[4]) for a, _ in pairs]), pa.array([_text(o) for o in other]),
                    pa.array([likeness(a[4], o) for (a, _), o in zip(pairs, other, strict=True)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64())],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _with_next(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
