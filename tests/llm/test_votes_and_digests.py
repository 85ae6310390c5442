"""Votes of neighbours and digests of rare windows against plain loops; the pipeline on odd and empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spendwarden.llm import quality_knn, rare_digest


# votes

def test_votes_equal_plain_loops(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_knn.voters(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["", "a", "?!"]
    got = model.score(pa.array(texts, pa.large_string()))
    for t, s in zip(texts, got, strict=True):
        x = quality_knn.terms(pa.array([t], pa.large_string()))[0]
        v = [sum(float(a) * float(b) for a, b in zip(x * model.idf, model.axes[:, k], strict=True)) for k in range(model.axes.shape[1])]
        length = max(math.sqrt(sum(a * a for a in v)), 1e-12)
        near = sorted(((sum(a / length * float(b) for a, b in zip(v, w, strict=True)), y) for w, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        k = quality_knn.NEIGHBOURS
        if near[k - 1][0] - near[k][0] < 1e-9:  # of equally near ones any may vote
            continue
        votes = [(max(c, 0) ** quality_knn.SHARPNESS, y) for c, y in near[: quality_knn.NEIGHBOURS]]
        total = sum(w for w, _ in votes)
        want = sum(w * y for w, y in votes) / total if total > 0 else 0
        assert s == pytest.approx(want, abs=2e-3), t[:40]


def test_words_are_in_the_space():
    one, other, same = (quality_knn.terms(pa.array([t]))[0] for t in ("the river was old and wide", "xkj qwpzm bvt rlk fhg zxcv", "The river was old and WIDE"))
    words = slice(quality_knn.SLOTS + quality_knn.REPEATS, None)
    assert not np.allclose(one[words], other[words]) and np.allclose(one[words], same[words]) and one[words].sum() > 0
    assert quality_knn.terms(pa.array([None, ""], pa.string())).sum() == 0


def test_quality_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x y z"), (4, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id bigint, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (99, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_knn.quality_report(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 6 and all(0 <= r["score"] <= 1 for r in got.collect())
    assert {r["score"] for r in quality_knn.quality_report(docs, labels.limit(0)).collect()} == {0.0}
    assert quality_knn.quality_report(docs.limit(0), labels).count() == 0


# digests

def pairs_in(window: bytes) -> int:
    return sum(n * (n - 1) // 2 for n in Counter(window).values())


def test_pairs_and_ranks_equal_plain_loops(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdeé \n", k=rng.randrange(0, 400))) for _ in range(30)] + [None, "", "x" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    count = Counter()
    for t in texts:
        b = (t or "").encode()
        found = [pairs_in(b[i : i + rare_digest.WINDOW]) for i in range(len(b) - rare_digest.WINDOW + 1)]
        assert rare_digest.equal_pairs(np.frombuffer(b, np.uint8)).tolist() == found
        count.update(found)
    order = sorted(range(rare_digest.PAIRS + 1), key=lambda p: (count[p], p))
    want = np.empty(len(order), int)
    want[order] = range(len(order))
    assert rare_digest.rarities(docs).tolist() == want.tolist()


def brute_digest(b: bytes, rarity, hash_of) -> list[set[int]]:
    """Bits of each filter: of windows up to NEAR / 2 apart the rarest, by first occurrence, so many to a filter."""
    w, half = rare_digest.WINDOW, rare_digest.NEAR // 2
    if not b:
        return []
    if len(b) < w:
        own = [int.from_bytes(hashlib.sha256(b).digest()[:8], "little")]
    else:
        value = [hash_of(b[i : i + w]) for i in range(len(b) - w + 1)]
        rank = [(int(rarity[pairs_in(b[i : i + w])]), v >> 16) for i, v in enumerate(value)]
        spots = [i for i in range(len(rank)) if rank[i] == min(rank[max(i - half, 0) : i + half])]  # half before, half less one after
        own = list(dict.fromkeys(value[i] for i in spots))
    filters = []
    for n, h in enumerate(own):
        if n % rare_digest.FULL == 0:
            filters.append(set())
        filters[-1] |= {(h >> (11 * k)) % rare_digest.BITS for k in range(rare_digest.PROBES)}
    return filters


def bits(filters: np.ndarray) -> list[set[int]]:
    return [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in filters]


def brute_likeness(a: list[set[int]], b: list[set[int]]) -> float:
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if a == b:
        return 1.0
    score = total = 0
    for x in a:
        best = 0.0
        for y in b:
            chance, most = len(x) * len(y) / rare_digest.BITS, min(len(x), len(y))
            best = max(best, (len(x & y) - chance) / (most - chance) if most > chance else 0)
        score += min(best, 1) * len(x)
        total += len(x)
    return round(min(max(score / total, 0), 1), 6)


def test_digests_equal_plain_loops():
    rng = random.Random(2)
    rarity = np.array(rng.sample(range(rare_digest.PAIRS + 1), rare_digest.PAIRS + 1))
    texts = ["".join(rng.choices("abcdefgh é\n", k=n)) for n in (0, 1, 31, 32, 33, 200, 900, 9000)] + ["ab" * 300, "z" * 500]
    texts.append(texts[6][:450] + texts[5])
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    got = rare_digest.digests(np.frombuffer(b"".join(data), np.uint8), at, rarity)
    seen: dict[bytes, int] = {}

    def hash_of(window: bytes) -> int:  # of the window alone, wherever it lies
        if window not in seen:
            seen[window] = int(rare_digest._window_hash(np.frombuffer(window, np.uint8))[0])
        return seen[window]

    want = [brute_digest(b, rarity, hash_of) for b in data]
    assert [bits(f) for f in got] == want and len(want[7]) > 1
    for i in range(len(data)):
        for j in range(len(data)):
            assert rare_digest.likeness(got[i], got[j]) == pytest.approx(brute_likeness(want[i], want[j]), abs=2e-6)


def test_report_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rarity = rare_digest.rarities(docs)
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    digest = lambda t: rare_digest.digests(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), rarity)[0]
    got = {r["doc_id"]: r for r in rare_digest.fingerprints(docs).collect()}
    for i, r in enumerate(rows[:60]):
        t, after = r["text"], rows[(i + 1) % len(rows)]["text"]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, other, next_ = digest(t), digest(edited), digest(after)
        g = got[r["doc_id"]]
        assert g["fingerprint"] == base64.b64encode(own.tobytes()).decode() and g["edited_fingerprint"] == base64.b64encode(other.tobytes()).decode()
        assert g["near_edited"] == rare_digest.likeness(own, other) and g["near_next"] == rare_digest.likeness(own, next_)


# pipeline

def test_pipeline_of_odd_and_empty_tables(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where("n_chars > 2000").orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(None, text, "en", "src1"), (10_001, None, None, None), (10_002, "", "en", None), (10_003, "12 !!", "de", "src2"), (10_004, text, None, None),
                                 (10_004, text, None, None), (10_005, text + " token = abcdef123456", "en", "new")], "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    for table in (docs.unionByName(odd), docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.written(stage(spark, kept, sf), name)
            if name == "language":
                assert not {10_001, 10_002, 10_003} & {r["doc_id"] for r in kept.collect()}
            if name == "secrets":
                assert all("abcdef123456" not in r["text"] for r in kept.collect())
            if name != "encoding":
                assert kept.columns == table.columns
        rows = kept.collect()
        assert all(r["n_tokens"] == len(r["ids"]) for r in rows) and bool(rows) == (table is not docs.limit(0) and not table.isEmpty())


def test_runs_of_few_words():
    from spendwarden.llm.texts import runs_of

    for n in range(9):
        hashes = np.arange(1, n + 1, dtype=np.uint64)
        found, of = runs_of(hashes, np.array([0, n]), 5)
        assert of.tolist() == [0, max(n - 4, int(n > 0))] and len(found) == of[-1]


def test_terms_do_not_depend_on_the_texts_beside():
    texts = ["", "a", "?!", "The river", None, "old\nand wide 12", "é"]
    together = quality_knn.terms(pa.array(texts, pa.large_string()))
    alone = [quality_knn.terms(pa.array([t], pa.large_string()))[0] for t in texts]
    assert np.allclose(together, alone)


def test_quality_fit_holds_one_matrix():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    column = pa.array([" ".join(rng.choice(words, 30)) for _ in range(1500)], pa.large_string())
    tracemalloc.start()
    try:
        model = quality_knn.Voters(column, np.arange(1500) % 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    size = quality_knn.SLOTS + quality_knn.REPEATS + quality_knn.WORD_SLOTS
    assert peak < 1.8 * 8 * size * size
    weighted = np.concatenate([quality_knn.terms(column.slice(i, 200)) for i in range(0, 1500, 200)]) * model.idf
    values, axes = np.linalg.eigh(weighted.T @ weighted)
    assert np.allclose(((weighted @ model.axes) ** 2).sum(0), values[::-1][: quality_knn.RANK])
    assert np.allclose(np.linalg.norm(axes[:, ::-1][:, :10].T @ model.axes[:, :10], axis=0), 1)
