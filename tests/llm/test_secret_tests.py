"""Secret scans: base spans over the whole table by brute force, long lists, joined tokens, masks."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import string
import time

from pyspark.sql import functions as F

from spendwarden.llm import secret_tests

SIGNS = "A-Za-z0-9+/_=-"


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def brute_tokens(t):
    """Maximal runs of 20 signs that touch no base span, and their parts."""
    base, out = brute_spans(t), []
    for m in re.finditer(f"[{SIGNS}]{{20,}}", t):
        if not any(a < m.end() and m.start() < b for a, _, b in base):
            parts = [(p.start(), p.end()) for p in re.finditer(r"[^/=_-]{16,}", t[: m.end()][m.start() :])] if re.search("[/=_-]", m[0]) else []
            out.append((m.start(), m.end(), [(m.start() + a, m.start() + b) for a, b in parts]))
    return out


def key(seed, n=40, signs=string.ascii_letters + string.digits):
    return "".join(random.Random(seed).choices(signs, k=n))


def odd_texts():
    rng = random.Random(3)
    words = ["password", "Token", "secret_key", "api_key", "API-KEY", "=", ":", " ", "  ", "\n", '"', "'", ".", "/", "-", "_", "AKIA" + "Z9" * 9, "f0" * 14, "abc", "x" * 19, "y" * 21, "é", "🙂", "+", "hidden1", "t=1"]
    texts = ["".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(400)]
    return texts + ["x" * 30 + "_token=abc and more", "token: token = abcdefgh", "mypassword=" + "q" * 30, "a" * 25 + "/secret='" + "b" * 9 + "'" + "c" * 22, "token=short." + "z" * 30, None, ""]


def test_base_spans_and_tokens_equal_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secret_tests.secret_report(df).collect()}
    light = {r["doc_id"]: r["_tokens"] for r in secret_tests.scanned(df).select("doc_id", "_tokens").collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        want = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{secret_tests.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest(), t
        count = collections.Counter(k for _, k, _ in want)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (count[0], count[1], count[2])
        assert [(x["whole"]["start"], x["whole"]["stop"], [(p["start"], p["stop"]) for p in x["parts"]]) for x in light[i]] == brute_tokens(t or ""), t


def test_secrets_joined_to_words_are_found(spark):
    texts = [f"https host /services/hooks/incoming/{key(i, 24)} end" for i in range(60)] + [f"AWS_ACCESS_VALUE={key(100 + i)}" for i in range(60)] + [
        "/usr/share/documentation/configuration/installation notes", "some_long_function_name_with_many_words_in_it"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_tests.secret_report(df).collect()}
    hit = [i for i in range(120) if got[i]]
    assert len(hit) >= 110 and not any(got[i] for i in range(120, 180))
    a, b = map(int, got[hit[0]].split(":")[1:])
    assert key(hit[0], 24) in texts[hit[0]][a:b]


def test_masks_equal_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    spans = {r["doc_id"]: [tuple(x) for x in r["_spans"]] for r in (lambda s: secret_tests.decided(s, secret_tests.cutoffs(s)))(secret_tests.scanned(df)).collect()}
    for r in secret_tests.redact(df).collect():
        t = texts[r["doc_id"]]
        if t is None:
            assert r["text"] is None
            continue
        want, end = [], 0
        merged = []
        for a, _, b in sorted(spans[r["doc_id"]]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            want += [t[end:a], "[secret]"]
            end = b
        assert r["text"] == "".join(want) + t[end:] and r["n_chars"] == len(r["text"])


def test_merging_of_long_lists(spark):
    rng = random.Random(6)
    spans = sorted((a, 0, a + rng.randrange(1, 90)) for a in rng.sample(range(40_000), 1500))
    df = spark.createDataFrame([(spans,), ([(5, 1, 9)],)], "s array<struct<start:bigint,kind:int,stop:bigint>>")
    got = [[tuple(x) for x in r["m"]] for r in df.select(secret_tests.merged_spans(F.col("s")).alias("m")).collect()]
    want = []
    for a, _, b in spans:
        if want and a < want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], b))
        else:
            want.append((a, b))
    assert got == [want, [(5, 9)]]


def test_long_lists_cost_their_length(spark):
    def seconds(n):
        text = "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        start = time.time()
        row = secret_tests.redact(df).first()
        assert row["text"] == "\n".join(["[secret]"] * n)
        return time.time() - start

    seconds(50)
    small = seconds(2000)
    assert seconds(16_000) < 16 * max(small, 1.0)


def test_texts_are_scanned_once_for_masking(spark):
    df = spark.createDataFrame([(1, "password = hunter22 and more", 28), (2, None, None)], "doc_id bigint, text string, n_chars int")
    out = secret_tests.redact(df)
    assert any("/secrets-" in f for f in out.inputFiles())  # what follows reads the scan's rows
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "[secret] and more", 17), (2, None, None)]
