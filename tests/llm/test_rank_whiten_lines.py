"""Ranked search, whitening and line labels against brute force; edge cases on small tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spendwarden.llm import cholesky_whitening, fp_tree_rank, line_crf, queries

DOCS = "doc_id bigint, text string, n bigint, term string, score double, k0 string, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0.5, "y", "z") for i, t in rows], DOCS)


# ranked search

def brute_rank(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = lambda t: term.findall((t or "").translate(low))
    bags = [(i, Counter(found(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, size in bags:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in found(text) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_rank_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "é", "É", "x1", "1", "Über", "的", "zz", "_", "w" * 300, *(f"t{i}" for i in range(40))]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([1, 3, 10, 60]))) for i in range(250)]
    docs += [(i % 40, t) for i, t in docs[:60]] + [(None, docs[0][1]), (None, None), (900, ""), (901, None), (902, "?!"), (903, text(30_000))]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(25)] + [(3, "zz t1 zz"), (None, "t1"), (70, None), (71, ""), (72, "absent nowhere"), (73, "x1 X1 x1")]
    got = fp_tree_rank.rank(docs_of(spark, docs), spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, score int"))
    assert ranked(got) == brute_rank(docs, items)


def test_rank_in_small_trees_and_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = ranked(fp_tree_rank.rank(docs, items))
    assert want == brute_rank([tuple(r) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    monkeypatch.setattr(fp_tree_rank, "TREE_DOCS", 17)
    monkeypatch.setattr(fp_tree_rank, "TREE_ENTRIES", 900)
    blocks = fp_tree_rank.item_blocks
    monkeypatch.setattr(fp_tree_rank, "item_blocks", lambda i: blocks(i, 11, 300))
    monkeypatch.setattr(fp_tree_rank, "LEAF", 2)
    assert ranked(fp_tree_rank.rank(docs, items)) == want


def test_rank_of_empty_tables(spark):
    docs, items = docs_of(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs_of(spark, [(1, None), (2, "!")]), items), (docs, items.select("item_id", items.text.substr(1, 0).alias("text")))):
        assert fp_tree_rank.rank(d, i).collect() == []
    assert fp_tree_rank.rank(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def _tree(bags, width, leaf):
    of = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    term = np.concatenate([sorted(b) for b in bags]).astype(np.int64)
    tf = np.concatenate([[b[t] for t in sorted(b)] for b in bags]).astype(np.int64)
    return fp_tree_rank.Tree(term, tf, of, np.array([25 + sum(b.values()) for b in bags]), width, leaf)


def test_tree_shares_paths_bounds_and_prunes():
    rng = random.Random(4)
    bags = [Counter(rng.choices(range(60), [1 / (i + 1) for i in range(60)], k=rng.choice([3, 20]))) for _ in range(800)] + [Counter({1: 2, 3: 1})] * 300
    tree = _tree(bags, 60, 4)
    assert sorted(tree.order.tolist()) == list(range(1100))
    one = np.ones(60, np.int64)
    for node, (lo, hi) in enumerate(tree.span):
        assert tree.kids[node] == [] or [tree.span[c][0] for c in tree.kids[node]][0] == lo and tree.span[tree.kids[node][-1]][1] == hi
        assert (tree.bound[node].sum() >= tree.scores(node, one)).all()
    best = [[]]
    weights = np.zeros((1, 60), np.int64)
    weights[0, [40, 50, 55]] = 5000, 6000, 7000
    scored = fp_tree_rank.search(tree, weights, list(range(1100)), best)
    assert 0 < scored < 1100 / 2  # most subtrees are left out
    part = {i: sum(int(weights[0, t]) * (1_000_000_000 * c // (1000 * c + 8 * (25 + sum(b.values())))) for t, c in b.items()) for i, b in enumerate(bags)}
    assert sorted(best[0], reverse=True) == sorted([(s, -i) for i, s in part.items() if s], reverse=True)[:10]


# whitening

def whitened(df):
    rows = df.collect()
    k = max(r["component"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r["whitened"])
    return rows, np.array([by[c + 1] for c in range(k)]).T


def check_whitening(df, x):
    """Against the eigenvectors of the exact covariance."""
    n, d = x.shape
    x = x.astype(object)
    dev = n * x - x.sum(0)
    cov = (dev.T @ dev / n**3).astype(float)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    rows, z = whitened(df)
    k = z.shape[1]
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-6 and abs(rows[0]["identity_error"]) < 1e-6
    explained = np.array([next(r["explained"] for r in rows if r["component"] == c + 1) for c in range(k)])
    assert np.allclose(explained, value[:k] / value.sum(), rtol=1e-6)
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(map(int, (dev * dev).sum(1)))
    assert all(r["n"] == n for r in rows)
    want = (dev / n).astype(float) @ vector[:, :k] / np.sqrt(value[:k])
    for c in range(k):
        gap = min([abs(value[c] - value[j]) for j in range(d) if j != c], default=1) / value[0]
        if gap > 1e-4:
            assert min(np.abs(np.sort(z[:, c]) - np.sort(s * want[:, c])).max() for s in (1, -1)) < 1e-5


def test_whitening_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([[math.floor(64 * c) + 1000000 for c in r["embedding"]] for r in rows])
    df = queries.QUERIES["op12_cholesky_whitening"](spark, sf)
    check_whitening(df, x)
    assert df.count() == len(x) * 32


def vectors_of(spark, x, more=()):
    rows = [(i, [float(c) / 64 for c in v], 1, 2.0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [(i, v, 1, 2.0) for i, v in more], "vec_id bigint, embedding array<double>, component int, whitened double")


def test_whitening_of_badly_scaled_and_dependent_columns(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(700, 5)) * [1e6, 3e3, 40, 2, 1]).astype(np.int64)
    check_whitening(cholesky_whitening.whiten(vectors_of(spark, x)), x + 1000000)
    wide = np.concatenate([x, x[:, :1] + x[:, 1:2], np.full((700, 1), 9)], 1)  # rank five in seven dimensions
    df = cholesky_whitening.whiten(vectors_of(spark, wide))
    assert {r["component"] for r in df.select("component").distinct().collect()} == {1, 2, 3, 4, 5}
    check_whitening(df, wide + 1000000)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(90, 3)) * 100).astype(np.int64)
    x[10] = x[11]
    more = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.25]), (5, [])]
    df = cholesky_whitening.whiten(vectors_of(spark, x, more))
    check_whitening(df, np.concatenate([x, [[32, 16, 0], [0, 0, 0]]]) + 1000000)
    ids = Counter(r["vec_id"] for r in df.collect())
    assert ids[None] == 3 and ids[5] == 6 and 900 not in ids and len(ids) == 91
    big = cholesky_whitening.whiten(vectors_of(spark, x, [(7, [1e300, -1e300, 5.0])])).collect()
    assert len(big) % 91 == 0 and all(math.isfinite(r["whitened"]) for r in big) and any(r["deviation"] is None for r in big)
    for few in (x[:0], x[:1], np.repeat(x[:1], 4, 0), np.zeros((3, 0))):
        assert cholesky_whitening.whiten(vectors_of(spark, few)).count() == 0


def test_passes_restore_orthogonality():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 8)) @ np.diag(10.0 ** -np.arange(8)) @ rng.normal(size=(8, 8))
    base -= base.mean(0)
    gram = lambda factors: (lambda q: q.T @ q)(cholesky_whitening.solved(base.copy(), factors))
    spread, axes, passes = cholesky_whitening.factor(gram, 8)
    assert passes >= 2 and np.allclose(spread, np.linalg.svd(base)[1][: len(spread)], rtol=1e-7)
    q = base @ axes / spread
    assert np.abs(q.T @ q - np.eye(len(spread))).max() < 1e-6


# line labels

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_counts_equal_brute_force(spark, sf):
    rng = random.Random(8)
    odd = ["", None, " \n\t", "a", "é\n é\né", "a b\r\na b\r\n", "\x00 \x1c\x85  x y", "x " * 30, "\n".join(["one two three four five six seven eight"] * 3), "<a|b>\n" * 20,
           " ".join(rng.choices("abc", k=500)), " ".join(rng.choices(["ab", "c", "\n", "ñ$"], k=60_000)), "one two three\n\n\none two three\n \n"]
    docs = docs_of(spark, list(enumerate(odd)) + [(3, "a"), (None, "b c")]).unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text"), allowMissingColumns=True)
    got = line_crf.rules_report(docs, None)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    have = sorted(((r["doc_id"], *(r[c] for c in names)) for r in got.collect()), key=str)
    assert have == sorted(((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect()), key=str)
    assert all(r["kept"] == (not r["base_failed"]) for r in got.collect())


@pytest.mark.parametrize("block", [1, 3, 64])
def test_viterbi_equals_all_paths(block, monkeypatch):
    monkeypatch.setattr(line_crf, "BLOCK", block)
    rng = np.random.default_rng(block)
    count = rng.integers(0, 9, 40)
    of = np.concatenate([[0], np.cumsum(count)])
    emit, change = rng.normal(size=(of[-1], 2)), rng.normal(size=(2, 2)) * 2
    got = line_crf.viterbi(emit, of, change)
    for a, b in itertools.pairwise(of):
        if b > a:
            score = lambda p: sum(emit[a + t, y] for t, y in enumerate(p)) + sum(change[p[t - 1], p[t]] for t in range(1, len(p)))  # noqa: B023, E731
            assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=int(b - a)), key=score)
    flat = line_crf.viterbi(np.zeros((5, 2)), np.array([0, 5]), np.zeros((2, 2)))
    assert flat.tolist() == [0] * 5  # ties are content


def test_expectations_equal_all_paths():
    rng = np.random.default_rng(2)
    emit, change = rng.normal(size=(3, 5, 2)), rng.normal(size=(2, 2))
    post, changes = line_crf.expectations(emit, change)
    want, pairs = np.zeros_like(post), np.zeros((2, 2))
    for s in range(3):
        paths = list(itertools.product((0, 1), repeat=5))
        weight = np.array([math.exp(sum(emit[s, t, y] for t, y in enumerate(p)) + sum(change[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t, y in enumerate(p):
                want[s, t, y] += w
            for a, b in itertools.pairwise(p):
                pairs[a, b] += w
    assert np.allclose(post, want) and np.allclose(changes, pairs)


def slow_features(text):
    """Some measures of each line, straight from the text."""
    rows = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    out = []
    for i, line in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        chars = sum(map(len, words))
        out.append({"words": len(words), "word length": chars / len(words), "symbols": sum(c in "#*$%&|<>" for c in line) / chars, "bars a word": line.count("|") / len(words),
                    "same as word before": sum(a == b for a, b in itertools.pairwise(words)) / len(words), "distinct words": len(set(words)) / len(words),
                    "equal lines": 2 * (line in rows[:i]) + (line in rows[i + 1 :]), "equal to line before": int(i > 0 and rows[i - 1] == line), "place": 2 * (i == 0) + (i == len(rows) - 1)})
    return out


def test_features_equal_plain_loops():
    text = ["One two two. \n\n| a | b |\n| a | b |\nÉté ÉTÉ!!", None, "", "x\n \ny\nx", "SALE!! " * 9]
    lines = line_crf.Lines(pa.array(text, pa.string()))
    got = lines.features()
    want = [f for t in text for f in slow_features(t or "")]
    assert len(got) == len(want)
    base, names = {}, [*line_crf.EDGES, *line_crf.KINDS]
    for name in names:
        base[name] = sum(base[n][1] for n in base), len(line_crf.EDGES[name]) + 1 if name in line_crf.EDGES else line_crf.KINDS[name]
    for row, f in zip(got, want, strict=True):
        for name, value in f.items():
            slot = np.digitize(value, line_crf.EDGES[name]) if name in line_crf.EDGES else value
            assert row[names.index(name)] == base[name][0] + slot, (name, value)


def test_lines_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = line_crf.train(docs, labels)
    got = {r["doc_id"]: r for r in line_crf.rules_report(docs, field).collect()}
    clean, junk = [[r["doc_id"] for r in labels.where(f"quality = {q}").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0] for q in (1, 0)]
    long = [d for d in clean if not got[d]["base_failed"]]
    assert len(long) > 30 and sum(got[d]["kept"] for d in long) >= 0.97 * len(long)
    assert sum(not got[d]["kept"] for d in junk) >= 0.8 * len(junk) > 0
    assert field.change[0, 0] + field.change[1, 1] > field.change[0, 1] + field.change[1, 0]  # labels tend to stay


def test_lines_of_a_mixed_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = line_crf.train(docs, labels)
    good = ["The old harbour was built by masons, and the town grew along the river as letters of that year tell.", "Ships brought timber and salt from the north until the winter storms closed the bay.",
            "In spring the council met to settle who should pay for the bridge and the new mill.", "Nobody remembers when the market moved, yet every map shows the square beside the church.",
            "Farmers kept their accounts in small books that survived the fire of the archive.", "From these books we know the price of bread in each of the following years."]
    bad = ["BUY!! NOW!! SALE!! ENDS!! TODAY!! CLICK!! HERE!!", "home | about | shop | basket | help | login", "Ha Ha Ha Ha Ha Ha Ha Ha Ha Ha Ha Ha", "win$$$ cash*** fast%%% here### free&&& money$$$"]
    made = docs_of(spark, [(1, "\n".join(good)), (2, "\n".join(bad * 3)), (3, "\n".join(good + bad)), (4, None), (5, "")])
    marked = {(r["doc_id"], r["line"]): r["content"] for r in line_crf.marked_lines(made, field).collect()}
    assert all(marked[1, i] for i in range(6)) and not any(marked[2, i] for i in range(12))
    assert [marked[3, i] for i in range(10)] == [True] * 6 + [False] * 4
    kept = line_crf.kept_only(made, field)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == made.columns
    assert line_crf.rules_report(made.limit(0), field).count() == 0 and line_crf.marked_lines(made.limit(0), field).count() == 0
    assert line_crf.fit([]) is None and line_crf.fit([(1, 1, "a b c")]) is None
