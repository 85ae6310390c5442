"""Text operators against brute force, round trips and held-out rows; edge cases on small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import html
import random
import re
import zlib

import pytest

from spendwarden.llm import arc_to_warc, bpe_backtrack, dart_minhash, html_blocks, lang_crf, quality_knn, queries, rare_digest, secret_tests, source_mix, voronoi_knn

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _size string, class_id string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    words = " ".join(random.Random(1).choices(["the", "and", "of", "wherever", "reading"], k=40_000))
    rows = [(1, "hello world again", "en", "a"), (1, "hello world again", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "12 34 !!", "de", None),
            (None, "some text here", "en", "b"), (5, words, "en", "b"), (6, words + " more", "en", "b"), (7, 'token = "abcdef0123456789abcdef0123456789"', "fr", "c")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "y") for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, key):
    import duckdb

    from checks.compare import canon

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, rel = queries.QUERIES[key](spark, sf), con.sql(queries.ORACLE[key])
    cols, names = sorted(df.columns), list(rel.columns)
    assert sorted(names) == cols
    assert sorted([canon(r[c]) for c in cols] for r in df.collect()) == sorted([canon(r[names.index(c)]) for c in cols] for r in rel.fetchall())


# archives

def test_arc_versions_and_lengths():
    for names in arc_to_warc.FIELDS.values():
        version = b"2" if len(names) == 10 else b"1"
        intro = version + b" 0 x\n" + " ".join(names).encode() + b"\n"
        head = lambda size: ("http://a/ 0.0.0.0 20010203040506 text/html " + ("200 c - 0 f " if len(names) == 10 else "") + str(size)).encode()
        data = head(len(intro)) + b"\n" + intro + b"\n" + head(7) + b"\nab\n\ncd\n" + b"\n" + head(0) + b"\n\n"
        found = list(arc_to_warc.parse_arc(data))
        assert [f[2] for f in found] == [b"ab\n\ncd\n", b""] and found[0][1]["Archive-date"] == "20010203040506"


def test_archive_of_odd_pages(spark):
    pages = spark.createDataFrame([(3, "http://a b/", "x\r\n\r\ny é"), (1, None, "x\r\n\r\ny é"), (2, "u", None), (4, "u", ""), (None, "u", "x\r\n\r\ny é"), (5, "u", "WARC/1.0\r\n"), (5, "u", "WARC/1.0\r\n")], "page_id bigint, url string, html string")
    got = sorted(map(tuple, arc_to_warc.archive_report(pages).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    same = sha("x\r\n\r\ny é")
    assert got == sorted([(3, 9, same, "revisit", 1), (1, 9, same, "response", None), (2, 0, sha(""), "response", None), (4, 0, sha(""), "revisit", 2), (None, 9, same, "revisit", 1),
                          (5, 10, sha("WARC/1.0\r\n"), "response", None), (5, 10, sha("WARC/1.0\r\n"), "response", None)], key=str)
    assert arc_to_warc.archive_report(pages.limit(0)).count() == 0


# mixture

def test_mix(docs, odd, none):
    n = collections.Counter(r["doc_id"] for r in source_mix.mix(docs).collect())
    for r in source_mix.mix_report(docs).collect():
        assert r["taken"] == n[r["doc_id"]] * r["size"] and r["taken"] <= 3 * r["size"]
    assert source_mix.mix(odd).columns == odd.columns and source_mix.mix_report(odd).count() == 9
    assert source_mix.mix_report(none).count() == 0 and source_mix.mix(none).count() == 0


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 10), (None, 500), ("d", 0)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in source_mix.source_targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 30 and got["d"] == 0 and sum(got.values()) == pytest.approx(1511)
    assert got[None] / got["a"] == pytest.approx(2)  # fifth in order: weight 2


# secrets

def brute_spans(t: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_equal_brute_force(spark, docs, odd, none):
    key = "".join(random.Random(5).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=48))
    cases = ["password: token = abcdefgh", "🙂 SECRET=abcdef 🙂 api_key:'x/y=z.w-v'", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "f" * 23 + " " + "0" * 24, f"see {key} there", "thereandtherewithoutreading" * 2,
             " ".join(f"token={i:06d}" for i in range(700))]
    made = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = rows_of(secret_tests.secret_report(made))
    for r in [*made.collect(), *docs.collect()]:
        want = brute_spans(r["text"])
        have = got[r["doc_id"]] if r["doc_id"] < len(cases) and r["text"] == cases[r["doc_id"]] else None
        if have:
            assert have["base_sha256"] == hashlib.sha256(",".join(f"{secret_tests.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    assert got[4]["spans"] == "random:4:52" and got[5]["spans"] == ""
    assert secret_tests.secret_report(odd).count() == 9 and secret_tests.secret_report(none).count() == 0
    masked = {r["doc_id"]: r for r in secret_tests.redact(odd).collect()}
    assert masked[7]["text"] == '[secret]"' and masked[7]["n_chars"] == 9 and masked[2]["text"] is None and masked[1]["text"] == "hello world again"


# quality and language

def test_quality_on_held_out_rows(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality_knn.quality_report(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum((r["predicted"] == truth[r["doc_id"]]) for r in rows) >= 0.85 * len(rows)
    assert quality_knn.quality_report(odd, labels.limit(0)).where("score = 0").count() == 9
    assert quality_knn.quality_report(odd, labels).count() == 9


def test_language_on_held_out_rows(docs, odd, none):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in lang_crf.language_report(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    got = rows_of(lang_crf.language_report(odd))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (2, 3, 4))
    assert lang_crf.language_report(none).count() == 0
    kept = lang_crf.known_only(odd, lang_crf.train(docs))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, None, 5, 6, 7}


def test_chain_equals_forward_backward():
    import numpy as np

    rng = np.random.default_rng(3)
    of = np.array([0, 0, 1, 70, 71, 300])
    emit, change = rng.normal(size=(300, 3)), np.exp(rng.normal(size=(3, 3)))
    got = lang_crf.chain(emit, of, change)
    for a, b in zip(of, of[1:], strict=False):
        e, ahead, back = np.exp(emit[a:b]), [], np.ones(3)
        state = np.ones(3)
        for x in e:
            state = (state @ change) * x
            state /= state.sum()
            ahead.append(state)
        for t in range(b - a - 1, -1, -1):
            p = ahead[t] * back
            assert np.allclose(got[a + t], p / p.sum())
            back = change @ (e[t] * back)
            back /= back.sum()


# pages

def test_main_text():
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use many small cookies on this site.</div>"
            "<article><h1>A&amp;B</h1><p>One <a href=y>two</a><br>three&nbsp;four<p>x<!-- no --></article><aside><p>More of the same for you to read</p></aside>"
            "<section id=comments><p>I liked this long article very much indeed</p></section><form><input>Send</form><footer>&copy; me</foo")
    assert html_blocks.main_text(page) == "A&B\nOne two three four\nx"
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<nav><a>x</a></nav>") == ""
    assert html_blocks.classify(html_blocks.features([])).tolist() == []


def test_pages_equal_their_articles(spark, sf):
    pages = {r["page_id"]: r for r in html_blocks.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(p for p in parts if p)
        assert pages[r["page_id"]]["text"] == want and pages[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize("wrapper", ["div class='layout with-sidebar'", "div id='content' class='no-comments'", "div class='page has-left-sidebar'", "div class='post widget'",
                                     "section class='related'", "form id=aspnet"])
def test_wrappers_keep_their_article(wrapper):
    story, aside = "The council met on Monday and agreed to pay for the new bridge over the river. " * 4, "<p>More of the same for you to read today and tomorrow</p>"
    tag = wrapper.split()[0]
    for inner in ("article", "main"):
        page = f"<body><{wrapper}><{inner}><h1>Bridge</h1><p>{story}</p><div class=related>{aside}</div><section id=comments><article>{aside}</article></section></{inner}><div class=sidebar>{aside}</div></{tag}>"
        assert html_blocks.main_text(page) == "Bridge\n" + story.strip()


def test_layout_names_are_no_hints():
    story = "The council met on Monday and agreed to pay for the new bridge over the river. " * 4
    for name in ("layout with-sidebar", "no-comments", "page_has_left_sidebar", "without-nav"):
        assert html_blocks.main_text(f"<div class='{name}'><p>{story}</p><p>{story}</p></div>") == "\n".join([story.strip()] * 2)
    assert html_blocks.main_text(f"<div class='sidebar no-padding'><p>{story}</p></div><aside><article><p>{story}</p></article></aside>") == ""


# fingerprints

def test_fingerprints(spark, docs, odd, none):
    got = rows_of(rare_digest.fingerprints(docs))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(text, reverse=True)
    for i, x in enumerate(ids):
        t, u = text[x], text[ids[(i + 1) % len(ids)]]
        assert got[x]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    long = [g for g in got.values() if g["n_chars"] > 1000]
    assert sum(g["near_edited"] for g in long) / len(long) > 0.4 > 0.2 > sum(g["near_next"] for g in long) / len(long)
    same = collections.defaultdict(set)
    for x, t in text.items():
        same[t].add(got[x]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    odd_rows = rare_digest.fingerprints(odd).collect()
    assert len(odd_rows) == 9 and all(0 <= r["near_next"] <= 1 for r in odd_rows) and rare_digest.fingerprints(none).count() == 0


# near-duplicates

def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    out, seen = set(), collections.Counter()
    for s in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
        out.add((s, seen[s]))
        seen[s] += 1
    return out


def brute_classes(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_classes_equal_brute_force(spark, docs, odd, none):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = [f"w{i}" for i in range(150)]
    for k in range(40):  # edited copies, most similar to what they were made from, which has the largest id
        edited = list(base)
        edited[(7 * k) % 145], edited[(7 * k + 60) % 145] = "new", f"e{k}"
        texts[10_000 + k] = " ".join(edited)
    texts[20_000] = " ".join(base)
    got = rows_of(dart_minhash.classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    assert {i: r["class_id"] for i, r in got.items()} == brute_classes(texts)
    odd_rows = dart_minhash.classes(odd)
    assert odd_rows.count() == 9 and rows_of(odd_rows)[6]["class_id"] == 5 and rows_of(odd_rows)[None]["class_id"] is None
    assert dart_minhash.first_of_class(odd).columns == odd.columns and dart_minhash.classes(none).count() == 0


def test_near_copies_within_a_template_group(spark):
    """Texts of one template share their buckets and are no near-copies; the pairs among them are far from every centre."""
    def edited(tag, first=None):  # nine of 400 words are the text's own
        return " ".join(f"{first if first and i == 20 else tag}x{i}" if i in range(20, 380, 40) else f"w{i}" for i in range(400))

    texts = {k: edited(f"t{k}") for k in range(500)}  # 0.796 similar, each to each
    for k in range(20):  # 0.817 similar
        texts[1000 + k], texts[2000 + k] = edited(f"a{k}", f"p{k}"), edited(f"b{k}", f"p{k}")
    sets = {i: shingles(texts[i]) for i in (0, 1, 1000, 2000)}
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]) and len(sets[1000] & sets[2000]) > 0.8 * len(sets[1000] | sets[2000])
    made = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {i: r["class_id"] for i, r in rows_of(dart_minhash.classes(made)).items()}
    assert got == {i: i - 1000 if i >= 2000 else i for i in texts}


def test_cells_do_not_change_classes(spark, docs, monkeypatch):
    whole = sorted(map(tuple, dart_minhash.classes(docs).collect()))
    monkeypatch.setattr(dart_minhash, "CELL", 2)
    monkeypatch.setattr(dart_minhash, "CENTRES", (1,))
    assert sorted(map(tuple, dart_minhash.classes(docs).collect())) == whole


# tokens

def test_tokens_equal_library(docs, odd, none):
    import numpy as np
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe_backtrack.Codec(raw, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab eEthion éßü  \n\t\x1c\x85\xa0　'st've0123²Ⅷ日本語🙂 ,.;#$") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == known.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in rows_of(bpe_backtrack.round_trip(docs)).items():
        ids = np.array(known.encode_ordinary(texts[i]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
    ids = bpe_backtrack.encode(odd)
    assert ids.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and rows_of(bpe_backtrack.decode(ids))[5]["text"].decode() == rows_of(odd)[5]["text"]
    assert bpe_backtrack.encode(none).count() == 0


# nearest neighbours

def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [-1.0, 0.0]), (None, [9.0, 9.0]), (7, [0.0, 2.0]), (8, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in voronoi_knn.top_k(df, pivots=3).orderBy("query_id", "rank").collect()]
    v = {i: [int(256 * x // 1) for x in e] + [0] * (2 - len(e)) for i, e in rows if i is not None and e and all(x is not None and x == x for x in e)}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want
    assert voronoi_knn.top_k(df.limit(0)).count() == 0 and voronoi_knn.top_k(df.where("vec_id = 1")).count() == 0


def test_blocks_do_not_change_results(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = voronoi_knn.top_k(rows).collect()
    monkeypatch.setattr(voronoi_knn, "QUERY_BLOCK", 2)
    monkeypatch.setattr(voronoi_knn, "DATA_BLOCK", 60)
    assert sorted(whole) == sorted(voronoi_knn.top_k(rows).collect())


# pipeline

def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = corpus_pipeline.written(stage(spark, kept, sf), name)
        assert kept.columns == docs.columns
    rows = kept.collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {i for i, c in brute_classes(texts).items() if i == c}
    assert {r["doc_id"] for r in rows} <= first
    assert not any(brute_spans(r["text"]) for r in rows)
    assert corpus_pipeline.STAGES[4][1](spark, kept, sf).count() == len(rows)
