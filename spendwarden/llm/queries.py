"""Registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arc_to_warc, bpe_backtrack, cholesky_whitening, dart_minhash, fp_tree_rank, html_blocks, lang_crf, line_crf, quality_knn, rare_digest, secret_tests, source_mix, voronoi_knn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_source_mix(spark, sf_dir):
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


# a prefix of the sources by size / weight stops at three times its size; the rest shares what is left
ORACLE["op2_source_mix"] = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from s),
r as (select *, row_number() over (order by source_size / weight, source nulls last) as place from w),
l as (select *, (sum(source_size) over () - 3 * (sum(source_size) over (order by place) - source_size))::bigint as rest,
        (sum(weight) over () - sum(weight) over (order by place) + weight)::bigint as share from r),
f as (select min(place) as place from l where weight * rest <= 3 * source_size * share),
t as (select l.source, l.source_size, case when l.place < f.place then (3 * l.source_size)::double
        else (l.weight * g.rest)::double / g.share::double end as target
      from l, f join l as g on g.place = f.place),
x as (select d.doc_id, d.size, t.source_size, t.target, coalesce(least(t.target / nullif(t.source_size, 0)::double, 3.0), 0.0) as rate,
        ('0x' || substr(md5(concat_ws(':', d.doc_id, 'mix')), 1, 13))::bigint::double / 4503599627370496.0 as toss
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (floor(rate)::bigint + case when toss < rate - floor(rate) then 1 else 0 end) as taken from x
"""


@query
def op5_secret_tests(spark, sf_dir):
    return secret_tests.secret_report(table(spark, sf_dir, "documents"))


@query
def op8_bpe_backtrack(spark, sf_dir):
    return bpe_backtrack.round_trip(table(spark, sf_dir, "documents"))


@query
def op9_lang_crf(spark, sf_dir):
    return lang_crf.language_report(table(spark, sf_dir, "documents"))


@query
def op3_quality_knn(spark, sf_dir):
    return quality_knn.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_voronoi_knn(spark, sf_dir):
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op10_voronoi_knn"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query
def op7_dart_minhash(spark, sf_dir):
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


@query
def op4_html_blocks(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op6_rare_digest(spark, sf_dir):
    return rare_digest.fingerprints(table(spark, sf_dir, "documents"))


@query
def op1_arc_to_warc(spark, sf_dir):
    return arc_to_warc.archive_report(table(spark, sf_dir, "pages"))


ORACLE["op1_arc_to_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as hex, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to
from h
"""


@query
def op11_fp_tree_rank(spark, sf_dir):
    return fp_tree_rank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_fp_tree_rank"] = r"""
with words as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents where text is not null),
d as (select doc_id, r, t, len(t)::bigint as n from words where len(t) > 0),
c as (select count(*)::bigint as docs, sum(n)::bigint as total from d),
i as (select item_id, row_number() over () as i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, i, term, count(*)::bigint as q from i group by all),
e as (select r, unnest(t) as term from d),
f as (select r, term, count(*)::bigint as tf from e where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from f, c group by term, docs),
m as (select doc_id, r, 25 + (75 * n * docs) // total as m from d, c),
s as (select item_id, i, doc_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join f using (term) join w using (term) join m using (r) group by all),
p as (select item_id, i, doc_id, score, (row_number() over (partition by i order by score desc, doc_id))::int as rank from s where score > 0)
select item_id, rank, doc_id, score from p where rank <= 10
"""


@query
def op12_cholesky_whitening(spark, sf_dir):
    return cholesky_whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_crf.rules_report(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))
