"""The queries of the training-data operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import exact_dedup, jaccard, labelled_pages, language_id, mixing, packing, pages_html, secrets, token_counts, topk, toxicity
from tallyscope.llm.common import crc32_of_id, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = secrets.train(secrets.samples(spark, table(spark, sf_dir, "benchmark")))
    return secrets.report(table(spark, sf_dir, "documents"), weights)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.near_groups(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
    return groups.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.decide(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_html.extract(table(spark, sf_dir, "pages"), pages_html.train(labelled_pages.pages()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train_text(table(spark, sf_dir, "documents"))
    return language_id.identify(table(spark, sf_dir, "pages"), model).drop("probabilities")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  belongs to this subpackage: both are there or neither

    every = (op1_toxicity, op2_packing, op3_mixing, op4_topk, op5_token_counts, op6_secrets, op7_ngram_jaccard, op8_exact_dedup, op9_html, op10_language_id, pipeline)
    return {f.__name__: f for f in every}


_OP3 = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    -ln((cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) + 0.5::double) / 281474976710656::double)
      / case when q.quality >= 1 then 2.0::double when q.quality = 0 then 0.5::double else 1.0::double end as k
  from documents left join (select doc_id as l, max(quality) as quality from labels where doc_id is not null group by doc_id) q on q.l = doc_id
), s as (
  select source, cast(sum(size) as bigint) as source_size, ([5, 2, 1])[cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as w,
    row_number() over (order by source nulls last) as r
  from d group by source
), f as (
  select *, 3 * source_size as cap, sum(source_size) over () as total,
    w * (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by (30 * source_size) // w, r rows between unbounded preceding and 1 preceding), 0))
      >= 3 * source_size * sum(w) over (order by (30 * source_size) // w, r rows between current row and unbounded following) as capped
  from s
), t as (
  select source, source_size,
    case when capped then cast(cap as double) else cast(w * (total - sum(case when capped then cap else 0 end) over ()) as double)
      / cast(sum(case when capped then 0 else w end) over () as double) end as target
  from f
), e as (
  select *, case when source_size > 0 then least(3, cast(floor(target / source_size) as bigint)) else 0 end as epochs from t
)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(size * (epochs + case when sum(size) over (partition by d.source order by k, doc_id rows unbounded preceding) - size / 2.0::double
    <= target - epochs * source_size then 1 else 0 end) as bigint) as taken
from d join e on d.source is not distinct from e.source
"""

_OP4 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

_OP7 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select distinct doc_id, case when len(w) < 3 then w else w[i : i + 2] end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from g group by doc_id
), b as (select g, list(doc_id) as docs from g group by g having count(*) > 1
), a as (select unnest(docs) as x, docs from b
), p as (select x, y, count(*) as o from (select x, unnest(docs) as y from a) where x <> y group by x, y
), l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 90 * (a.n + b.n - o)
), c as (select doc_id as x, doc_id as y from documents union select c.x, l.y from c join l on l.x = c.y)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id
from documents d left join n on n.doc_id = d.doc_id join (select x, min(y) as component_id from c group by x) m on m.x = d.doc_id
"""

_OP8 = r"""
with t as (
  select doc_id, coalesce(text, '') as o, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents
), r as (
  select doc_id, h, first_value(doc_id) over (partition by h order by length(o) desc, doc_id) as keep_id, count(*) over (partition by h) as n from t
)
select doc_id, keep_id, cast(n as bigint) as group_size, doc_id = keep_id as kept, h as text_sha256 from r
"""


_OP6 = r"""
with k as (select unnest(list_transform(range(128), lambda c: c)) as c), known as (select c from k where regexp_full_match(chr(c::int), '[A-Za-z0-9+/_=-]')),
h as (select sha256(cast(i as varchar)) as d from (select unnest(range(4096)) as i)),
r as (select d, to_base64(from_hex(d)) as b from h),
g as (select list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda x: lower(x)) as w from benchmark),
t as (
  select unnest([upper(d), d, b, translate(b, '+/=', 'xyz'), translate(b, '+/=', '-_'), upper(translate(b, '+/=', '234'))]) as token, true as random from r
  union all select unnest([array_to_string(w, '_'), array_to_string(w, '-'), array_to_string(w, '/'), array_to_string(w, ''),
    array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ''), upper(array_to_string(w, '_')),
    array_to_string(list_transform(range(len(w)), lambda i: w[i + 1] || (i % 100)), '_'),
    array_to_string(list_transform(range(len(w)), lambda i: '20' || lpad(cast(i % 30 as varchar), 2, '0') || '-' || lpad(cast(i % 12 + 1 as varchar), 2, '0')), '/')]), false from g
), p as (select random, unnest(list_transform(range(1, length(token)), lambda i: token[i : i + 1])) as p from t where length(token) > 1
), c as (select random, ascii(p[1]) as a, ascii(p[2]) as b, count(*) as n from p group by all
), m as (select x.c as a, y.c as b, u.random, coalesce(c.n, 0) as n from known x, known y, (values (true), (false)) u(random) left join c on c.random = u.random and c.a = x.c and c.b = y.c
), q as (select a, b, random, ln((n + 1) / (sum(n) over (partition by random, a) + (select count(*) from known))::double) as l from m
), w as (select a, b, round(1000 * (max(case when random then l end) - max(case when not random then l end))) as w from q group by a, b
), d as (select doc_id, coalesce(text, '') as x from documents
), e as (
  select doc_id, 0 as k, regexp_extract_all(x, $A$) as m, string_split_regex(x, $A$) as s, regexp_extract_all(x, $A$, 2) as v from d
  union all select doc_id, 1, regexp_extract_all(x, 'AKIA[A-Z0-9]+'), string_split_regex(x, 'AKIA[A-Z0-9]+'), null from d
  union all select doc_id, 2, regexp_extract_all(x, '[0-9a-f]{24,}'), string_split_regex(x, '[0-9a-f]{24,}'), null from d
  union all select doc_id, 3, regexp_extract_all(x, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(x, '[A-Za-z0-9+/_=-]{20,}'), null from d
), f as (select *, unnest(range(1, len(m) + 1)) as i from e where len(m) > 0
), j as (select doc_id, k, m[i] as token, v[i] as value, coalesce(list_sum(list_transform(s[1 : i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda y: length(y))), 0) as b from f
), o as (select doc_id, k, b::bigint as b, (b + length(token))::bigint as e, token from j where case k when 0 then length(value) >= 6 when 1 then length(token) >= 20 when 2 then true else regexp_matches(token, '[0-9]') and regexp_matches(token, '[A-Za-z]') end
), l as (select doc_id, b, e, unnest(list_transform(range(1, length(token)), lambda i: token[i : i + 1])) as p from o where k = 3
), z as (select doc_id, l.b as b, e from l left join w on w.a = ascii(l.p[1]) and w.b = ascii(l.p[2]) group by doc_id, l.b, e having sum(coalesce(w.w, 0)) >= 8000
), y as (
  select doc_id, k, b, e from o where k < 3
  union all select doc_id, 3, b, e from z where not exists (select 1 from o where o.k < 3 and o.doc_id = z.doc_id and o.b < z.e and z.b < o.e)
), a as (
  select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
    string_agg(['assign', 'access', 'hex'][k + 1] || ':' || b || ':' || e, ',' order by b, k, e) filter (k < 3) as base,
    string_agg(['assign', 'access', 'hex', 'markov'][k + 1] || ':' || b || ':' || e, ',' order by b, k, e) as spans from y group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a on a.doc_id = d.doc_id
""".replace("$A$", "'" + secrets.ASSIGN.replace("'", "''") + "'")


def oracle_sql() -> dict[str, str]:
    return {"op6_secrets": _OP6, "op3_mixing": _OP3, "op4_topk": _OP4, "op7_ngram_jaccard": _OP7, "op8_exact_dedup": _OP8}
