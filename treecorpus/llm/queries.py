"""The registered queries of the numbered operators, each next to its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from treecorpus.llm import (
    bpe, collocations, line_dedup, packing, pivots, quality, simhash, small_world, suffix_dedup, topk, toxicity, url_filter, variants,
)
from treecorpus.llm.common import id_back

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict) of the contract.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("op1_url_filter", """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from cut
), rules(rhost, rpath, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), judged as (
  select p.*, r.rhost || r.rpath as rule, r.verdict,
         row_number() over (partition by page_id order by length(r.rhost || r.rpath) desc) as place
  from parts p left join rules r
    on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from judged where place = 1
""")
def op1_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query("op2_line_dedup", """
with docs as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), lines as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from docs
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), repeated as (
  select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), marked as (
  select keyed.*, first is not null and doc_id <> first as gone from keyed left join repeated using (k)
)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op2_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_topk", """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), placed as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs
)
select query_id, rank, vec_id, score from placed where rank <= 10
""")
def op5_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


@query("op6_bpe")
def op6_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_packing")
def op3_packing(spark, sf_dir):
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_simhash")
def op9_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_suffix_dedup", """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (
  select doc_id, i, md5(substr(h, cast(2 * i + 1 as bigint), 200)) as k
  from (select doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) as i from d)
), later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as place from w) where place > 1
), opened as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as opens from later
), spans as (
  select doc_id, min(i) as low, max(i) + 100 as high
  from (select *, sum(opens) over (partition by doc_id order by i) as span from opened) group by doc_id, span
), cuts as (  -- what stays ahead of each span, and behind the last
  select doc_id, coalesce(lag(high) over (partition by doc_id order by low), 0) as a, low as b, 1 as span, high - low as gone from spans
  union all
  select d.doc_id, coalesce(max(high), 0), any_value(length(h)) // 2, 0, 0 from d left join spans using (doc_id) group by d.doc_id
)
select doc_id, any_value(length(h)) // 2 as n_bytes, cast(sum(gone) as bigint) as n_removed, cast(sum(span) as bigint) as n_spans,
       sha256(unhex(string_agg(substr(h, cast(2 * a + 1 as bigint), cast(2 * (b - a) as bigint)), '' order by a, b))) as kept_sha256
from cuts join d using (doc_id) group by doc_id
""")
def op10_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(id_back("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_pivot_index", """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id, b.vec_id as other from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reached(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.other from reached r join links l on l.vec_id = r.other
), counts as (
  select vec_id, count(*) as n_links from links group by vec_id
)
select vec_id, coalesce(any_value(n_links), 0) as n_links, min(other) as component_id, vec_id = min(other) as kept
from reached left join counts using (vec_id) group by vec_id
""")
def op7_pivot_index(spark, sf_dir):
    return pivots.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.report(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3)


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.report(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.5)


@query("op12_spelling_variants", """
with recursive crc(tab) as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
  from documents
), held as (
  select run, count(*) as n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from runs group by doc_id, run
), slips as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
         lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as h
  from held, crc
), seen as (
  select case when h % 199 = 0 then left(run, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n
  from slips
), words as (
  select word, cast(sum(n) as bigint) as n from seen where length(word) >= 6 group by word having sum(n) >= 5
), less as (
  select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select *, unnest(range(length(word))) as i from words)
), pairs as (
  select a.word, b.word as other, b.n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word
), near as (
  select word, count(*) as n_near, first(other order by n desc, other) as best, max(n) as best_n from pairs group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * w.n then best end as form, case when best_n >= 5 * w.n then best_n end as form_n
  from words w left join near using (word)
), chains(word, last, step) as (
  select word, word, 0 from words union all
  select c.word, f.form, step + 1 from chains c join formed f on f.word = c.last where f.form is not null
), roots as (
  select word, max_by(last, step) as root from chains group by word
)
select word, form, root, n, n_near, form_n from formed join roots using (word)
""")
def op12_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=199)


@query("op13_collocations", """
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), split as (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws from pieces
), grams as (
  select lang, ws[i:i + k - 1] as ws, k
  from (select lang, ws, k, unnest(range(1, cast(len(ws) - k + 2 as bigint))) as i from split, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k)
), totals as (
  select lang, count(*) as n from grams where k = 1 group by lang
), f as (
  select lang, array_to_string(ws, ' ') as phrase, ws, k, count(*) as f from grams group by lang, ws, k having count(*) >= 30
), cuts as (
  select c.lang, c.phrase, c.f as a, i, l.f as l, r.f as r, cast(2000000 * c.f::hugeint // (l.f::hugeint + r.f) as bigint) as score
  from (select *, unnest(range(1, k)) as i from f where k > 1) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:i], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[i + 1:], ' ')
), scored as (
  select *, row_number() over (partition by lang, phrase order by score, i) as place from cuts
), around as (
  select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(f) as around
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from f where k > 2)) group by all
), ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank
  from scored s left join around o using (lang, phrase) where place = 1 and (around is null or 100 * around::hugeint < 80 * a::hugeint)
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
""")
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query("op11_small_world", """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, x: a + x) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), placed as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs
)
select query_id, rank, vec_id, score from placed where rank <= 20
""")
def op11_small_world(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return small_world.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)
