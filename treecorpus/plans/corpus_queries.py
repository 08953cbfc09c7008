"""Queries for sources, normalisation, mixing, sampling and corpus I/O."""

from __future__ import annotations

from pyspark.sql import functions as F

from treecorpus.functions import hashing, json_text
from treecorpus.functions.classify import SIDECARS, infer_vendor
from treecorpus.operators import mix, normalize, positions
from treecorpus.plans import inputs
from treecorpus.plans.goal_queries import SURFACE_SQL, surfaces
from treecorpus.plans.inputs import RECORDS_SQL, h_sql, obj, table, text_of
from treecorpus.plans.registry import query
from treecorpus.session import scratch_path, staged_path
from treecorpus.sources import captures, corpus_io

# --- derived files -----------------------------------------------------------------------------


def capture_files(spark, sf):
    """Every document as one captured file: empty, list, truncated, named, unnamed, sidecar."""
    doc = F.col("doc_id")
    body = F.to_json(obj(("@odata.id", text_of("/d/", doc)), ("@odata.type", "#Doc.v1.Doc"), ("Text", F.col("text"))))
    bare = F.to_json(obj(("Text", F.col("text")), ("Lang", F.col("lang"))))
    content = (
        F.when(doc % 6 == 0, " ").when(doc % 6 == 1, "[1, 2]").when(doc % 6 == 2, '{"broken": ')
        .when(doc % 6 == 3, body).otherwise(bare))
    name = F.when(doc % 6 == 5, F.element_at(F.array(*[F.lit(s) for s in SIDECARS]), (doc % 4 + 1).cast("int"))) \
        .otherwise(text_of("_d_", doc, "_", F.col("lang"), ".json"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("cap/"), "source", F.lit("/"), doc.cast("string"), F.lit("/"), name).alias("path"),
        content.alias("content"), "doc_id")


def written(spark, sf, name, files):
    """The files as real files under the shared folder, written once; the folder."""
    return staged_path(spark, name, sf, lambda root: captures.write_files(
        files.withColumn("path", F.concat(F.lit(f"{root}/"), "path"))))


def captured(spark, sf):
    """Records and skipped files of the captured documents, read from files."""
    return captures.read_captures(spark, written(spark, sf, "captures", capture_files(spark, sf)), "docs")


@query("a1_read_captures", """
select case doc_id % 6 when 3 then '/d/'||doc_id else '/d/'||doc_id||'/'||lang end url,
  case doc_id % 6 when 3 then 'odata' else 'filename' end url_from,
  case doc_id % 6 when 3 then '#Doc.v1.Doc' else '' end schema_version, 5 trust, 'docs' corpus_id,
  length(text) n from documents where doc_id % 6 in (3, 4)""")
def a1_read_captures(spark, sf):
    rows, _ = captured(spark, sf)
    return rows.select("url", "url_from", "schema_version", "trust", "corpus_id",
                       F.length(F.get_json_object("body", "$.Text")).cast("bigint").alias("n"))


@query("a2_resolve_url", """
select '/v1/parts/'||p_partkey url, 'odata' url_from, count(*) n from part group by p_partkey
union all select '/x/'||s_nationkey, 'filename', count(*) from supplier group by s_nationkey""")
def a2_resolve_url(spark, sf):
    parts = table(spark, sf, "part").select(
        F.to_json(obj(("@odata.id", text_of("/v1/parts/", F.col("p_partkey"))))).alias("content"),
        F.lit("/c/ignored.json").alias("path"))
    sups = table(spark, sf, "supplier").select(
        F.to_json(obj(("@odata.id", F.when(F.col("s_suppkey") % 2 == 0, "")), ("Name", F.col("s_name"))))
        .alias("content"), text_of("/c/__x_", F.col("s_nationkey"), "_.json").alias("path"))
    rows = captures.captures(parts.unionByName(sups), "mixed")
    return rows.groupBy("url", "url_from").agg(F.count("*").alias("n"))


@query("a3_drop_sidecars", "select count(*) n, 'sidecar' reason from documents where doc_id % 6 = 5")
def a3_drop_sidecars(spark, sf):
    _, skipped = captured(spark, sf)
    return skipped.filter("reason = 'sidecar'").groupBy("reason").agg(F.count("*").alias("n"))


@query("a6_read_tolerant", """
select case doc_id % 6 when 0 then 'empty' when 1 then 'not an object' when 2 then 'malformed' else 'sidecar' end
  reason, count(*) n from documents where doc_id % 6 not in (3, 4) group by 1""")
def a6_read_tolerant(spark, sf):
    _, skipped = captured(spark, sf)
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


@query("a4_sources_from_manifest", """
with c as (
  select s_suppkey k, case when s_suppkey % 5 = 0 then v||'_m'||s_suppkey when s_suppkey % 5 = 1 then 'arch'||s_suppkey
    else 'c'||s_suppkey end corpus_id, v vendor
  from (select s_suppkey, 'n'||s_nationkey v from supplier) where s_suppkey % 3 <> 2)
select corpus_id, corpus_id "source", vendor, '/x/'||k url, 'filename' url_from, case when k % 4 = 0 then 'GET,PATCH' end methods, 0 adapter from c
union all select corpus_id, corpus_id, vendor, '/v1/suppliers/'||k, 'odata', null, 0 from c""")
def a4_sources_from_manifest(spark, sf):
    key = F.col("s_suppkey")
    entry = obj(
        ("id", F.when(key % 5 > 1, text_of("c", key))),
        ("kind", F.when(key % 3 == 0, "full").when(key % 3 == 1, "Dataset").otherwise("raw")),
        ("archive", F.when(key % 5 != 0, text_of("a/b/arch", key, ".tar.gz"))),
        ("vendor", text_of("n", F.col("s_nationkey"))), ("model", text_of("m", key)))
    slug = F.when(key % 5 == 0, text_of("n", F.col("s_nationkey"), "_m", key)).otherwise(text_of("arch", key))
    # Every second corpus lies in a folder of its kind.
    folder = F.concat(F.when(key % 2 == 0, "c/dataset/").otherwise("c/"), slug)
    files = F.array_compact(F.array(
        F.struct(text_of("m/", key, ".json").alias("path"), F.to_json(obj(("corpora", F.array(entry)))).alias("content")),
        F.struct(F.concat(folder, F.lit("/_x_"), key.cast("string"), F.lit(".json")).alias("path"),
                 F.to_json(obj(("Name", F.col("s_name")))).alias("content")),
        F.struct(F.concat(folder, F.lit("/a/own.json")).alias("path"),
                 F.to_json(obj(("@odata.id", text_of("/v1/suppliers/", key)))).alias("content")),
        F.when(key % 4 == 0, F.struct(
            F.concat(folder, F.lit("/rest_api_map.v1.json")).alias("path"),
            F.to_json(obj(("allowed_methods_mapping", F.create_map(text_of("/x/", key), F.array(F.lit("GET"), F.lit("PATCH"))))))
            .alias("content")))))
    root = written(spark, sf, "manifest", table(spark, sf, "supplier").select(F.explode(files).alias("f")).select("f.*"))
    records, _ = captures.sources_from_manifest(spark, f"{root}/m", f"{root}/c")
    return records.select("corpus_id", "source", "vendor", "url", "url_from", F.array_join("allowed_methods", ",").alias("methods"), "adapter")


@query("a5_attach_allowed_methods", f"""with {RECORDS_SQL}
select r.url, r.seq, case when (r.seq//3) % 4 = 0 then ['GET', 'POST'] end allowed_methods from r""")
def a5_attach_allowed_methods(spark, sf):
    url = text_of("/d/", F.floor(F.col("doc_id") / 3))
    maps = table(spark, sf, "documents").filter("doc_id % 3 = 0 and (doc_id div 3) % 4 = 0").select(
        F.lit("m").alias("path"),
        F.to_json(obj(("allowed_methods_mapping", F.create_map(url, F.array(F.lit("GET"), F.lit("POST"))))))
        .alias("content"))
    rows = captures.attach_allowed_methods(inputs.records(spark, sf), captures.method_maps(maps))
    return rows.select("url", "seq", "allowed_methods")


@query("a7_merge_capture_maps", """
with m as (select 'h'||(s_suppkey % 50) host, s_suppkey % 50 ord, s_suppkey k, s_nationkey n from supplier),
newest as (select host, ord, max(k) k, arg_max(n, k) n from m group by all)
select '/u/'||n url, arg_max('/'||host||'/f'||k||'.json', ord) file,
  array_to_string(arg_max(['GET', 'M'||k], ord), ',') methods from newest group by n""")
def a7_merge_capture_maps(spark, sf):
    key, url = F.col("s_suppkey"), text_of("/u/", F.col("s_nationkey"))
    host = text_of("h", key % 50)
    maps = table(spark, sf, "supplier").select(
        host.alias("host"), (key % 50).alias("host_ord"), key.alias("modified"),
        F.to_json(obj(
            ("url_file_mapping", F.create_map(url, text_of("/Users/x/", host, "/f", key, ".json"))),
            ("allowed_methods_mapping", F.create_map(url, F.array(F.lit("GET"), text_of("M", key)))),
        )).alias("content"))
    return captures.merge_capture_maps(maps).withColumn("methods", F.array_join("methods", ","))


def mixed(spark, sf):
    return mix.hash_split(mix.dedup_by_trust(inputs.records(spark, sf)))


MIX_SQL = f"""{RECORDS_SQL},
best as (select url, source, trust, lang, vendor, seq, "method", methods, stype, text, n_chars,
  min(seq) over (partition by url) pos,
  row_number() over (partition by url order by trust desc, seq) rn from r),
d as (select *, case when trust >= 5 and {h_sql("'0:'||url")} < 0.15 then 'eval' else 'train' end split
  from best where rn = 1),
dd as (select *, case trust when 5 then 'REAL' when 4 then 'REPLAY' when 3 then 'SIM_VENDOR'
  when 2 then 'SIM_GENERIC' else 'SIM_DRIFT' end tname from d)
"""


@query("a8_corpus_round_trip", f"""with {MIX_SQL}
select url, seq, split, tname trust_level, upper("method") verb, coalesce(len(methods), 0)::int n_methods, vendor,
  length(text) n from dd""")
def a8_corpus_round_trip(spark, sf):
    path = scratch_path(spark, "corpus")
    rows = mixed(spark, sf)
    corpus_io.write_corpus(
        normalize.normalize_records(rows), mix.mix_manifest(rows, mix.split_policy_id()), path)
    return corpus_io.read_corpus(spark, path).select(
        "url", "seq", "split", "trust_level", F.col("semantics.method").alias("verb"),
        F.size("allowed_methods").alias("n_methods"), "vendor",
        F.length(F.get_json_object("response", "$.Text")).cast("bigint").alias("n"))


@query("a9_goal_surfaces_round_trip", f"""with {SURFACE_SQL}
select family, "mode", kind verifier_kind, count(*) n, count(v) n_values from vsurf group by all""")
def a9_goal_surfaces_round_trip(spark, sf):
    path = scratch_path(spark, "surfaces")
    corpus_io.write_rows(surfaces(spark, sf), path)
    return corpus_io.read_goal_surfaces(spark, path).groupBy("family", "mode", "verifier_kind").agg(
        F.count("*").alias("n"), F.count("target_value").alias("n_values"))


def request_lines(spark, sf):
    """Labelled-request input lines: good, wrapped, blank, broken, lists, wrong types, repeated."""
    doc = F.col("doc_id")
    api = text_of("/d/", F.when(doc % 10 == 9, doc - 9).otherwise(doc))
    row = obj(("rest_api", F.when(doc % 10 != 5, api)),
              ("allowed_methods", F.array(F.lit("get"), F.lit("Post"))),
              ("json", obj(("Lang", F.col("lang")))), ("vendor", F.col("lang")))
    line = (
        F.when(doc % 10 == 1, "  ").when(doc % 10 == 2, "{oops").when(doc % 10 == 3, "[1]")
        .when(doc % 10 == 4, F.to_json(obj(("x", row), ("source_corpus", F.col("source")))))
        .when(doc % 10 == 6, F.to_json(obj(("rest_api", api), ("allowed_methods", "GET"), ("json", obj(("a", "b"))))))
        .when(doc % 10 == 7, F.to_json(obj(("rest_api", api), ("allowed_methods", F.array(F.lit("GET"))),
                                           ("json", "text"))))
        .otherwise(F.to_json(row)))
    return table(spark, sf, "documents").select((doc + 1).alias("line_number"), line.alias("line"))


@query("a10_load_request_records", """
select doc_id + 1 line_number, '/d/'||doc_id rest_api, 'GET,POST' methods, lang vendor,
  case when doc_id % 10 = 4 then source else '' end source_corpus from documents where doc_id % 10 in (0, 4, 8)""")
def a10_load_request_records(spark, sf):
    good, _ = corpus_io.request_records(request_lines(spark, sf))
    return good.select("line_number", "rest_api", F.array_join("allowed_methods", ",").alias("methods"), "vendor",
                       "source_corpus")


@query("a10_request_record_errors", """
select doc_id + 1 line_number, case doc_id % 10 when 2 then 'invalid JSON' when 3 then 'row must be a JSON object'
  when 5 then 'rest_api must be a non-empty string' when 6 then 'allowed_methods must be a list of strings'
  when 7 then 'json must be an object' else 'duplicate rest_api /d/'||(doc_id - 9) end error
from documents where doc_id % 10 in (2, 3, 5, 6, 7, 9)""")
def a10_request_record_errors(spark, sf):
    return corpus_io.request_records(request_lines(spark, sf))[1]


@query("a11_sample_capture_archive", """
select '/p/'||lpad(p_partkey::varchar, 9, '0') url, 'h'||(p_partkey % 3) base,
  case when p_size % 2 = 0 then 'PATCH' else 'GET' end "method",
  case p_partkey % 4 when 0 then 'h'||(p_partkey % 3)||'/f'||p_partkey when 1 then 'h'||(p_partkey % 3)||'/f'||p_partkey
    else 'h'||(p_partkey % 3)||'/deep/f'||p_partkey end member
from part where p_partkey % 4 <> 3 order by base, url limit 100""")
def a11_sample_capture_archive(spark, sf):
    key = F.col("p_partkey")
    base, name = text_of("h", key % 3), text_of("f", key)
    part = table(spark, sf, "part")
    url_files = part.select(
        F.concat(F.lit("/p/"), F.lpad(key.cast("string"), 9, "0")).alias("url"), base.alias("base"),
        F.when(key % 4 == 1, F.concat(F.lit("/Users/x/"), name)).otherwise(name).alias("file"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("patch"), F.lit("GET"))).alias("methods"))
    members = part.filter("p_partkey % 4 <> 3").select(
        base.alias("base"),
        F.when(key % 4 == 2, F.concat_ws("/", base, F.lit("deep"), name)).otherwise(F.concat_ws("/", base, name))
        .alias("member"), F.to_json(obj(("Size", F.col("p_size")))).alias("content"))
    return captures.sample_capture_archive(url_files, members, 100).select("url", "base", "method", "member")


@query("a13_read_run_reports", """
select 'r'||s_suppkey path, 'n'||s_nationkey model, 'loss' metric, s_acctbal "value" from supplier
union all select 'r'||s_suppkey, 'n'||s_nationkey, 'steps', s_suppkey::double from supplier where s_suppkey % 2 = 0""")
def a13_read_run_reports(spark, sf):
    key = F.col("s_suppkey")
    docs = table(spark, sf, "supplier").select(
        text_of("r", key, ".json").alias("path"),
        F.to_json(obj(
            ("manifest", obj(("run_id", text_of("r", key)), ("model", text_of("n", F.col("s_nationkey"))))),
            ("metrics", obj(("loss", F.col("s_acctbal")), ("steps", F.when(key % 2 == 0, key)))),
        )).alias("content"))
    rows = corpus_io.read_run_reports(spark, [f"{written(spark, sf, 'reports', docs)}/*.json"])
    return rows.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("path"), F.col("manifest")["model"].alias("model"), F.explode("metrics").alias("metric", "value"))


def artifacts(spark, sf):
    """Every document as one artifact file, read back."""
    files = table(spark, sf, "documents").select(
        text_of("a", F.col("doc_id") % 10, "/", F.col("doc_id"), ".jsonl").alias("path"), F.col("text").alias("content"))
    return corpus_io.read_artifacts(spark, written(spark, sf, "artifacts", files), "*.jsonl")


@query("a14_artifact_summary", """
select doc_id||'.jsonl' "name", octet_length(encode(text)) bytes,
  len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) "rows", sha256(text) sha256 from documents""")
def a14_artifact_summary(spark, sf):
    return corpus_io.artifact_summary(artifacts(spark, sf))


@query("a15_checksum_audit", """
select doc_id::varchar "name", md5(text) md5, case doc_id % 5 when 0 then 'no matching resource' when 1 then 'skipped'
  when 2 then 'mismatch' else 'ok' end status from documents""")
def a15_checksum_audit(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.col("doc_id").cast("string").alias("name")
    spec = docs.filter("doc_id % 5 <> 0").select(
        name, F.when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 2, "0").otherwise(F.md5("text"))
        .alias("expected_md5"))
    found = artifacts(spark, sf).select(F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("name"), "content")
    return corpus_io.checksum_audit(found, spec)


# --- normalisation -----------------------------------------------------------------------------


@query("b1_compact_resource", f"""with {RECORDS_SQL}
select url, seq, url id, stype "type", 'Lang,Size,Text' keys from r""")
def b1_compact_resource(spark, sf):
    state = normalize.compact_resource(F.col("body"))
    return inputs.records(spark, sf).select(
        "url", "seq", state["id"].alias("id"), state["type"].alias("type"), F.array_join(state["keys"], ",").alias("keys"))


SEMANTICS = """upper("method") verb, upper("method") not in ('GET','HEAD') mutating,
  upper("method") in ('GET','HEAD','PUT','DELETE') idempotent,
  coalesce(list_has_any(list_transform(methods, lambda m: upper(m)), ['POST','PATCH','PUT','DELETE']), false)
  mutable_endpoint"""


@query("b2_normalize_records", f"""with {RECORDS_SQL}
select url, seq, case trust when 5 then 'REAL' when 4 then 'REPLAY' when 3 then 'SIM_VENDOR' when 2 then 'SIM_GENERIC'
  else 'SIM_DRIFT' end trust_level, {SEMANTICS}, 200 expected_status from r""")
def b2_normalize_records(spark, sf):
    rows = normalize.normalize_records(inputs.records(spark, sf))
    s = lambda n, a=None: F.col(f"semantics.{n}").alias(a or n)
    return rows.select("url", "seq", "trust_level", s("method", "verb"), s("mutating"), s("idempotent"),
                       s("mutable_endpoint"), s("expected_status"))


@query("b3_normalize_enriched", """
with k as (select case doc_id % 5 when 0 then '/s/Bios/Settings' when 1 then '/s/bios' when 2 then '/s/bootoptions/'||doc_id
  when 3 then '/s/BootOptions/' else '/s/x' end url, doc_id seq from documents)
select seq, case seq % 5 when 0 then 'bios_pending' when 1 then 'bios' when 2 then 'boot_option'
  when 3 then 'boot_option_collection' else 'other' end resource_kind, true read_only from k""")
def b3_normalize_enriched(spark, sf):
    doc = F.col("seq")
    url = (F.when(doc % 5 == 0, "/s/Bios/Settings").when(doc % 5 == 1, "/s/bios")
           .when(doc % 5 == 2, text_of("/s/bootoptions/", doc)).when(doc % 5 == 3, "/s/BootOptions/").otherwise("/s/x"))
    rows = inputs.records(spark, sf).withColumns({
        "url": url, "method": F.lit("get"), "body": F.to_json(obj(("Text", F.get_json_object("body", "$.Text"))))})
    rows = normalize.normalize_records(rows, enriched=True)
    return rows.select("seq", "semantics.resource_kind", "semantics.read_only")


# The JSON text of a string, all but printable ASCII as escapes.
TEXT_SQL = """case when text is not null then array_to_string(list_transform(regexp_extract_all(to_json(text)::varchar, '(?s).'),
  lambda c: case when unicode(c) between 32 and 126 then c
    when unicode(c) > 65535 then '\\u'||printf('%04x', 55296 + (unicode(c) - 65536) // 1024)
      ||'\\u'||printf('%04x', 56320 + (unicode(c) - 65536) % 1024)
    else '\\u'||printf('%04x', unicode(c)) end), '') end"""


@query("b6_render_prompt_pairs", f"""with {RECORDS_SQL}
select seq, '### REST API'||chr(10)||url||chr(10)||chr(10)||'### Allowed Methods'||chr(10)||
  coalesce(array_to_string(list_transform(methods, lambda m: upper(m)), ', '), 'UNKNOWN')||chr(10)||chr(10)||
  '### Redfish JSON Input'||chr(10)||j||chr(10)||chr(10)||'### Complete Redfish JSON'||chr(10) prompt,
  j||chr(10) completion
from (select *, '{{'||chr(10)||'  "@odata.id": "'||url||'",'||chr(10)||'  "@odata.type": "'||stype||'",'||chr(10)||
  '  "Lang": "'||lang||'",'||chr(10)||'  "Size": '||n_chars||coalesce(','||chr(10)||'  "Text": '||t, '')||chr(10)||'}}' j
  from (select *, {TEXT_SQL} t from r))""")
def b6_render_prompt_pairs(spark, sf):
    return normalize.prompt_pairs(normalize.normalize_records(inputs.records(spark, sf))).select("seq", "prompt", "completion")


@query("b7_render_request_text", f"""with {RECORDS_SQL}
select seq, "method"||' '||url||chr(10)||'{{"@odata.id": "'||url||'", "@odata.type": "'||stype||'", "Lang": "'||lang||
  '", "Size": '||n_chars||coalesce(', "Text": '||t, '')||'}}' "text"
from (select *, {TEXT_SQL} t from r)""")
def b7_render_request_text(spark, sf):
    return normalize.request_text(normalize.normalize_records(inputs.records(spark, sf))).select("seq", "text")


# --- mixing and sampling -----------------------------------------------------------------------


@query("e1_mix_manifest", f"""with {MIX_SQL}
select dimension, key, count(*) n, count(*) filter (split = 'train') n_train, count(*) filter (split = 'eval') n_eval,
  'floor=REAL:frac=0.15:seed=0' policy from (
  select 'source' dimension, source key, split from dd union all select 'trust', tname, split from dd
  union all select 'vendor', coalesce(vendor, 'unknown'), split from dd union all select 'total', '', split from dd)
group by dimension, key""")
def e1_mix_manifest(spark, sf):
    return mix.mix_manifest(mixed(spark, sf), mix.split_policy_id())


@query("f1_dedup_by_trust", f"""with {MIX_SQL} select url, seq, pos, trust, source, length(text) n from d""")
def f1_dedup_by_trust(spark, sf):
    return mix.dedup_by_trust(inputs.records(spark, sf)).select(
        "url", "seq", F.col("pos.seq").alias("pos"), "trust", "source",
        F.length(F.get_json_object("body", "$.Text")).cast("bigint").alias("n"))


@query("f2_first_seen", """select lower(lang) lang, source, min(doc_id) doc_id, arg_min(n_chars, doc_id) n_chars
from documents group by all""")
def f2_first_seen(spark, sf):
    rows = table(spark, sf, "documents").select(F.lower("lang").alias("lang"), "source", "doc_id", "n_chars")
    return mix.first_seen(rows, ["lang", "source"], ["doc_id"])


@query("f4_duplicate_keys", "select md5(text) key, count(*) n from documents group by 1 having count(*) > 1")
def f4_duplicate_keys(spark, sf):
    return mix.duplicate_keys(table(spark, sf, "documents").select(F.md5("text").alias("key")), ["key"])


@query("f6_dense_index", f"""with {RECORDS_SQL},
firsts as (select url, min(seq) first_seq from r group by url)
select url, (row_number() over (order by first_seq) - 1) pos from firsts""")
def f6_dense_index(spark, sf):
    index = positions.dense_index(inputs.records(spark, sf), "url", "seq")
    return index.select("url", F.col("id").alias("pos"))


@query("f6_inverse_index", f"""with {RECORDS_SQL},
firsts as (select url, row_number() over (order by min(seq)) - 1 pos from r group by url)
select event_id, event_id % 1000 id, url from events left join firsts on pos = event_id % 1000""")
def f6_inverse_index(spark, sf):
    """Events that hold an id find its URL."""
    index = positions.dense_index(inputs.records(spark, sf), "url", "seq")
    return table(spark, sf, "events").select("event_id", (F.col("event_id") % 1000).alias("id")).join(index, "id", "left").select("event_id", "id", "url")


@query("f6_one_hot", f"""with {RECORDS_SQL},
kinds as (select source, row_number() over (order by min(seq), source) - 1 pos from r group by source),
hot as (select a.source, list((a.pos = b.pos)::int order by b.pos) one_hot from kinds a, kinds b group by a.source)
select seq, array_to_string(one_hot, '') one_hot from r join hot using (source)""")
def f6_one_hot(spark, sf):
    rows = inputs.records(spark, sf).select("seq", "source")
    index = positions.dense_index(rows, "source", "seq")
    hot = index.select("source", positions.one_hot(F.col("id"), index.count()).alias("one_hot"))
    return rows.join(hot, "source").select("seq", F.array_join("one_hot", "").alias("one_hot"))


@query("g1_hash_split", f"""with {MIX_SQL}
select split, "fraction", count(*) n from (
  select 0.15 "fraction", split from d
  union all select 0.5, case when trust >= 4 and {h_sql("'7:'||url")} < 0.5 then 'eval' else 'train' end from d)
group by all""".replace('select 0.15 "fraction"', 'select 0.15::double "fraction"').replace("select 0.5,", "select 0.5::double,"))
def g1_hash_split(spark, sf):
    rows = mix.dedup_by_trust(inputs.records(spark, sf))
    small = mix.hash_split(rows).withColumn("fraction", F.lit(0.15))
    large = mix.hash_split(rows, 0.5, "REPLAY", 7).withColumn("fraction", F.lit(0.5))
    return small.unionByName(large).groupBy("split", "fraction").agg(F.count("*").alias("n"))


PLACED = "(select *, row_number() over (order by md5('{seed}:'||{key}), {key}) - 1 pos, count(*) over () total from {t})"


@query("g2_seeded_split", f"""
select doc_id, case when pos < floor(total * 0.8) then 'train' else 'rest' end part
from {PLACED.format(seed=3, key='doc_id', t='documents')}""")
def g2_seeded_split(spark, sf):
    return mix.seeded_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.8, 3)


@query("g3_seeded_sample", f"select doc_id, lang from {PLACED.format(seed=5, key='doc_id', t='documents')} where pos < 50")
def g3_seeded_sample(spark, sf):
    return mix.seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50, 5)


@query("g4_sample_contexts", f"""
with p as {PLACED.format(seed=9, key='doc_id', t='documents')},
n as (select count(*) total from documents),
draw as (select o_orderkey candidate,
  floor({h_sql("'9:0:'||o_orderkey")} * total)::bigint a,
  floor({h_sql("'9:1:'||o_orderkey")} * (total - 1))::bigint b0,
  floor({h_sql("'9:2:'||o_orderkey")} * (total - 2))::bigint c0 from orders, n),
d2 as (select *, b0 + (b0 >= a)::int b from draw),
d3 as (select *, c0 + (c0 >= least(a, b))::int c1 from d2),
d4 as (select candidate, a, b, c1 + (c1 >= greatest(a, b))::int c from d3),
asked as (select candidate, 0 slot, a pos from d4 union all select candidate, 1, b from d4
  union all select candidate, 2, c from d4)
select candidate, slot, doc_id from asked join p using (pos)""")
def g4_sample_contexts(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate"))
    docs = table(spark, sf, "documents").select("doc_id")
    return mix.sample_contexts(asked, docs, "doc_id", 3, 9).select("candidate", "slot", "doc_id")


@query("g5_sample_endpoints", f"""
with p as {PLACED.format(seed=2, key='page_id', t='pages')}
select range draw, url from (select range, floor({h_sql("'2:draw:'||range")} * (select count(*) from pages))::bigint pos
  from range(256)) join p using (pos)""")
def g5_sample_endpoints(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return mix.sample_endpoints(pages, "page_id", 256, 2).select("draw", "url")


@query("g6_entry_point", "select arg_min(url, struct_pack(a := length(url), b := page_id)) url from pages")
def g6_entry_point(spark, sf):
    return mix.entry_point(table(spark, sf, "pages").select("url", F.col("page_id").alias("seq")))


@query("h1_union_sources", """
select 'documents' source, 0 adapter, count(*) n, sum(length(text))::bigint chars from documents
union all select 'pages', 1, count(*), sum(length(html))::bigint from pages
union all select 'benchmark', 2, count(*), sum(length(text))::bigint from benchmark""")
def h1_union_sources(spark, sf):
    named = lambda t, c: table(spark, sf, t).select(F.lit(t).alias("source"), F.col(c).alias("text"))
    rows = mix.union_sources([named("documents", "text"), named("pages", "html"), named("benchmark", "text")])
    return rows.groupBy("source", "adapter").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- scalars as table jobs ---------------------------------------------------------------------


@query("k1_unit_hash", f"select page_id, round({h_sql("'4:'||url")}, 9) h from pages")
def k1_unit_hash(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", F.round(hashing.unit_hash(F.col("url"), 4), 9).alias("h"))


@query("k2_content_hash", f"""with {RECORDS_SQL}
select md5('{{"@odata.id":"'||url||'","@odata.type":"'||stype||'","Lang":"'||lang||'","Size":'||n_chars||
  coalesce(',"Text":'||to_json(text)::varchar, '')||'}}')[1:16] digest, count(*) n
from r group by 1""")
def k2_content_hash(spark, sf):
    digest = hashing.text_digest(json_text.compact_json(F.col("body")))
    return inputs.records(spark, sf).groupBy(digest.alias("digest")).agg(F.count("*").alias("n"))


@query("k3_canonical_json", "select event_id, '{\"a\":\"'||event_type||'\",\"k\":'||(props::json->>'k')||'}' j from events")
def k3_canonical_json(spark, sf):
    text = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": "'), F.col("event_type"), F.lit('" }'))
    return table(spark, sf, "events").select("event_id", json_text.compact_json(text).alias("j"))


@query("j16_json_equal", """select count(*) n, count(*) filter (doc_id % 3 = 0)::bigint n_equal from documents""")
def j16_json_equal(spark, sf):
    lang = F.col("lang")
    left = F.to_json(obj(("a", lang), ("b", obj(("x", F.col("n_chars")), ("t", F.col("text"))))))
    right = F.to_json(obj(("b", obj(("t", F.col("text")), ("x", F.col("n_chars")))),
                          ("a", F.when(F.col("doc_id") % 3 == 0, lang).otherwise(F.concat(lang, F.lit("!"))))))
    return table(spark, sf, "documents").agg(
        F.count("*").alias("n"), F.count_if(json_text.json_equal(left, right)).alias("n_equal"))


@query("k15_url_id_collisions", """
with u as (select distinct '/d/'||doc_id||'/'||(doc_id % 9) url from documents),
c as (select url, list_transform(range(length(url)), lambda i: ascii(substr(url, (i+1)::int, 1))) b from u),
s as (select url, (1 + list_sum(b)) % 65521 lo,
  (length(url) + list_sum(list_transform(b, lambda x, i: x * (length(url) - i + 1)))) % 65521 hi from c)
select (hi * 65536 + lo)::bigint url_id, count(*) n, min(url) first_url from s group by 1 having count(*) > 1""")
def k15_url_id_collisions(spark, sf):
    doc = F.col("doc_id")
    urls = table(spark, sf, "documents").select(text_of("/d/", doc, "/", doc % 9).alias("url")).distinct()
    return urls.groupBy(hashing.adler32(F.col("url")).alias("url_id")).agg(
        F.count("*").alias("n"), F.min("url").alias("first_url")).filter("n > 1")


@query("k20_infer_vendor", """
select p_partkey, case p_partkey % 6 when 0 then 'dell' when 1 then 'hpe' when 2 then 'supermicro' when 3 then 'hpe'
  when 4 then 'dell' else '' end vendor from part""")
def k20_infer_vendor(spark, sf):
    key = F.col("p_partkey")
    root = F.element_at(F.array(*[F.lit(p) for p in (
        "/data/idrac_fixtures", "/data/ILO", "/x/supermicro-a", "/x/hpe_b/dells", "/x/Dell_9/hpe", "/x/delly")]),
        (key % 6 + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", infer_vendor(F.concat(root, F.lit("/run"), key.cast("string"))).alias("vendor"))
