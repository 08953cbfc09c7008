"""Queries for vocabulary, scans, prompts, fleet reports and streams."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from treecorpus.functions import goal_ids as g
from treecorpus.functions.classify import SIDECARS
from treecorpus.operators import fleet, goals, json_walk as walk, mix, slots, vocabulary
from treecorpus.plans import corpus_queries, inputs, learn_queries as learn
from treecorpus.plans.goal_queries import FACT_SQL, surfaces, SURFACE_SQL
from treecorpus.plans.inputs import TREE_SQL, obj, table, text_of
from treecorpus.plans.registry import query
from treecorpus.plans.tree_queries import full, full_where
from treecorpus.session import scratch_path, staged
from treecorpus.sources import capture_stream, captures
from treecorpus.streaming import enum_index, folds

# --- vocabulary and scans ----------------------------------------------------------------------


@query("e18_vocabulary", f"""with {TREE_SQL},
c as (select * from cus where c_acctbal >= 0),
v as (
  select 'type' kind, rtype token from rec where rtype <> ''
  union select 'api_target', url from rec
  union select 'api_target', '/v1/parts/'||arg_max(l_partkey, seq) from lin group by url
  union select 'api_target', '/v1/suppliers/'||arg_max(l_suppkey, seq)||'/' from lin group by url
  union select 'target', url||'/Actions/ComputerSystem.Reset' from c
  union select 'target', url||'/Actions/ComputerSystem.Ping' from c
  union select 'action', unnest(['ComputerSystem.Reset', 'ComputerSystem.Ping']) where exists (from c)
  union select 'target_name', 'Actions' where exists (from c)
  union select 'primary_action', unnest(['#ComputerSystem.Reset', '#ComputerSystem.Ping']) where exists (from c)
  union select 'allowable_key', 'BootSourceOverrideTarget@Redfish.AllowableValues' where exists (from cus)
  union select 'allowable_key', 'ResetType@Redfish.AllowableValues' where exists (from c)
  union select 'allowable_value', unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) where exists (from cus)
  union select 'allowable_value', unnest(['On','ForceOff','GracefulRestart']) where exists (from c)
  union select 'attribute_key', unnest(['Brand','Size','AttributeName','Type','ReadOnly','CurrentValue','Value','ValueName'])
    where exists (from part)
  union select 'attribute_value', unnest([p_brand, p_size::varchar, 'Size', 'Integer', 'False', 'Brand'||p_size,
    'Enumeration', case when p_size % 2 = 0 then 'True' else 'False' end, 'Other']) from part)
select kind, token from v""")
def e18_vocabulary(spark, sf):
    """The tokens, staged: most are as many as the URLs, so they are made distinct in parts that grow with the input."""
    def tokens():
        leaves = walk.json_walk(full(spark, sf), carry=(), keep=vocabulary.may_speak, fields=vocabulary.FIELDS)
        return vocabulary.vocabulary(leaves)

    return staged(spark, "vocabulary", sf, tokens)


@query("c8_drop_volatile_names", """
select page_id, u from (select page_id, case page_id % 4 when 0 then url||'.'||page_id when 1 then 'JID_'||page_id
  else url end u from pages) where not regexp_matches(u, '\\.\\d+$') and u not like '%JID\\_%' escape '\\'""")
def c8_drop_volatile_names(spark, sf):
    page = F.col("page_id")
    name = F.when(page % 4 == 0, text_of(F.col("url"), ".", page)).when(page % 4 == 1, text_of("JID_", page)).otherwise(
        F.col("url"))
    rows = table(spark, sf, "pages").select("page_id", name.alias("u"))
    return rows.filter(vocabulary.drop_volatile(F.col("u")))


RULES = [("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), ("mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"),
         ("trailer", "(?i)co-authored-by:"), ("the", r"(?i)\bthe\b"), ("host", r"https?://[a-z0-9.-]+")]


@query("c9_scan_patterns", """
with d as (select doc_id, text from documents where lang <> 'de'),
m as (select doc_id, rule, case rule
  when 'ip' then regexp_extract(text, '(\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b)', 1)
  when 'mail' then regexp_extract(text, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1)
  when 'trailer' then regexp_extract(text, '((?i)co-authored-by:)', 1)
  when 'the' then regexp_extract(text, '((?i)\\bthe\\b)', 1)
  else regexp_extract(text, '(https?://[a-z0-9.-]+)', 1) end match
  from d, (select unnest(['ip', 'mail', 'trailer', 'the', 'host']) rule))
select doc_id, rule, match from m where match <> ''""")
def c9_scan_patterns(spark, sf):
    return vocabulary.scan_patterns(
        table(spark, sf, "documents"), RULES, "doc_id", "text", exempt=F.col("lang") == "de")


@query("b14_expand_action_prompts", """
with p as (select p_partkey, p_brand, p_type, p_size from part),
s as (select p_partkey, 'ResetType '||unnest(['On', 'Off']) setting from p
  union all select p_partkey, 'Delay '||unnest([p_size::varchar, '0', p_brand]) from p where p_size % 2 = 0),
c as (select p_partkey, 'ResetType '||a||', Delay '||b setting from p, (select unnest(['On', 'Off']) a),
  lateral (select unnest([p_size::varchar, '0', p_brand]) b) where p_size % 2 = 0)
select p_partkey action, setting, count(*) n from (select * from s union all select * from c) group by all""")
def b14_expand_action_prompts(spark, sf):
    size = F.col("p_size")
    one = F.struct(F.lit("ResetType").alias("name"), F.array(F.lit("On"), F.lit("Off")).alias("values"))
    two = F.struct(F.lit("Delay").alias("name"),
                   F.array(size.cast("string"), F.lit("0"), F.col("p_brand")).alias("values"))
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("action"), F.when(size % 2 == 0, F.array(one, two)).otherwise(F.array(one))
        .alias("parameters"))
    return vocabulary.action_prompts(rows).groupBy("action", "setting").agg(F.count("*").alias("n"))


@query("b14_prompt_rows", """
with p as (select p_partkey::varchar a, p_brand b, p_size z from part),
one as (select a, 'ResetType' n, unnest(['On', 'Off']) v from p where z % 5 <> 0
  union all select a, 'Delay', unnest([z::varchar, '0', b]) from p where z % 5 <> 0),
two as (select a, (i - 1) * 3 + j - 1 number, ['On', 'Off'][i] x, [z::varchar, '0', b][j] y
  from p, (select unnest([1, 2]) i), (select unnest([1, 2, 3]) j) where z % 5 <> 0),
said as (select a, null::bigint number, ' with '||n||' '||v ahead, '{"'||n||'": "'||v||'"}' held, ' with '||n||' '||v given from one
  union all select a, number, replace(' with  {~ResetType~: ~'||x||'~, ~Delay~: ~'||y||'~}', '~', chr(39)), '{"ResetType": "'||x||'", "Delay": "'||y||'"}',
    ' with ResetType'||x||', Delay'||y from two)
select a "action", number, 'Input: set '||a||ahead||'. Goal: '||a||' Parameter: '||held||'.<|endoftext|>' prompt, 'Goal: '||a||' Parameter: '||held goal,
  'Input: set '||a||given||'.' input from said
union all select a, null, 'Input: set '||a||'. Goal: '||a||' Parameter: [].<|endoftext|>', 'Goal: set Parameter: [].', 'Input: set '||a||'.' from p where z % 5 = 0""")
def b14_prompt_rows(spark, sf):
    parameter = lambda name, *values: F.struct(F.lit(name).alias("name"), F.array(*values).alias("values"))
    two = F.array(parameter("ResetType", F.lit("On"), F.lit("Off")), parameter("Delay", F.col("p_size").cast("string"), F.lit("0"), F.col("p_brand")))
    rows = table(spark, sf, "part").select(F.lit("set").alias("action_type"), F.col("p_partkey").cast("string").alias("action"),
                                           F.when(F.col("p_size") % 5 != 0, two).otherwise(F.slice(two, 1, 0)).alias("parameters"))
    return vocabulary.prompt_rows(rows)


@query("b16_paraphrase_prompt", f"""with {SURFACE_SQL},
goal as (select distinct goal_id, family, rt, case when "mode" = 'state' then path else '' end path, v, t from surf)
select goal_id, path property_path, v target_value, family <> 'boot' has_rule,
  case when t = 'string' and not regexp_full_match(v, '[A-Za-z0-9_ -]{{1,64}}') then '<redacted-string>' else v end shown
from goal""")
def b16_paraphrase_prompt(spark, sf):
    wanted = surfaces(spark, sf).select(
        "goal_id", "family", "resource_type", "property_path", "target_value", "target_type").distinct()
    rows = goals.paraphrase_prompt(wanted, 8, F.when(F.col("family") == "boot", F.lit('["g1>g2:before"]')))
    shown = F.get_json_object(F.regexp_extract("prompt", r"(?s)Atomic sub-goals:\n(.*)\n\nDependency", 1), "$[0].target_value")
    return rows.select("goal_id", "property_path", "target_value",
                       F.col("prompt").contains("Do not add ordering words").alias("has_rule"),
                       shown.alias("shown"))


@query("b17_preference_rows", """
select a.conv_id, a.turn, length(a.text) n_prompt, length(b.text) n_chosen, length(b.text) // 2 n_rejected
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def b17_preference_rows(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("index", F.struct("conv_id", "turn"))
    prompts = turns.select("index", F.col("text").alias("prompt"))
    reply = table(spark, sf, "conversations").select(
        F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("index"), F.col("text").alias("chosen"))
    worse = reply.select("index", F.expr("substring(chosen, 1, cast(length(chosen) div 2 as int))").alias("rejected"))
    rows = vocabulary.preference_rows(prompts, reply, worse, "index")
    n = lambda c: F.length(c).cast("bigint")
    return rows.select("index.conv_id", "index.turn", n("prompt").alias("n_prompt"), n("chosen").alias("n_chosen"),
                       n("rejected").alias("n_rejected"))


@query("k5_words", """
select p_partkey, trim(lower(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
  '[^A-Za-z0-9]+', ' ', 'g'))) words, trim(regexp_replace('  '||p_name||'   '||p_brand||' ', '\\s+', ' ', 'g')) squashed
from (select *, 'Boot.Source'||replace(p_brand, '#', 'Override')||'@x'||p_type w from part)""")
def k5_words(spark, sf):
    name = F.concat(F.lit("Boot.Source"), F.replace("p_brand", F.lit("#"), F.lit("Override")), F.lit("@x"), "p_type")
    spaced = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))
    return table(spark, sf, "part").select(
        "p_partkey", g.words(name).alias("words"), g.squash_space(spaced).alias("squashed"))


@query("k4_goal_id_parts", """
select doc_id, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'empty') part,
  case when regexp_full_match(text, '[A-Za-z0-9_ -]{1,64}') then trim(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '_')
  else 'value' end value_id from documents""")
def k4_goal_id_parts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", g.id_part(F.col("text")).alias("part"),
        g.goal_value_id(F.col("text"), F.lit("string")).alias("value_id"))


@query("k8_json_type", """
select case k when 0 then 'null' when 1 then 'boolean' when 2 then 'integer' when 3 then 'number' when 4 then 'object'
  when 5 then 'array' else 'string' end json_type, count(*) n from (select event_id % 7 k from events) group by 1""")
def k8_json_type(spark, sf):
    eid = F.col("event_id")
    value = (
        F.when(eid % 7 == 0, "null").when(eid % 7 == 1, "true").when(eid % 7 == 2, eid.cast("string"))
        .when(eid % 7 == 3, "0.5").when(eid % 7 == 4, F.col("props")).when(eid % 7 == 5, F.lit("[1]"))
        .otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))))
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"v": '), value, F.lit("}")).alias("body"))
    leaves = walk.json_walk(rows, carry=("event_id",), keys=("v",))
    return leaves.groupBy("json_type").agg(F.count("*").alias("n"))


@query("h4_goal_set_equal", """
with t as (select o_orderkey, trim(lower(regexp_replace('Set  '||o_orderpriority||' ', '\\s+', ' ', 'g'))) x, o_custkey c,
  o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0 good from orders),
f as (select c, x, arg_min(good, o_orderkey) good, min(o_orderkey) k from t group by all)
select k o_orderkey, c o_custkey from f where good""")
def h4_goal_set_equal(spark, sf):
    from treecorpus.operators.judge import set_match

    key, pri = F.col("o_orderkey"), F.col("o_orderpriority")
    text = g.squash_space(F.concat(F.lit("Set  "), pri, F.lit(" ")))
    ids = lambda odd: F.when(odd, F.array(F.lit("g2"))).otherwise(F.array(F.lit("g2"), F.lit("g1")))
    edges = F.when(key % 4 == 0, F.array(F.lit("g2>g1:before"))).otherwise(F.array(F.lit("g1>g2:before")))
    rows = table(spark, sf, "orders").select(
        "o_custkey", F.lower(text).alias("seen"), key, ids(key % 3 == 0).alias("found"), edges.alias("found_edges"))
    first = mix.first_seen(rows, ["o_custkey", "seen"], ["o_orderkey"])
    expected, expected_edges = F.array(F.lit("g1"), F.lit("g2")), F.array(F.lit("g1>g2:before"))
    return first.filter(set_match(F.col("found"), expected) & set_match(F.col("found_edges"), expected_edges)).select(
        "o_orderkey", "o_custkey")


# --- fleet reports -----------------------------------------------------------------------------

HEALTH_SQL = f"""{FACT_SQL},
res as (select host, kind class, case when kind in ('customer', 'line') then f.v end h from (select distinct url, host, kind
  from rec) r left join (select url, v from fact where path = 'Status.Health') f using (url))
"""


def resources(spark, sf):
    return full(spark, sf).select("host", F.col("source").alias("class"), "body")


@query("m1_health_rollup", f"""with {HEALTH_SQL},
s as (select *, case h when 'OK' then 0 when 'Warning' then 1 when 'Critical' then 2 end r from res)
select host, count(*) n, max(r)::int worst_rank, count(*) filter (h is null) n_without_status,
  (2 - max((class = 'customer')::int) - max((class = 'order')::int))::int n_missing_classes,
  coalesce(max(r) < 2, true) passed from s group by host""")
def m1_health_rollup(spark, sf):
    return fleet.health_rollup(resources(spark, sf), ["customer", "order"])


@query("m1_class_health", f"""with {HEALTH_SQL}
select class, coalesce(h, 'missing') health, count(*) n from res group by all""")
def m1_class_health(spark, sf):
    return fleet.class_health(resources(spark, sf))


@query("m2_fleet_predicate", f"""with {TREE_SQL}
select url, host, coalesce((c_acctbal >= 0)::int + (c_mktsegment = 'BUILDING')::int, 0)::bigint n_held,
  coalesce(c_acctbal >= 0 and c_mktsegment = 'BUILDING', false) done from (select distinct url, host from rec) left join cus using (url)""")
def m2_fleet_predicate(spark, sf):
    nodes = full_where(spark, sf, "power", walk.mentions("PowerState", "BootSourceOverrideTarget"), all_urls=True)
    wanted = spark.createDataFrame(
        [("PowerState", "On"), ("Boot.BootSourceOverrideTarget", "BUILDING")], "path string, value string")
    leaves = walk.json_walk(nodes, carry=("host", "url"), keys=("PowerState", "BootSourceOverrideTarget"), fields=("path", "value"))
    return fleet.fleet_predicate(leaves, wanted, nodes, by=["host"])


@query("m3_log_archive_since", """
select event_type, count(*) n, min(ts) first_ts, max(ts) last_ts from events where ts >= timestamp '2024-01-15' group by 1""")
def m3_log_archive_since(spark, sf):
    return fleet.log_archive_since(table(spark, sf, "events"), "2024-01-15", ["event_type"])


# --- streams -----------------------------------------------------------------------------------


@query("s1_stream_card_tallies", f"""with {learn.TALLY_SQL}
select *, case when contradictions > confirmations then 'contradicted' when confirmations > 0 then 'grounded'
  else 'provisional' end status from tally""")
def s1_stream_card_tallies(spark, sf):
    from treecorpus.operators import cards

    claims = cards.induce_cards(learn.learned(spark, sf))
    return folds.card_tallies(spark, claims, learn.as_observations(folds.stream_table(spark, sf, "events")))


ENUM_SQL = """
with brand as (select 'Brand'||p_size "name", arg_min(p_brand, p_partkey) b from part where p_size % 2 = 1 group by p_size)
select 'PATCH' "schema", 'Size' "name", 'integer' "type", false required, null::varchar choices, 'registry' extracted_from where exists (from part)
union all select 'PATCH', "name", 'string', false, b||',Other', 'registry' from brand
union all select 'PATCH', 'BootSourceOverrideTarget', 'string', false, 'AUTOMOBILE,BUILDING,FURNITURE,HOUSEHOLD,MACHINERY', 'inline' where exists (from customer)
union all select 'POST', 'ResetType', 'string', true, 'On,Off', 'action_info' where exists (from supplier)
union all select distinct 'POST', 'Delay'||s_nationkey, 'integer', false, null, 'action_info' from supplier
"""


def tree_stream(spark, sf):
    """The captures of the whole resource tree as a stream of many micro-batches."""
    folder = inputs.tree_path(spark, sf)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


@query("s2_stream_enum_index", ENUM_SQL)
def s2_stream_enum_index(spark, sf):
    index = enum_index.enum_index(spark, tree_stream(spark, sf).select("url", "trust", "seq", "body"))
    return index.withColumn("choices", F.array_join("choices", ","))


@query("s3_stream_replay", """
select event_id, event_type, age::int age from (select *, row_number() over (partition by event_type
  order by ts desc, event_id desc) age from events) where age <= 100""")
def s3_stream_replay(spark, sf):
    events = folds.stream_table(spark, sf, "events").select("event_id", "event_type", "ts")
    return folds.replay(spark, events, "event_type", ["ts", "event_id"], 100).select("event_id", "event_type", "age")


@query("s4_stream_judge_counters", f"""with {learn.COUNTER_SQL} select event_type, {', '.join(learn.COUNTERS)} from cr""")
def s4_stream_judge_counters(spark, sf):
    drafts = learn.as_drafts(folds.stream_table(spark, sf, "events"))
    return folds.judge_counters(spark, drafts, ["event_type"]).select("event_type", *learn.COUNTERS)


SESSION_SQL = """
e as (select user_id, ts, case when event_type = 'purchase' then 1.0 else 0.1 end::double reward from events),
g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end b
  from e),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) sid from g),
sess as (select user_id, min(ts) "start", max(ts) + interval 30 minute "end", sum(reward) total, count(*) n_steps
  from s group by user_id, sid)
"""


@query("s5_stream_episode_returns", f"""with {SESSION_SQL}
select user_id, "start", round(total, 6) total, n_steps from sess
where "end" <= (select date_trunc('millisecond', max(ts)) - interval 1 hour from events)""")
def s5_stream_episode_returns(spark, sf):
    events = folds.stream_table(spark, sf, "events").select(
        "user_id", "ts", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.1).alias("reward"))
    return folds.episode_returns(spark, events, "user_id", "30 minutes", "1 hour").select(
        "user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("total", 6).alias("total"), "n_steps")


@query("s6_stream_ingest", """
select '/u/'||user_id url, arg_min(event_id, ts::varchar||lpad(event_id::varchar, 20, '0')) event_id,
  arg_min(props, ts::varchar||lpad(event_id::varchar, 20, '0')) body from events where event_id % 9 <> 0 group by user_id""")
def s6_stream_ingest(spark, sf):
    events = folds.stream_table(spark, sf, "events").select(
        "ts", "event_id", text_of("/u/", F.col("user_id"), "/").alias("url"), F.col("props").alias("body"),
        F.when(F.col("event_id") % 9 == 0, text_of("/cap/", F.lit(SIDECARS[0]))).otherwise("/cap/body.json").alias("path"))
    return folds.ingest(spark, events, ["ts", "event_id"]).select("url", "event_id", "body")


@query("s6_stream_ingest_folder", """
select coalesce(reason, 'kept') state, url, url_from, count(*) n from (
  select case doc_id % 6 when 0 then 'empty' when 1 then 'not an object' when 2 then 'malformed' when 5 then 'sidecar' end reason,
    case doc_id % 6 when 3 then '/d/'||doc_id when 4 then '/d/'||doc_id||'/'||lang end url,
    case doc_id % 6 when 3 then 'odata' when 4 then 'filename' end url_from from documents) group by all""")
def s6_stream_ingest_folder(spark, sf):
    """Every document as a captured file, in two lots written while the stream is followed."""
    files, at = corpus_queries.capture_files(spark, sf), scratch_path(spark, "ingest")
    for lot in (0, 1):
        captures.write_files(files.filter(F.col("doc_id") % 2 == lot).withColumn("path", F.concat(F.lit(f"{at}/in/"), "path")))
        time.sleep(0.5)
        records, skipped = capture_stream.ingest_folder(spark, f"{at}/in", f"{at}/done", "docs", settle=0.2)
    rows = records.select(F.lit("kept").alias("state"), "url", "url_from").unionByName(
        skipped.select(F.col("reason").alias("state"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("url_from")))
    return rows.groupBy("state", "url", "url_from").agg(F.count("*").alias("n"))
