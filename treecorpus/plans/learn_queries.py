"""Queries for contracts, judged drafts, tokens, cards, transitions and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from treecorpus.functions import hashing
from treecorpus.operators import cards, contracts, encoder, json_walk, judge, metrics, mix, ranking, rl, tokens, tree
from treecorpus.plans import inputs
from treecorpus.plans.eval_queries import rounded, rounded_sql
from treecorpus.plans.inputs import TREE_SQL, h_sql, md5_fraction, obj, table, text_of
from treecorpus.plans.registry import query
from treecorpus.plans.tree_queries import CANDIDATE_SQL, REFS_SQL, crawled, full_where, tree_candidates
from treecorpus.session import scratch_path, staged

# --- request and call rows ---------------------------------------------------------------------


def request_labels(spark, sf):
    """The labels, staged: building call rows looks at them several times."""
    return staged(spark, "labels", sf, lambda: build_request_labels(spark, sf))


def build_request_labels(spark, sf):
    """First capture of each line of an order: the order asks for the line's part."""
    first = mix.first_seen(
        inputs.line_captures(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_seq", "l_returnflag",
                                       F.col("l_quantity").cast("int").alias("qty")),
        ["o_orderkey", "l_linenumber"], ["l_seq"])
    return first.select(F.col("o_orderkey").alias("row_id"), F.col("l_linenumber").alias("pos"),
                        text_of("/v1/parts/", F.col("l_partkey")).alias("rest_api"), "l_returnflag", "qty", "l_partkey")


def request_contexts(spark, sf, labels=None):
    """Each asked part with its methods; every 97th part is missing, every 101st is there twice."""
    size, key = F.col("p_size"), F.col("p_partkey")
    methods = (
        F.when(size % 4 == 0, F.array(F.lit("get"), F.lit("PATCH")))
        .when(size % 4 == 1, F.array(F.lit("patch"), F.lit("POST")))
        .when(size % 4 == 2, F.array(F.lit("HEAD"), F.lit("get"))).otherwise(F.array(F.lit("post"))))
    parts = table(spark, sf, "part").select(
        text_of("/v1/parts/", key).alias("rest_api"), methods.alias("allowed_methods"),
        F.when(key % 97 == 0, 0).when(key % 101 == 0, 2).otherwise(1).alias("copies"))
    asked = (labels if labels is not None else request_labels(spark, sf)).select("row_id", "rest_api").distinct()
    rows = asked.join(parts, "rest_api").filter("copies > 0")
    return rows.select("row_id", "rest_api", "allowed_methods", F.explode(
        F.array_repeat(F.lit(1), F.col("copies"))).alias("one")).drop("one")


LABEL_SQL = f"""{TREE_SQL},
lab as (select l_orderkey row_id, l_linenumber pos, arg_min(l_partkey, seq) pk, arg_min(l_returnflag, seq) rf,
  arg_min(l_quantity::int, seq) qty from lin group by all),
labp as (select lab.*, '/v1/parts/'||pk rest_api, case p_size % 4 when 0 then ['GET','PATCH'] when 1 then ['PATCH','POST']
  when 2 then ['HEAD','GET'] else ['POST'] end allowed, p_size % 4 m4 from lab join part on pk = p_partkey),
viol as (select distinct row_id, rest_api, case when pk % 97 = 0 then 'rest_api not present in current context'
  else 'duplicate rest_api in context' end problem from labp where pk % 97 = 0 or pk % 101 = 0)
"""


@query("d6_require_context", f"with {LABEL_SQL} select row_id, rest_api, problem from viol")
def d6_require_context(spark, sf):
    labels = request_labels(spark, sf)
    return contracts.context_violations(labels, request_contexts(spark, sf, labels))


def requests(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"),
                                             text_of("order ", F.col("o_orderkey")).alias("text"))


@query("b8_build_list_rows", f"""with {LABEL_SQL}
select row_id, 'order '||row_id "text", string_agg(rest_api, ',' order by pos) rest_api_list,
  count(distinct rest_api)::int n_contexts from labp where row_id not in (select row_id from viol) group by row_id""")
def b8_build_list_rows(spark, sf):
    labels = request_labels(spark, sf)
    rows = contracts.build_list_rows(requests(spark, sf), labels, request_contexts(spark, sf, labels))
    return rows.select("row_id", "text", F.array_join("rest_api_list", ",").alias("rest_api_list"),
                       F.size("allowed_methods").alias("n_contexts"))


def expected_calls(spark, sf):
    """The call rows, staged: scores, alignments and renderings start from them."""
    return staged(spark, "call-rows", sf, lambda: build_expected_calls(spark, sf))


def build_expected_calls(spark, sf):
    labels = request_labels(spark, sf)
    contexts = request_contexts(spark, sf, labels).distinct()
    explicit = labels.filter("l_returnflag = 'A'").groupBy("row_id", "rest_api").agg(
        F.lit("patch").alias("method"), F.to_json(F.struct(F.min("qty").alias("q"))).alias("arguments"))
    return contracts.call_rows(labels, contexts, explicit)


CALL_SQL = f"""{LABEL_SQL},
expl as (select row_id, rest_api, min(qty) q from labp where rf = 'A' group by all),
callx as (select l.row_id, l.pos, l.rest_api, l.allowed, m4,
  case when e.q is not null then 'PATCH' when m4 in (0, 2) then 'GET' else allowed[1] end "method", e.q
  from labp l left join expl e using (row_id, rest_api) where pk % 97 <> 0),
call as (select *, case when "method" in ('GET','HEAD') or q is null then '{{}}' else '{{"q":'||q||'}}' end arguments,
  case when not list_contains(allowed, "method") then 'method '||"method"||' is not in allowed_methods for '||rest_api
  end error from callx)
"""


@query("b9_build_call_rows", f"""with {CALL_SQL}
select row_id, pos, rest_api, "method", arguments, error from call""")
def b9_build_call_rows(spark, sf):
    return expected_calls(spark, sf).select("row_id", "pos", "rest_api", "method", "arguments", "error")


@query("b11_inference_handoff", f"""with {CALL_SQL}
select row_id, 'order '||row_id "text", count(*)::int n_goals, string_agg("method", ',' order by pos) methods
from call group by row_id having count(error) = 0""")
def b11_inference_handoff(spark, sf):
    rows = requests(spark, sf).join(contracts.collect_calls(expected_calls(spark, sf)), "row_id")
    out = contracts.inference_handoff(rows)
    return out.select("row_id", "text", F.size("ordered_goals").alias("n_goals"),
                      F.array_join(F.transform("ordered_goals", lambda c: c["method"]), ",").alias("methods"))


def of_source(spark, sf, source):
    """The last captures that come from one source."""
    return full_where(spark, sf, f"source-{source}", F.col("source") == source).filter(F.col("source") == source)


def list_rows(spark, sf):
    """List rows with the bodies of all their contexts, staged: bodies are joined and grouped in parts that grow with the input."""
    return staged(spark, "list-rows", sf, lambda: build_full_list_rows(spark, sf))


def build_full_list_rows(spark, sf):
    labels = request_labels(spark, sf)
    contexts = request_contexts(spark, sf, labels)
    rows = contracts.build_list_rows(requests(spark, sf), labels, contexts)
    bodies = of_source(spark, sf, "part").select(F.col("url").alias("rest_api"), "body")
    shown = contexts.select("row_id", "rest_api").distinct().join(bodies, "rest_api")
    return rows.join(contracts.context_json(shown), "row_id")


PROMPT_SQL = f"""{CALL_SQL},
rows as (from labp where row_id not in (select row_id from viol)),
shown as (select row_id, '['||chr(10)||string_agg(replace('  {{~    "@odata.id": "'||rest_api||'",~    "@odata.type": "#Bios.v1.Bios",~    "Attributes": {{~      "Brand": "'
    ||p_brand||'",~      "Size": '||p_size||'~    }},~    "Name": "'||p_name||'",~    "SerialNumber": "SN'||pk||'"~  }}', '~', chr(10)), ','||chr(10) order by rest_api)||chr(10)||']' json,
  '{{'||chr(10)||string_agg(replace('  "'||rest_api||'": [~    "'||array_to_string(allowed, '",~    "')||'"~  ]', '~', chr(10)), ','||chr(10) order by rest_api)||chr(10)||'}}' methods
  from (select distinct row_id, rest_api, pk, allowed from rows) join part on p_partkey = pk group by row_id),
lists as (select row_id, string_agg('"'||rest_api||'"', ',' order by pos) items, replace('[~  '||string_agg('"'||rest_api||'"', ',~  ' order by pos)||'~]', '~', chr(10)) list,
  replace('{{~  "rest_api_list": [~    '||string_agg('"'||rest_api||'"', ',~    ' order by pos)||'~  ]~}}', '~', chr(10)) target from rows group by row_id),
calls as (select row_id, replace('{{~  "calls": [~'||string_agg('    {{~      "allowed_methods": [~        "'||array_to_string(allowed, '",~        "')||'"~      ],~      "arguments": '
  ||case when arguments = '{{}}' then arguments else '{{~        "q": '||q||'~      }}' end||',~      "method": "'||"method"||'",~      "rest_api": "'||rest_api||'"~    }}', ',~' order by pos)
  ||'~  ]~}}', '~', chr(10)) target from call group by row_id having count(error) = 0)
"""


@query("b10_render_contract_rows", f"""with {PROMPT_SQL}
select row_id, replace('### Operator Text~order '||row_id||'~~### Current Redfish JSON~', '~', chr(10))||json||replace('~~### Allowed Methods~', '~', chr(10))||methods
  ||replace('~~### Ordered REST API List~', '~', chr(10)) prompt, length(prompt)::int target_char_start, target target_json from lists join shown using (row_id)""")
def b10_render_contract_rows(spark, sf):
    return contracts.render_list_rows(list_rows(spark, sf)).select("row_id", "prompt", "target_json", "target_char_start")


@query("b10_render_call_rows", f"""with {PROMPT_SQL}
select row_id, replace('### Operator Text~order '||row_id||'~~### Ordered REST API List~', '~', chr(10))||list||replace('~~### Current Redfish JSON~', '~', chr(10))||json
  ||replace('~~### Allowed Methods~', '~', chr(10))||methods||replace('~~### Ordered REST Calls~', '~', chr(10)) prompt, length(prompt)::int target_char_start, c.target target_json
from lists join shown using (row_id) join calls c using (row_id)""")
def b10_render_call_rows(spark, sf):
    rows = staged(spark, "list-call-rows", sf, lambda: list_rows(spark, sf).join(contracts.collect_calls(expected_calls(spark, sf)), "row_id"))
    return contracts.render_call_rows(rows).select("row_id", "prompt", "target_json", "target_char_start")


@query("b11_minimal_next_phase", f"""with {PROMPT_SQL}
select row_id, 'order '||row_id "text", replace(items, '"', '') rest_api_list, (select count(distinct rest_api) from rows r where r.row_id = l.row_id)::int n_bodies,
  (select count(distinct rest_api) from rows r where r.row_id = l.row_id)::int n_methods from lists l""")
def b11_minimal_next_phase(spark, sf):
    rows = contracts.minimal_next_phase(list_rows(spark, sf))
    return rows.select("row_id", "text", F.array_join("rest_api_list", ",").alias("rest_api_list"),
                       F.json_array_length("json").alias("n_bodies"), F.size("allowed_methods").alias("n_methods"))


def predicted_calls(spark, sf):
    """Predictions: some right, some with the last call dropped, some broken."""
    rows = contracts.collect_calls(expected_calls(spark, sf))
    typed = lambda calls: F.transform(calls, lambda c: F.struct(
        c["rest_api"].alias("rest_api"), F.transform(c["allowed_methods"], F.lower).alias("allowed_methods"),
        c["method"].alias("method"), F.parse_json(c["arguments"]).alias("arguments")))
    row = F.col("row_id")
    calls = F.when(row % 5 == 0, F.slice("calls", F.lit(1), F.size("calls") - 1)).otherwise(F.col("calls"))
    good = F.to_json(F.struct(F.struct(typed(calls).alias("calls")).alias("y_pred")))
    raw = (
        F.when(row % 5 == 1, "not json").when(row % 5 == 2, '{"calls": {}}')
        .when(row % 5 == 3, '{"calls": [{"rest_api": "/x", "allowed_methods": ["GET"], "method": "PUT", "arguments": {}}]}')
        .otherwise(good))
    return rows.select("row_id", raw.alias("raw"))


EVAL_SQL = f"""{CALL_SQL},
okrow as (select row_id, count(*) n, count(*) filter ("method" in ('GET','HEAD')) nr,
  arg_max("method", pos) in ('GET','HEAD') last_read from call group by row_id having count(error) = 0),
perr as (select *, case row_id % 5 when 1 then 'invalid_json' when 2 then 'y_pred.calls must be a list'
  when 3 then 'y_pred.calls.method PUT is not in allowed_methods for /x' end parse_error from okrow),
score as (select row_id, parse_error, n n_expected, case when parse_error is not null then 0 when row_id % 5 = 0 then n - 1
  else n end n_predicted, case when row_id % 5 = 4 then 1.0 else 0.0 end::double call_ordered_exact_match_rate,
  case when parse_error is not null then 0 when row_id % 5 = 0 then (n - 1) / n else 1 end::double call_order_correct_rate,
  case when parse_error is null then 1 else 0 end::double arguments_json_parse_rate,
  case when row_id % 5 = 3 then 1 else 0 end::double invalid_method_rate,
  case when parse_error is not null then 0 when nr = 0 then 1 when row_id % 5 = 0 then (nr - last_read::int) / nr else 1
  end::double readonly_empty_arguments_rate from perr)
"""


@query("d8_align_calls", f"""with {EVAL_SQL}
select row_id, c.pos, not (row_id % 5 = 0 and c.pos = m.mx) in_both from call c join score using (row_id)
join (select row_id, max(pos) mx from call group by row_id) m using (row_id) where parse_error is null""")
def d8_align_calls(spark, sf):
    parsed = predicted_calls(spark, sf).select("row_id", contracts.parse_calls(F.col("raw")).alias("r"))
    guessed = parsed.select("row_id", F.posexplode("r.calls").alias("i", "c")).select("row_id", "i", "c.*")
    # Positions of the labels are line numbers; number the expected calls the same way.
    rows = contracts.collect_calls(expected_calls(spark, sf)).select("row_id", F.posexplode("calls").alias("i", "c"))
    kept = rows.join(parsed.filter("r.error is null").select("row_id"), "row_id", "left_semi").select("row_id", "i", "c.*")
    pairs = contracts.align_calls(kept.withColumnRenamed("i", "pos"), guessed.withColumnRenamed("i", "pos"))
    places = expected_calls(spark, sf).select("row_id", F.col("pos").alias("line"), "rest_api")
    ranked = places.join(rows.select("row_id").distinct(), "row_id", "left_semi").groupBy("row_id").agg(
        F.array_sort(F.collect_list("line")).alias("lines_of"))
    return pairs.join(ranked, "row_id").select(
        "row_id", F.element_at("lines_of", F.col("pos") + 1).alias("pos"),
        (F.col("e").isNotNull() & F.col("p").isNotNull()).alias("in_both"))


SHOWN = ["call_ordered_exact_match_rate", "call_order_correct_rate", "arguments_json_parse_rate",
         "invalid_method_rate", "readonly_empty_arguments_rate"]


def call_scores(spark, sf):
    rows = contracts.collect_calls(expected_calls(spark, sf)).select("row_id", F.posexplode("calls").alias("pos", "c"))
    return contracts.evaluate_calls(rows.select("row_id", "pos", "c.*"), predicted_calls(spark, sf))


@query("k11_call_parse_report", f"with {EVAL_SQL} select coalesce(parse_error, 'ok') reason, count(*) n from score group by 1")
def k11_call_parse_report(spark, sf):
    parsed = predicted_calls(spark, sf).select(contracts.parse_calls(F.col("raw")).alias("r"))
    return parsed.groupBy(F.coalesce("r.error", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("k11_list_parse_report", """
select case o_orderkey % 4 when 0 then 'ok' when 1 then 'invalid_json' when 2 then 'y_pred.rest_api_list must be a list'
  else 'each y_pred.rest_api_list item must be a string' end reason, count(*) n, sum(case when o_orderkey % 4 = 0
  then 2 else 0 end)::bigint n_items from orders group by 1""")
def k11_list_parse_report(spark, sf):
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 4 == 0, F.to_json(obj(("y_pred", obj(("rest_api_list", F.array(F.col("o_orderpriority"), F.lit("b"))))))))
        .when(key % 4 == 1, F.col("o_orderpriority")).when(key % 4 == 2, '{"rest_api_list": "x"}')
        .otherwise(F.to_json(obj(("rest_api_list", F.array(key))))))
    parsed = table(spark, sf, "orders").select(contracts.parse_list(raw).alias("r"))
    return parsed.groupBy(F.coalesce("r.error", F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.array_size("r.rest_api_list"), F.lit(0))).alias("n_items"))


@query("e9_call_scores", f"with {EVAL_SQL} select row_id, parse_error, n_expected, n_predicted, {rounded_sql(SHOWN)} from score")
def e9_call_scores(spark, sf):
    return call_scores(spark, sf).select("row_id", "parse_error", "n_expected", "n_predicted", *rounded(SHOWN))


@query("e9_call_metrics", f"""with {EVAL_SQL}
select count(*) rows_total, count(*) filter (parse_error is null) parsed_total,
  count(*) filter (call_ordered_exact_match_rate = 1) accepted_total,
  {', '.join(f'round(avg({c}), 6) {c}' for c in SHOWN)} from score""")
def e9_call_metrics(spark, sf):
    return contracts.call_metrics(call_scores(spark, sf)).select(
        "rows_total", "parsed_total", "accepted_total", *rounded(SHOWN))


# --- judged drafts -----------------------------------------------------------------------------


def drafts(spark, sf):
    return as_drafts(table(spark, sf, "events"))


def as_drafts(events):
    """Every event as a judged draft: right, wrong, nonsense, empty and each malformed shape."""
    eid = F.col("event_id")
    a, b = text_of("/u/", F.col("user_id")), text_of("/e/", F.col("event_type"))
    expected = F.when(eid % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(a, b))
    listed = F.when(eid % 13 == 0, F.array().cast("array<string>")).when(eid % 5 == 0, F.array(b)).when(
        eid % 7 == 0, F.array(b, a, F.lit("/extra"))).otherwise(F.array(b, a, a))
    answer = obj(("accepted", F.col("value") > 5), ("rest_api_list", listed), ("nonsense", eid % 17 == 0),
                 ("order_evidence", F.when(eid % 2 == 0, "explicit_then")), ("reason", "r"))
    raw = (
        F.when(eid % 19 == 0, "{not json").when(eid % 19 == 1, "[1]").when(eid % 19 == 2, '{"accepted": true}')
        .when(eid % 19 == 3, '{"rest_api_set": "x"}').when(eid % 19 == 4, '{"rest_api_list": [1, "a"]}')
        .when(eid % 19 == 5, '{"rest_api_list": []}')
        .when(eid % 19 == 6, '{"rest_api_list": [], "accept": "yes"}')
        .when(eid % 19 == 7, '{"rest_api_list": [], "accept": true}')
        .when(eid % 19 == 8, '{"rest_api_list": [], "accept": true, "nonsense": false, "order_evidence": "x"}')
        .when(eid % 19 == 9, F.to_json(obj(("y_pred", answer)))).otherwise(F.to_json(answer)))
    return events.select("event_id", "event_type", expected.alias("expected"), raw.alias("raw"))


JUDGE_SQL = """
j as (select event_id, event_type, "value", user_id, event_id % 19 s, event_id % 13 = 0 empty from events),
jr as (select *, s < 9 invalid, case s when 0 then 'invalid_json' when 1 then 'judge result is not a mapping'
  when 2 then 'rest_api_list or rest_api_set is required' when 3 then 'rest_api_set is not a list'
  when 4 then 'rest_api_list must contain only strings' when 5 then 'accepted or accept is required'
  when 6 then 'accept must be a boolean' when 7 then 'nonsense must be a boolean'
  when 8 then 'order_evidence must be one of explicit_after, explicit_before, explicit_then, none, numbered_steps'
  else 'r' end reason, s >= 9 and "value" > 5 accepted, s >= 9 and event_id % 17 = 0 nonsense,
  s >= 9 and (empty or (event_id % 5 <> 0 and event_id % 7 <> 0)) set_match,
  case when s < 9 then empty else empty or event_id % 5 <> 0 end all_present,
  s >= 9 and not empty and event_id % 5 <> 0 and event_id % 7 = 0 extra_present,
  case when s >= 9 and event_id % 2 = 0 then 'explicit_then' else 'none' end order_evidence from j),
jk as (select *, accepted and set_match and not nonsense kept from jr)
"""


def judged(spark, sf):
    return judge.coverage(judge.parse_judge(drafts(spark, sf)))


@query("k10_judge_parse_report", f"with {JUDGE_SQL} select reason, order_evidence, count(*) n from jk group by all")
def k10_judge_parse_report(spark, sf):
    return judge.parse_judge(drafts(spark, sf)).groupBy("reason", "order_evidence").agg(F.count("*").alias("n"))


@query("h2_set_match", f"with {JUDGE_SQL} select event_id, set_match, kept from jk")
def h2_set_match(spark, sf):
    return judged(spark, sf).select("event_id", "set_match", "kept")


@query("h3_coverage_flags", f"with {JUDGE_SQL} select event_id, all_present, extra_present from jk")
def h3_coverage_flags(spark, sf):
    return judged(spark, sf).select("event_id", "all_present", "extra_present")


COUNTERS = ["draft_total", "rejected_total", "accepted_total", "nonsense_total", "invalid_json_total",
            "pro_accept_total", "rest_api_set_match_total", "empty_set_expected_total", "empty_set_match_total"]
JUDGE_RATES = ["nonsense_rate", "invalid_json_rate", "pro_accept_rate", "rest_api_set_match_rate", "empty_set_match_rate"]
COUNTER_SQL = f"""{JUDGE_SQL},
ct as (select event_type, count(*) draft_total, count(*) filter (not kept) rejected_total,
  count(*) filter (kept) accepted_total, count(*) filter (nonsense) nonsense_total,
  count(*) filter (invalid) invalid_json_total, count(*) filter (accepted) pro_accept_total,
  count(*) filter (set_match) rest_api_set_match_total, count(*) filter (s >= 9 and empty) empty_set_expected_total,
  count(*) filter (s >= 9 and empty) empty_set_match_total from jk group by event_type),
cr as (select *, nonsense_total / draft_total nonsense_rate, invalid_json_total / draft_total invalid_json_rate,
  pro_accept_total / draft_total pro_accept_rate, rest_api_set_match_total / draft_total rest_api_set_match_rate,
  coalesce(empty_set_match_total / nullif(empty_set_expected_total, 0), 0) empty_set_match_rate from ct)
"""


@query("e8_judge_counters", f"""with {COUNTER_SQL}
select event_type, {', '.join(COUNTERS)}, {rounded_sql(JUDGE_RATES)} from cr""")
def e8_judge_counters(spark, sf):
    return judge.judge_counters(judged(spark, sf), ["event_type"]).select("event_type", *COUNTERS, *rounded(JUDGE_RATES))


GATE = [("min_pro_accept_rate", "pro_accept_rate", ">=", 0.4, 0.0),
        ("min_rest_api_set_match_rate", "rest_api_set_match_rate", ">=", 0.9, 0.0),
        ("max_nonsense_rate", "nonsense_rate", "<=", 0.2, 1.0),
        ("max_invalid_json_rate", "invalid_json_rate", "<=", 0.9, 1.0),
        ("max_unknown_rate", "unknown_rate", "<=", 0.5, 1.0)]


@query("c11_threshold_gate", f"""with {JUDGE_SQL},
o as (select count(*) filter (accepted) / count(*) a, count(*) filter (set_match) / count(*) b,
  count(*) filter (nonsense) / count(*) c, count(*) filter (invalid) / count(*) d from jk)
select 'min_pro_accept_rate' check_name, round(a, 6) observed, a >= 0.4 passed from o
union all select 'min_rest_api_set_match_rate', round(b, 6), b >= 0.9 from o
union all select 'max_nonsense_rate', round(c, 6), c <= 0.2 from o
union all select 'max_invalid_json_rate', round(d, 6), d <= 0.9 from o
union all select 'max_unknown_rate', 1.0, false from o""")
def c11_threshold_gate(spark, sf):
    totals = judge.judge_counters(judged(spark, sf).withColumn("everything", F.lit("all")), ["everything"])
    long = metrics.metrics_long(totals, "everything").select("metric", "value")
    limits = spark.createDataFrame(
        GATE, "check_name string, metric string, operator string, threshold double, fallback double")
    return metrics.acceptance_checks(long, limits).select("check_name", F.round("observed", 6).alias("observed"), "passed")


@query("d13_join_provider_outputs", """
select event_id candidate, case when event_id < (select count(*) * 0.9 from events) then event_type end output,
  case when event_id >= (select count(*) * 0.9 from events) then 'not enough provider lines' end error from events""")
def d13_join_provider_outputs(spark, sf):
    events = table(spark, sf, "events")
    size = events.agg(F.count("*") * 0.9).scalar()
    outputs = events.filter(F.col("event_id") < size).select(
        F.col("event_id").alias("candidate"), F.col("event_type").alias("output"))
    return judge.join_provider_outputs(events.select(F.col("event_id").alias("candidate")), outputs)


# --- tokens ------------------------------------------------------------------------------------


def token_rows(spark, sf):
    """Words of every document as token ids."""
    ids = F.transform(F.split("text", " "), lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 1000))
    return table(spark, sf, "documents").select("doc_id", "lang", ids.alias("input_ids"))


TOKEN_SQL = """
tok as (select doc_id, lang, list_transform(string_split(text, ' '), lambda w: (('0x'||substr(md5(w),1,4))::int % 1000))
  ids from documents)
"""
SUM = "list_sum({})::bigint"


@query("l1_chunk_tokens", f"""with {TOKEN_SQL},
w as (select doc_id, ids, unnest(range(case when len(ids) <= 64 then 1 else ceil((len(ids) - 64) / 48)::int + 1 end)) chunk
  from tok),
c as (select doc_id, chunk, ids[(chunk * 48 + 1):(chunk * 48 + 64)] part, len(ids) n from w)
select doc_id, chunk::int chunk, case when n <= 64 then n else 64 end::int size, len(part)::int used,
  list_sum(part)::bigint total, part[1] first_id from c""")
def l1_chunk_tokens(spark, sf):
    rows = tokens.chunk_tokens(token_rows(spark, sf), 64, 16)
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", "chunk", F.size("input_ids").alias("size"),
                       total("attention_mask").cast("int").alias("used"), total("input_ids").alias("total"),
                       F.element_at("input_ids", 1).alias("first_id"))


def pairs_of_turns(spark, sf):
    ids = lambda c: F.transform(F.split(c, " "), lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 1000))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", ids(F.col("text")).alias("ids"))
    reply = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("completion_ids"))
    return turns.withColumnRenamed("ids", "prompt_ids").join(reply, ["conv_id", "turn"])


@query("l2_pack_prompt_completion", """
with t as (select conv_id, turn, list_transform(string_split(text, ' '), lambda w: (('0x'||substr(md5(w),1,4))::int % 1000)) ids
  from conversations),
p as (select a.conv_id, a.turn, a.ids pi, b.ids ci from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
k as (select *, least(len(ci), 47) nc, least(48 - least(len(ci), 47), len(pi)) np from p)
select conv_id, turn, 48 size, (nc + np)::int used, (48 - nc)::int n_ignored,
  coalesce(list_sum(pi[(len(pi) - np + 1):(len(pi))]), 0)::bigint + list_sum(ci[1:nc])::bigint total,
  list_sum(ci[1:nc])::bigint - 100 * (48 - nc) label_total from k""")
def l2_pack_prompt_completion(spark, sf):
    rows = tokens.pack_prompt_completion(pairs_of_turns(spark, sf), 48)
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "conv_id", "turn", F.size("input_ids").alias("size"), total("attention_mask").cast("int").alias("used"),
        F.size(F.filter("labels", lambda x: x == -100)).alias("n_ignored"), total("input_ids").alias("total"),
        total("labels").alias("label_total"))


@query("l3_mask_new_tokens", f"""with {TOKEN_SQL}
select doc_id, len(list_filter(ids, lambda x: x >= 900 and x < 950))::int n_new, len(ids)::int n from tok""")
def l3_mask_new_tokens(spark, sf):
    mask = tokens.mask_new_tokens(F.col("input_ids"), 900, 950)
    return token_rows(spark, sf).select(
        "doc_id", F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_new"), F.size("input_ids").alias("n"))


@query("l4_mask_key_value_span", f"""with {TOKEN_SQL},
pos as (select doc_id, unnest(ids) id, unnest(range(len(ids))) i from tok),
kind as (select doc_id, i, id % 50 = 7 is_target, id % 20 = 3 is_end from pos),
nxt as (select *, min(case when is_end then i end) over (partition by doc_id order by i rows between 1 following and
  unbounded following) next_end from kind),
span as (select doc_id, i a, next_end b from nxt where is_target and next_end is not null),
cov as (select distinct s.doc_id, p.i from span s join pos p on p.doc_id = s.doc_id and p.i between s.a and s.b)
select doc_id, count(c.i) n_masked from tok left join cov c using (doc_id) group by doc_id""")
def l4_mask_key_value_span(spark, sf):
    # Ids are folded to three marks: 7 a target, 3 a terminator, 0 anything else.
    marks = F.transform("input_ids", lambda x: F.when(x % 50 == 7, 7).when(x % 20 == 3, 3).otherwise(0))
    mask = tokens.mask_key_value_span(marks, [7], [[3]])
    return token_rows(spark, sf).select("doc_id", F.aggregate(
        mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_masked"))


@query("l5_mask_section", f"""with {TOKEN_SQL},
pos as (select doc_id, unnest(ids) id, unnest(range(len(ids))) i from tok),
mark as (select doc_id, i, case when id % 50 = 7 then 1 else -1 end c from pos where id % 50 in (7, 9)),
depth as (select *, sum(c) over (partition by doc_id order by i) d from mark),
span as (select a.doc_id, a.i a, min(b.i) b from depth a join depth b on b.doc_id = a.doc_id and b.i > a.i
  and b.d = a.d - 1 where a.c = 1 group by all),
cov as (select distinct s.doc_id, p.i from span s join pos p on p.doc_id = s.doc_id and p.i between s.a and s.b)
select doc_id, count(c.i) n_masked from tok left join cov c using (doc_id) group by doc_id""")
def l5_mask_section(spark, sf):
    marks = F.transform("input_ids", lambda x: F.when(x % 50 == 7, 1).when(x % 50 == 9, 2).otherwise(0))
    mask = tokens.mask_section(marks, [1], [1], [2])
    return token_rows(spark, sf).select("doc_id", F.aggregate(
        mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_masked"))


@query("l7_length_stats", f"""with {TOKEN_SQL},
c as (select lang, case when len(ids) <= 64 then len(ids) else 64 * (ceil((len(ids) - 64) / 48)::int + 1) end full_len,
  case when len(ids) <= 64 then 1 else ceil((len(ids) - 64) / 48)::int + 1 end k, len(ids) n from tok),
u as (select lang, sum(k)::bigint n, sum(full_len) s, max(least(n, 64))::int max_length, sum(case when n <= 64 then n
  else 64 * (k - 1) + n - 48 * (k - 1) end) used from c group by lang)
select lang, n, round(s / n, 6) mean_length, max_length, round(1 - used / s, 6) padding_share from u""")
def l7_length_stats(spark, sf):
    rows = tokens.chunk_tokens(token_rows(spark, sf), 64, 16)
    return tokens.length_stats(rows, ["lang"]).select("lang", "n", "max_length", *rounded(["mean_length", "padding_share"]))


# --- cards -------------------------------------------------------------------------------------


def observations(spark, sf):
    return as_observations(table(spark, sf, "events"))


def as_observations(events):
    """Events as tool observations with a status and a body."""
    value, eid = F.col("value"), F.col("event_id")
    status = F.when(F.col("event_type") == "error", 500).when(value < 4, 409).when(value < 6, 429).when(
        value < 8, 404).otherwise(200)
    body = F.to_json(obj(
        ("k", F.get_json_object("props", "$.k").cast("bigint")), ("user", F.col("user_id")),
        ("note", F.when(eid % 10 != 0, F.col("event_type"))), ("big", F.when(value > 20, F.lit(True)))))
    return events.select(
        eid.alias("ord"), F.col("event_type").alias("tool"), text_of("op", F.col("user_id") % 7).alias("op"),
        status.alias("status"), body.alias("body"))


OBS_SQL = """
obs as (select event_id, event_type tool, 'op'||(user_id % 7) op, case when event_type = 'error' then 500
  when "value" < 4 then 409 when "value" < 6 then 429 when "value" < 8 then 404 else 200 end status,
  event_id % 10 <> 0 has_note, "value" > 20 has_big from events),
learn as (select * from obs),
fld as (select tool, op, 'k' field, 'integer' "type" from learn where status < 400
  union select tool, op, 'user', 'integer' from learn where status < 400
  union select tool, op, 'note', 'string' from learn where status < 400 and has_note
  union select tool, op, 'big', 'boolean' from learn where status < 400 and has_big),
rule as (select tool, op, status, count(*) n_evidence, min(event_id) first_evidence from learn where status >= 400
  group by all)
"""


def learned(spark, sf):
    return observations(spark, sf)


@query("e17_induce_cards", f"""with {OBS_SQL}
select tool, op, 'field' claim, field name, "type" detail, 0::bigint n_evidence from fld
union all select tool, op, 'rule', status::varchar, case when status in (409, 412) then 'precondition_unmet'
  when status = 429 or status >= 500 then 'retriable' else 'fatal' end, n_evidence from rule""")
def e17_induce_cards(spark, sf):
    rows = learned(spark, sf)
    fields = cards.response_fields(rows).select(
        "tool", "op", F.lit("field").alias("claim"), F.col("field").alias("name"), F.col("type").alias("detail"),
        F.lit(0).cast("bigint").alias("n_evidence"))
    rules = cards.error_rules(rows).select(
        "tool", "op", F.lit("rule").alias("claim"), F.col("status").cast("string").alias("name"),
        F.col("error_class").alias("detail"), "n_evidence")
    return fields.unionByName(rules)


TALLY_SQL = f"""{OBS_SQL},
card as (select distinct tool, op from learn),
need as (select tool, op, bool_or(field = 'note') note, bool_or(field = 'big') big from fld group by all),
ver as (select o.tool, o.op, o.event_id, case when o.status >= 400 then case when r.status is not null then true end
  when n.tool is null then null else (not n.note or o.has_note) and (not n.big or o.has_big) end v
  from obs o join card using (tool, op) left join need n using (tool, op)
  left join rule r on r.tool = o.tool and r.op = o.op and r.status = o.status),
tally as (select tool, op, count(*) filter (v) confirmations, count(*) filter (not v) contradictions from ver group by all)
"""


@query("e16_card_tallies", f"""with {TALLY_SQL}
select *, case when contradictions > confirmations then 'contradicted' when confirmations > 0 then 'grounded'
  else 'provisional' end status from tally""")
def e16_card_tallies(spark, sf):
    return cards.card_tallies(cards.induce_cards(learned(spark, sf)), observations(spark, sf))


def slot_claims(spark, sf):
    key = F.col("p_partkey")
    claims = table(spark, sf, "part").select(
        F.col("p_brand").alias("tool"), F.col("p_type").alias("op"), text_of("s", key % 40).alias("slot"), key,
        F.concat("p_brand", F.when(F.col("p_brand") == "Brand#3", "old").otherwise("")).alias("fingerprint"),
        F.array(F.lit("On"), F.lit("Off"), text_of("v", F.col("p_size"))).alias("enum"))
    spec = table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(
        F.col("p_brand").alias("tool"), F.col("p_type").alias("op"), text_of("s", key % 40).alias("slot"),
        F.col("p_brand").alias("fingerprint"))
    catalog = table(spark, sf, "part").filter("p_size > 40").groupBy(
        F.col("p_brand").alias("tool"), text_of("s", key % 40).alias("slot")).agg(
        F.array(F.lit("Off"), F.min(text_of("v", F.col("p_size")))).alias("allowed"))
    return claims, spec, catalog


@query("d12_ground_cards", """
with c as (select p_brand tool, p_type op, 's'||(p_partkey % 40) slot, p_partkey, 'v'||p_size v from part),
s as (select distinct p_brand tool, p_type op, 's'||(p_partkey % 40) slot from part where p_partkey % 3 <> 0),
g as (select p_brand tool, 's'||(p_partkey % 40) slot, min('v'||p_size) a from part where p_size > 40 group by all)
select c.tool, c.op, c.slot, p_partkey, case when g.a is null then 'On,Off,'||v when g.a = v then 'Off,'||v else 'Off' end enum
from c join s using (tool, op, slot) left join g on g.tool = c.tool and g.slot = c.slot
where c.tool <> 'Brand#3' or (c.tool, c.op) not in (select tool, op from s)""")
def d12_ground_cards(spark, sf):
    rows = cards.ground_slots(*slot_claims(spark, sf))
    return rows.select("tool", "op", "slot", "p_partkey", F.array_join("enum", ",").alias("enum"))


CLAIM_SQL = """
c as (select p_brand tool, p_type op, p_partkey k, p_size z from part),
sp as (select tool, op, list(distinct 's'||(k % 40)) slots from c where k % 3 <> 0 group by all),
claim as (select distinct tool, op, 'rule' kind, (400 + k % 30)::varchar "name", null::varchar[] enum from c
  union all select tool, op, 'slot', 's'||(k % 40), ['On', 'Off', 'v'||z] from c
  union all select distinct tool, op, 'field', 'f'||(k % 11), null from c),
cited as (select distinct tool, op, (400 + k % 30)::varchar "name" from c where k % 4 <> 0 and k in (select l_partkey from lineitem)),
cat as (select tool, 's'||(k % 40) "name", list_distinct(['Off', min('v'||z)]) allowed from c where z > 40 group by all),
fld as (select distinct tool, op, 'f'||((k + 1) % 11) "name" from c where z > 25),
stale as (select tool, op from sp where tool = 'Brand#3'),
held as (select tool, op, kind, "name", case when allowed is null then enum else list_filter(enum, lambda v: list_contains(allowed, v)) end enum
  from claim left join (select *, 'slot' kind from cat) using (tool, kind, "name") left join sp using (tool, op)
  where (tool, op) not in (from stale) and case kind when 'rule' then (tool, op, "name") in (select tool, op, "name" from cited)
    when 'slot' then slots is null or list_contains(slots, "name")
    else (tool, op, "name") in (select tool, op, "name" from fld) or (tool, op) not in (select tool, op from fld) end)
"""


def card_claims(spark, sf):
    """Cards of brands and types: claims, citations, and what they are checked against; the schemas differ for one brand."""
    key, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf, "part").withColumns({"tool": F.col("p_brand"), "op": F.col("p_type")})
    ranges = part.groupBy("tool", "op").agg(F.min("p_size").alias("a"), F.max("p_size").alias("x"))
    moved = F.col("a") + F.when(F.col("tool") == "Brand#3", 1).otherwise(0)
    told = ranges.select("tool", "op", F.to_json(obj(("a", F.col("a")), ("b", obj(("x", F.col("x")), ("y", F.col("tool")))))).alias("schema"))
    learnt = ranges.select("tool", "op", F.to_json(obj(("b", obj(("y", F.col("tool")), ("x", F.col("x")))), ("a", moved))).alias("schema"))
    own = cards.spec_fingerprints(learnt).withColumn("status", F.lit("provisional"))
    slot, rule = text_of("s", key % 40), (400 + key % 30).cast("string")
    slots = part.filter("p_partkey % 3 <> 0").groupBy("tool", "op").agg(F.collect_set(slot).alias("slots"))
    spec = slots.join(cards.spec_fingerprints(told), ["tool", "op"])
    none = F.lit(None).cast("array<string>").alias("enum")
    claims = part.select("tool", "op", F.lit("rule").alias("kind"), rule.alias("name"), none).distinct().unionByName(
        part.select("tool", "op", F.lit("slot").alias("kind"), slot.alias("name"), F.array(F.lit("On"), F.lit("Off"), text_of("v", size)).alias("enum"))).unionByName(
        part.select("tool", "op", F.lit("field").alias("kind"), text_of("f", key % 11).alias("name"), none).distinct())
    citations = part.filter("p_partkey % 4 <> 0").select("tool", "op", rule.alias("name"), key.alias("evidence"))
    observed = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("evidence"))
    catalog = part.filter("p_size > 40").groupBy("tool", slot.alias("slot")).agg(F.array(F.lit("Off"), F.min(text_of("v", size))).alias("allowed"))
    fields = part.filter("p_size > 25").select("tool", "op", text_of("f", (key + 1) % 11).alias("name")).distinct()
    return cards.ground_claims(own, claims, citations, observed, spec, catalog, fields)


@query("d12_ground_claims", f"""with {CLAIM_SQL}
select tool, op, kind, "name", coalesce(array_to_string(enum, ','), '-') enum, count(*) n from held group by all""")
def d12_ground_claims(spark, sf):
    held, _ = card_claims(spark, sf)
    return held.groupBy("tool", "op", "kind", "name", F.coalesce(F.array_join("enum", ","), F.lit("-")).alias("enum")).agg(F.count("*").alias("n"))


@query("d12_grounded_cards", f"""with {CLAIM_SQL}
select tool, op, case when (tool, op) in (from stale) then 'contradicted' else 'provisional' end status, coalesce(k, 0) kept, n - coalesce(k, 0) dropped
from (select tool, op, count(*) n from claim group by all) left join (select tool, op, count(*) k from held group by all) using (tool, op)""")
def d12_grounded_cards(spark, sf):
    return card_claims(spark, sf)[1]


@query("k2_subtree_fingerprints", """
with s as (select '/v1/suppliers/'||s_suppkey url, s_name, s_suppkey k, s_nationkey n, md5('boolean:'||case when s_acctbal >= 0 then 'True' else 'False' end) on_ from supplier),
l as (select *, md5('array:'||md5('string:ntp-a'||k)||','||md5('string:ntp-b'||n)) list from s),
o as (select *, md5('object:10 NTPServers='||list||',15 ProtocolEnabled='||on_) ntp from l)
select url, 'NTP.NTPServers' path, list digest from o union all select url, 'NTP', ntp from o
union all select url, '', md5('object:9 @odata.id='||md5('string:'||url)||',11 @odata.type='||md5('string:#ManagerNetworkProtocol.v1.ManagerNetworkProtocol')
  ||',3 NTP='||ntp||',4 Name='||md5('string:'||s_name)) from o""")
def k2_subtree_fingerprints(spark, sf):
    leaves = json_walk.json_walk(of_source(spark, sf, "supplier"), carry=("url",), fields=("ord", "parent_ord", "key", "path", "json_type", "value"))
    return json_walk.fingerprints(leaves).filter(F.col("path").isin("", "NTP", "NTP.NTPServers")).select("url", "path", "digest")


@query("b13_render_card_clause", """
with c as (select p_partkey, 'card=[sig:'||case when p_size % 2 = 0 then 'Boot!:enum' else 'Boot:string' end||',Delay:integer'||
  ';err:404=fatal,429=retriable;exp:'||array_to_string(list_sort([replace(p_name, ' ', '_')||repeat('x', p_size * 6), 'k']),
  ',')||']' t from part)
select p_partkey, case when length(t) > 240 then substr(t, 1, 239)||']' else t end clause from c""")
def b13_render_card_clause(spark, sf):
    size = F.col("p_size")
    slot = lambda n, t, r, e: F.struct(F.lit(n).alias("slot"), F.lit(t).alias("type"), r.alias("required"), e.alias("enum"))
    none = F.array().cast("array<string>")
    slots = F.array(slot("Delay", "integer", F.lit(False), none),
                    slot("Boot", "string", size % 2 == 0, F.when(size % 2 == 0, F.array(F.lit("a"))).otherwise(none)))
    rule = lambda s: F.struct(F.lit(s).alias("status"), cards.error_class(F.lit(s)).alias("error_class"))
    fields = F.array(F.lit("k"), F.concat(F.translate("p_name", " ", "_"), F.repeat(F.lit("x"), size * 6)))
    clause = cards.card_clause(slots, F.array(rule(429), rule(404), rule(404)), fields)
    return table(spark, sf, "part").select("p_partkey", clause.alias("clause"))


@query("b12_action_template", """
select p_partkey, 'tool='||p_brand||' op='||p_type||case when p_size % 2 = 0 then ' target=/p/'||p_partkey else '' end||
  ' args=['||case when p_size % 3 = 0 then '' else 'a:string,b:integer' end||']'||
  case when p_size % 5 = 0 then '' else ' schema=s'||p_size end template,
  md5('tool='||p_brand||' op='||p_type||case when p_size % 2 = 0 then ' target=/p/'||p_partkey else '' end||
  ' args=['||case when p_size % 3 = 0 then '' else 'a:string,b:integer' end||']'||
  case when p_size % 5 = 0 then '' else ' schema=s'||p_size end) template_key from part""")
def b12_action_template(spark, sf):
    size = F.col("p_size")
    arguments = F.when(size % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("b"), F.lit("integer"), F.lit("a"), F.lit("string")))
    template = cards.action_template(
        F.col("p_brand"), F.col("p_type"), F.when(size % 2 == 0, text_of("/p/", F.col("p_partkey"))), arguments,
        F.when(size % 5 == 0, "").otherwise(text_of("s", size)))
    rows = table(spark, sf, "part").select("p_partkey", template.alias("template"))
    return rows.withColumn("template_key", hashing.text_digest(F.col("template"), 16))


@query("u3_encoded_templates", """
with t as (select *, 'tool='||p_brand||' op='||p_type||' args=['||case when p_size % 3 = 0 then '' else 'a:string,b:integer' end||'] card='||(p_size % 4) said,
    'tool='||p_brand||' op='||p_type||' args=['||case when p_size % 3 = 0 then '' else 'a:string,b:integer' end||'] card='||(p_size % 4 + case when p_partkey % 10 = 0 then 7 else 0 end) later
  from part),
n as (select (select count(distinct said) from t) n1, (select count(distinct later) from t where later not in (select said from t)) n2)
select p_partkey, md5(later) "key", n1, n2, 0::bigint n3, round(1.0, 6)::double norm from t, n""")
def u3_encoded_templates(spark, sf):
    """Templates encoded three times: at first, after a tenth of the cards has changed, and with nothing new."""
    folder = scratch_path(spark, "encoder")

    def templates(changed):
        card = F.col("p_size") % 4 + (F.when(F.col("p_partkey") % 10 == 0, 7).otherwise(0) if changed else 0)
        args = F.when(F.col("p_size") % 3 == 0, "").otherwise("a:string,b:integer")
        return table(spark, sf, "part").select("p_partkey", text_of("tool=", F.col("p_brand"), " op=", F.col("p_type"), " args=[", args, "] card=", card).alias("said"))

    _, first = encoder.encoded(templates(False), "said", folder)
    _, second = encoder.encoded(templates(True), "said", folder)
    rows, third = encoder.encoded(templates(True), "said", folder)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("p_partkey", "key", *[F.lit(n).cast("bigint").alias(c) for c, n in (("n1", first), ("n2", second), ("n3", third))],
                       F.round(length, 6).alias("norm"))


@query("c7_safe_candidates", """
select p_partkey from part where p_size % 5 <> 0 and p_size % 7 <> 0 and p_size % 4 <= 1 and p_brand = 'Brand#5'""")
def c7_safe_candidates(spark, sf):
    size = F.col("p_size")
    actions = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("tool"), (size % 5 != 0).alias("legal"), (size % 7 != 0).alias("valid"),
        (size % 4).alias("risk"))
    return cards.safe_candidates(actions, 1, "Brand#5").select("p_partkey")


# --- transitions -------------------------------------------------------------------------------


def steps(spark, sf):
    """Events of a user as one episode; an hour of one user's events is the numbering bucket."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return rl.episodes(rows, "user_id", ["ts", "event_id"], "event_type", F.date_trunc("hour", "ts"))


STEP_SQL = """
st as (select *, row_number() over w - 1 step, lead(event_type) over w next_state from events
  window w as (partition by user_id order by ts, event_id)),
sr as (select *, case when step >= 50 then -1 when event_id % 11 = 0 then -0.1 when event_type = 'purchase' then 1
  when event_type = 'error' then -0.5 when event_type = 'signup' then -0.2 else 0.1 end::double reward,
  step < 50 and event_id % 11 <> 0 and event_type in ('purchase', 'error') terminated, step >= 50 truncated from st)
"""


def rewarded(spark, sf):
    kind = F.col("event_type")
    method = F.when(F.col("event_id") % 11 == 0, "TRACE").otherwise("GET")
    status = F.when(kind == "error", 500).when(kind == "signup", 404).otherwise(200)
    out = rl.reward_from_status(F.col("step"), 50, method, kind == "purchase", status)
    return steps(spark, sf).withColumn("r", out).select("*", "r.*").drop("r")


@query("k22_reward_from_status", f"with {STEP_SQL} select event_id, step, next_state, reward, terminated, truncated from sr")
def k22_reward_from_status(spark, sf):
    return rewarded(spark, sf).select("event_id", "step", "next_state", "reward", "terminated", "truncated")


@query("e15_episode_returns", f"""with {STEP_SQL}
select user_id, round(sum(reward), 6) + 0::double total, count(*) filter (event_type = 'purchase') n_reached, count(*) n_steps
from sr group by user_id""")
def e15_episode_returns(spark, sf):
    rows = rewarded(spark, sf).withColumn("reached", F.col("event_type") == "purchase")
    return rl.episode_returns(rows, "user_id").select("user_id", *rounded(["total"]), "n_reached", "n_steps")


@query("d10_her_future_relabel", f"""with {STEP_SQL},
e as (select user_id, max(step) last from st group by user_id),
d as (select st.user_id, step, draw, next_state, step + floor({h_sql("'1:'||st.user_id||':'||step||':'||draw")} *
  (last - step + 1))::bigint "at" from st join e using (user_id), (select unnest([1, 2, 3, 4]) draw))
select d.user_id, d.step, d.draw, d."at", s.next_state goal, coalesce((d.next_state = s.next_state)::int, 0)::double reward
from d join st s on s.user_id = d.user_id and s.step = d."at" """)
def d10_her_future_relabel(spark, sf):
    return rl.her_relabel(steps(spark, sf), "user_id", 4, 1).select("user_id", "step", "draw", "at", "goal", "reward")


@query("f7_replay_last_n", """
select event_id, event_type, age::int age from (select *, row_number() over (partition by event_type
  order by ts desc, event_id desc) age from events) where age <= 100""")
def f7_replay_last_n(spark, sf):
    return rl.replay_last_n(table(spark, sf, "events"), "event_type", ["ts", "event_id"], 100).select(
        "event_id", "event_type", "age")


@query("k16_td_target", """
with a as (select l_orderkey, l_linenumber, l_returnflag <> 'A' legal, l_extendedprice / 1000 q, o_totalprice / 1000 reward,
  (o_orderstatus = 'F')::int done from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, round(min(reward) + 0.9 * (1 - min(done)) * coalesce(max(q) filter (legal), 0), 6) target
from a group by l_orderkey""")
def k16_td_target(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    actions = rows.select(
        "l_orderkey", (F.col("l_returnflag") != "A").alias("legal"), (F.col("l_extendedprice") / 1000).alias("q"),
        (F.col("o_totalprice") / 1000).alias("reward"), (F.col("o_orderstatus") == "F").cast("int").alias("done"))
    return rl.td_target(actions, ["l_orderkey"], 0.9).withColumn("target", F.round("target", 6))


@query("k19_select_categorical", """
select l_orderkey, l_linenumber, arg_max(l_suppkey, struct_pack(s := l_quantity, i := -l_partkey)) choice from lineitem
group by all""")
def k19_select_categorical(spark, sf):
    scores = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("choice"), F.col("l_quantity").alias("score"),
        F.col("l_partkey").alias("index"))
    return rl.select_categorical(scores, ["l_orderkey", "l_linenumber"])


@query("k19_assemble_arguments", """
with s as (select l_orderkey k, l_linenumber n, arg_max(l_suppkey, struct_pack(s := l_quantity, i := -l_partkey)) c,
  max(l_quantity) q from lineitem group by all),
bad as (select distinct k from s where q < 10 and n = 1)
select k l_orderkey, string_agg('s'||n||'='||c, ',' order by 's'||n) arguments from s
where q >= 10 and k not in (select k from bad) group by k""")
def k19_assemble_arguments(spark, sf):
    scores = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("choice"),
        F.col("l_quantity").alias("score"), F.col("l_partkey").alias("index"))
    chosen = rl.select_categorical(scores, ["l_orderkey", "l_linenumber"]).join(
        scores.groupBy("l_orderkey", "l_linenumber").agg(F.max("score").alias("q")), ["l_orderkey", "l_linenumber"])
    slots = chosen.select("l_orderkey", text_of("s", F.col("l_linenumber")).alias("slot"),
                          (F.col("l_linenumber") == 1).alias("required"))
    given = chosen.filter("q >= 10").select("l_orderkey", text_of("s", F.col("l_linenumber")).alias("slot"), "choice")
    arguments, _ = rl.assemble_arguments(slots, given, "l_orderkey")
    pairs = F.transform(F.map_entries("arguments"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return arguments.select("l_orderkey", F.array_join(pairs, ",").alias("arguments"))


# --- ranking -----------------------------------------------------------------------------------


@query("k13_candidate_text", f"""with {CANDIDATE_SQL}
select url, http_method, ltrim(url, '/')||' '||http_method||' '||resource_type||' '||child_relation_name||
  case when has_action_target then ' action' else '' end "text" from cand""")
def k13_candidate_text(spark, sf):
    return tree_candidates(spark, sf).select("url", "http_method", ranking.candidate_text().alias("text"))


VECTOR = """{p}g as (select {k}, unnest(list_transform(range(length(t) - 2), lambda i: substr(t, (i + 1)::int, 3))) w
  from (select {k}, ' '||lower({t})||' ' t from {src})),
{p}b as (select {k}, ('0x'||substr(md5(w),1,8))::ubigint % 512 bucket, count(*) n from {p}g group by all),
{p}n as (select {k}, sqrt(sum(n * n)) norm from {p}b group by all),
{p}v as (select {k}, bucket::int bucket, n / norm w from {p}b join {p}n using ({k}))"""


@query("k12_trigram_vector", f"""with {VECTOR.format(p='x', k='page_id', t='url', src='pages')}
select page_id, bucket, round(w, 6) w from xv""")
def k12_trigram_vector(spark, sf):
    return ranking.trigram_vectors(table(spark, sf, "pages"), "page_id", "url").withColumn("w", F.round("w", 6))


def rank_inputs(spark, sf):
    """States, candidates and true neighbours; candidate texts are staged, for they are read block by block."""
    nodes = crawled(spark, sf)
    parents = staged(spark, "parents", sf, lambda: tree.containment_parent(nodes.select("url")))
    relations = tree.child_relation(nodes, parents)
    cand = tree.candidates(tree.graph_nodes(nodes), relations)
    texts = staged(spark, "texts", sf, lambda: cand.select(
        "host", "url", F.col("url").alias("key"), ranking.candidate_text().alias("text")))
    edges = tree.reference_edges(tree.harvest_refs(nodes), nodes)
    truths = tree.neighbors(parents, edges).select("url", F.col("neighbor").alias("truth"))
    truths = truths.join(texts.select("host", "url"), "url")
    return texts.drop("key"), texts, truths


RANK_SQL = f"""{REFS_SQL.rstrip()},
held as (select distinct n.url, case when n.kind = 'regions' then 'Regions' when n.kind = 'region' then 'Members'
  when n.kind = 'nation' then 'FirstNation' when n.kind = 'order' then 'FirstOrder' when n.kind = 'line' then 'FirstLine'
  end key from node n join seen s on s.url = n.parent and s.ref = n.url),
ctext as (select n.host, n.url, ltrim(n.url, '/')||' GET '||n.rtype||' '||coalesce(h.key, case n.kind when 'root' then 'v1'
  when 'regions' then 'regions' when 'region' then 'regions' when 'nation' then 'nations' when 'customer' then 'customers'
  when 'order' then 'orders' when 'line' then 'lines' when 'part' then 'parts' when 'registry' then 'registries'
  when 'supplier' then 'suppliers' when 'info' then 'ResetInfo' else 'BootOptions' end)||
  case when n.kind = 'customer' and c.c_acctbal >= 0 then ' action' else '' end t
  from node n left join held h using (url) left join cus c on c.url = n.url),
{VECTOR.format(p='r', k='url', t='t', src='ctext')},
rh as (select rv.*, host from rv join ctext using (url)),
dots as (select a.host, a.url, b.url candidate_url, round(sum(a.w * b.w), 9) score from rh a join rh b
  on a.host = b.host and a.bucket = b.bucket and a.url <> b.url group by all),
placed as (select *, row_number() over (partition by url order by score desc, candidate_url) place from dots),
truth as (select parent url, url truth from node where parent is not null
  union select url, parent from node where parent is not null
  union select url, ref from seen where ref in (select url from node) and ref <> url)
"""


@query("e12_top_k_hit_rate", f"""with {RANK_SQL},
t as (select distinct url from truth),
h as (select distinct p.url from placed p join truth t on t.url = p.url and t.truth = p.candidate_url where place <= 5)
select (select count(*) from t) evaluated, (select count(*) from h) hits,
  round((select count(*) from h) / (select count(*) from t), 6) hit_rate, 5 k""")
def e12_top_k_hit_rate(spark, sf):
    states, candidates, truths = rank_inputs(spark, sf)
    ranked = ranking.top_k(states, candidates, 5)
    return ranking.hit_rate(ranked, truths, states, 5).withColumn("hit_rate", F.round("hit_rate", 6))


@query("d11_rank_pairs", f"""with {RANK_SQL}
select host, url, candidate_url, round(score, 6) score, place::int place from placed where place <= 3""")
def d11_rank_pairs(spark, sf):
    states, candidates, _ = rank_inputs(spark, sf)
    return ranking.top_k(states, candidates, 3).select(
        "host", "url", "candidate_url", F.round("score", 6).alias("score"), "place")


@query("f5_top_k_per_group", """
select c_nationkey, c_custkey, place::int place from (select c_nationkey, c_custkey, row_number() over (
  partition by c_nationkey order by c_acctbal desc, c_custkey) place from customer) where place <= 5""")
def f5_top_k_per_group(spark, sf):
    rows = ranking.top_k_per_group(table(spark, sf, "customer"), ["c_nationkey"], 5, "c_acctbal", "c_custkey")
    return rows.select("c_nationkey", "c_custkey", "place")


LEGAL_SQL = "(vec_id * 7 + label) % 3 <> 0"


def state_vectors(spark, sf):
    """Every vector is a state, and a candidate of all states of its label; about two thirds of the candidates are legal."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    states = rows.select("label", F.col("vec_id").alias("query_id"), F.col("e").alias("query"))
    candidates = rows.select("label", F.col("vec_id").alias("candidate_id"), F.col("e").alias("key"), F.expr(LEGAL_SQL).alias("legal"))
    return states, candidates


@query("k17_score_candidates", f"""
with q as (select vec_id, embedding::double[] e, label, {LEGAL_SQL} legal from embeddings),
s as (select a.vec_id query_id, b.vec_id candidate_id, round(list_dot_product(a.e, b.e), 9) score from q a join q b
  on a.label = b.label and a.vec_id <> b.vec_id and b.legal),
p as (select *, row_number() over (partition by query_id order by score desc, candidate_id) place from s)
select query_id, candidate_id, round(score, 6) score from p where place = 1""")
def k17_score_candidates(spark, sf):
    states, candidates = state_vectors(spark, sf)
    best = ranking.best_candidate(states, candidates, own=["label"], others_only=True)
    return best.select("query_id", "candidate_id", F.round("score", 6).alias("score"))


@query("k18_bilinear_score", f"""
with w as (select l_orderkey % 64 bucket, (l_partkey % 64)::int "out", avg(l_discount) x from lineitem group by all),
v as (select vec_id, label, {LEGAL_SQL} legal, unnest(range(len(embedding))) b, unnest(embedding)::double w from embeddings),
p as (select vec_id, label, "out", sum(v.w * w.x) pw from v join w on w.bucket = v.b group by all),
s as (select p.vec_id state_id, c.vec_id candidate_id, round(sum(pw * c.w), 9) score
  from p join v c on c.label = p.label and c.legal and c.b = p."out" and c.vec_id <> p.vec_id group by all),
r as (select *, row_number() over (partition by state_id order by score desc, candidate_id) place from s)
select state_id, place::int place, candidate_id, round(score, 6) score from r where place <= 5""")
def k18_bilinear_score(spark, sf):
    weights = table(spark, sf, "lineitem").groupBy(
        (F.col("l_orderkey") % 64).alias("bucket"), (F.col("l_partkey") % 64).cast("int").alias("out")).agg(
        F.avg("l_discount").alias("w"))
    states, candidates = state_vectors(spark, sf)
    sparse = states.select("query_id", F.posexplode("query").alias("bucket", "w"))
    moved = ranking.project(sparse, weights, "query_id")
    # As many buckets as the weights have columns: a row per state.
    dense = moved.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m")).select(
        "query_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("query"))
    turned = states.select("label", "query_id").join(dense, "query_id")
    best = ranking.best_candidate(turned, candidates, k=5, own=["label"], others_only=True)
    return best.select(F.col("query_id").alias("state_id"), "place", "candidate_id", F.round("score", 6).alias("score"))


@query("k14_hash_vector", """
with h as (select page_id, sha256(url||':0')||sha256(url||':1') x from pages)
select page_id, i::int i, round(('0x'||substr(x, (i * 2 + 1)::int, 2))::int / 127.5 - 1, 6) v
from h, (select unnest(range(40)) i)""")
def k14_hash_vector(spark, sf):
    vector = hashing.hash_vector(F.col("url"), 40)
    return table(spark, sf, "pages").select("page_id", F.posexplode(vector).alias("i", "v")).withColumn(
        "v", F.round("v", 6))
