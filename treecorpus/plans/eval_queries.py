"""Queries for prediction evaluation, run comparison and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from treecorpus.functions import json_text
from treecorpus.functions.hashing import md5_fraction
from treecorpus.operators import metrics as ops, mix
from treecorpus.operators.percentiles import exact_percentiles
from treecorpus.plans import inputs
from treecorpus.plans.inputs import h_sql, obj, table, text_of
from treecorpus.plans.registry import query
from treecorpus.session import staged_path

# --- prediction lines --------------------------------------------------------------------------


def prediction_lines(spark, sf, artifact: str):
    """Documents as raw prediction rows of one artifact, in all shapes the reader accepts."""
    doc, lang = F.col("doc_id"), F.col("lang")
    h = lambda s: md5_fraction(text_of(f"{s}{artifact}:", doc))
    target = obj(("@odata.id", text_of("/d/", doc)), ("lang", lang))
    guess = F.to_json(obj(
        ("lang", F.when(h("ok") < 0.8, lang).otherwise("xx")),
        ("@odata.id", F.when(h("id") < 0.9, text_of("/d/", doc)).otherwise("/d/none"))))
    bad = h("bad") < 0.05
    shape = doc % 5
    members = [
        ("id", F.when(doc % 3 == 0, doc)),
        ("row_id", F.when(doc % 3 == 1, text_of("r", doc))),
        ("x", F.when(doc % 4 != 3, obj(("rest_api", text_of("/d/", doc))))),
        ("y_true", F.when(doc % 10 != 9, obj(("json", target)))),
        ("y_pred", F.when(~bad & (shape == 1), obj(("text", guess)))),
        ("prediction", F.when(~bad & (shape == 2), F.concat(F.lit("```json\n"), guess, F.lit("\n```")))),
        ("completion", F.when(bad, "no json here").when(
            shape == 3, F.concat(F.lit('He said "{" and: '), guess, F.lit(" done.")))),
        ("output", F.when(~bad & (shape == 4) & (doc % 25 != 4), guess)),
        ("generated_json", F.when(~bad & (shape == 0), F.from_json(guess, "lang string, `@odata.id` string"))),
        ("top_k", F.when(doc % 2 == 0, F.array(F.lit("zzz"), guess))),
        ("usage", obj(("completion_tokens", doc % 50), ("total_tokens", F.col("n_chars")))),
        ("padding_tokens", F.when(doc % 7 != 0, doc % 7)),
        ("elapsed_sec", F.when(doc % 6 != 0, F.round(h("t"), 6))),
        ("memory_peak_mb", F.round(h("m") * 1000, 3)),
        ("confidence", F.when(doc % 8 != 0, F.round(h("c"), 6))),
        ("log_prob", F.round(-h("l"), 6)),
        ("mean_log_prob", F.when(doc % 2 == 0, F.round(-h("p"), 6))),
    ]
    return table(spark, sf, "documents").select(
        F.lit(artifact).alias("artifact"), (doc + 1).alias("line_number"), F.to_json(obj(*members)).alias("line"))


def both_lines(spark, sf):
    return prediction_lines(spark, sf, "baseline").unionByName(prediction_lines(spark, sf, "model"))


def predictions(spark, sf):
    return ops.normalize_predictions(both_lines(spark, sf))


def _h(s):
    return h_sql(f"'{s}'||a||':'||doc_id")


PRED_SQL = f"""
art as (select unnest(['baseline', 'model']) a),
base as (select a, doc_id, lang, n_chars, {_h('ok')} < 0.8 ok, {_h('id')} < 0.9 idok, {_h('bad')} < 0.05 bad,
  round({_h('t')}, 6) t, round({_h('m')} * 1000, 3) m, round({_h('c')}, 6) c, round(-{_h('l')}, 6) l,
  round(-{_h('p')}, 6) p from documents, art),
pred as (select a artifact, doc_id + 1 line_number, doc_id, lang, n_chars, bad,
  not bad and not (doc_id % 5 = 4 and doc_id % 25 = 4) parse_ok,
  case when bad then 'prediction is not JSON' when doc_id % 25 = 4 then 'missing prediction'
    when doc_id % 5 = 2 then 'fenced' when doc_id % 5 = 3 then 'fragment' else 'parsed' end parse,
  doc_id % 10 <> 9 has_target, ok and idok good, idok,
  case when doc_id % 4 <> 3 or doc_id % 10 <> 9 then '/d/'||doc_id else '' end rest_api,
  (doc_id % 50)::bigint gen, n_chars seq_len, case when doc_id % 7 <> 0 then doc_id % 7 end pad,
  case when doc_id % 6 <> 0 then t end latency, m mem, case when doc_id % 8 <> 0 then c end conf, l log_prob,
  case when doc_id % 2 = 0 then p end log_prob_pt from base),
flag as (select *, case when has_target then parse_ok and good end exact_match,
  case when rest_api <> '' then parse_ok and idok end id_match,
  case when has_target and doc_id % 2 = 0 then good end top_k_match,
  '{{"@odata.id":"/d/'||doc_id||'","lang":"'||lang||'"}}' target_json from pred)
"""
KEY_SQL = """case doc_id % 3 when 0 then 'id:'||doc_id when 1 then 'id:r'||doc_id else
  'position:'||doc_id||':identity:'||substr(sha256('{"rest_api":"'||rest_api||'","target_json":'||
  case when has_target then target_json else 'null' end||'}'), 1, 16) end"""


@query("a12_read_predictions", """
select reason, count(*) n from (select case when doc_id % 9 = 1 then 'invalid JSON'
  when doc_id % 9 = 2 then 'row must be a JSON object' else 'ok' end reason from documents where doc_id % 9 <> 0)
group by reason""")
def a12_read_predictions(spark, sf):
    doc = F.col("doc_id")
    lines = table(spark, sf, "documents").select(
        F.when(doc % 9 == 0, " ").when(doc % 9 == 1, F.concat(F.lit("{"), F.translate("text", "\r\n", "  "))).when(doc % 9 == 2, "7")
        .otherwise(F.to_json(obj(("completion", F.col("text"))))).alias("line"))
    good, bad = ops.load_predictions(spark, staged_path(spark, "predictions", sf, lambda path: lines.write.text(path)))
    rows = good.select(F.lit("ok").alias("reason")).unionByName(bad.select(F.col("error").alias("reason")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("k9_prediction_parse_report", f"with {PRED_SQL} select artifact, parse, count(*) n from flag group by all")
def k9_prediction_parse_report(spark, sf):
    return ops.parse_report(both_lines(spark, sf))


@query("f8_position_row_key", f"""with {PRED_SQL}
select artifact, line_number, {KEY_SQL} row_key, rest_api, exact_match, id_match, top_k_match, parse_ok from flag""")
def f8_position_row_key(spark, sf):
    return predictions(spark, sf).select(
        "artifact", "line_number", "row_key", "rest_api", "exact_match", "id_match", "top_k_match", "parse_ok")


METRIC_SQL = f"""{PRED_SQL},
w as (select *, case when gen <> 0 then gen when seq_len <> 0 then seq_len else 1 end wt from flag),
w2 as (select *, coalesce(log_prob_pt, log_prob / wt) lp from w),
bins as (select artifact, least(floor(conf * 10), 9) b, count(*) n, avg(conf) c, avg(exact_match::int) acc from flag
  where conf between 0 and 1 and exact_match is not null group by all),
ece as (select artifact, sum(n * abs(acc - c)) / sum(n) ece from bins group by artifact),
met as (select artifact, count(*) row_count, count(*) filter (not has_target) missing_target_rows,
  count(*) filter (not parse_ok) missing_prediction_rows, avg(parse_ok::int) json_parse_rate,
  avg(exact_match::int) json_exact_match_rate, avg(id_match::int) odata_id_match_rate,
  avg(top_k_match::int) top_k_accuracy,
  sum(gen) / sum(latency) eval_tokens_per_sec, count(*) / sum(latency) eval_samples_per_sec,
  avg(case when seq_len <> 0 then pad / seq_len end) padding_ratio, avg(seq_len) mean_sequence_length,
  max(seq_len)::double max_sequence_length, sum(lp * wt) / sum(wt) log_prob_per_token,
  quantile_cont(latency, 0.5) latency_sec_p50, quantile_cont(latency, 0.95) latency_sec_p95,
  max(mem) memory_peak_mb from w2 group by artifact)
"""
ROUNDED = ["json_parse_rate", "json_exact_match_rate", "odata_id_match_rate", "top_k_accuracy",
           "eval_tokens_per_sec", "eval_samples_per_sec", "padding_ratio", "mean_sequence_length",
           "max_sequence_length", "log_prob_per_token", "latency_sec_p50", "latency_sec_p95", "memory_peak_mb", "ece"]
COUNTS = ["row_count", "missing_target_rows", "missing_prediction_rows"]


def rounded(columns, digits=6):
    # Adding zero turns a negative zero into a plain one.
    return [(F.round(c, digits) + 0.0).alias(c) for c in columns]


def rounded_sql(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0::double {c}" for c in columns)


@query("e4_prediction_metrics", f"""with {METRIC_SQL}
select artifact, {', '.join(COUNTS)}, {rounded_sql(ROUNDED)} from met join ece using (artifact)""")
def e4_prediction_metrics(spark, sf):
    return ops.prediction_metrics(predictions(spark, sf)).select("artifact", *COUNTS, *rounded(ROUNDED))


@query("e5_percentiles", """
select event_type, round(quantile_cont("value", 0.5), 6) p50, round(quantile_cont("value", 0.95), 6) p95
from events group by event_type""")
def e5_percentiles(spark, sf):
    rows = exact_percentiles(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return rows.select("event_type", *rounded(["p50", "p95"]))


@query("e6_weighted_log_prob", f"""with {METRIC_SQL}
select artifact, round(log_prob_per_token, 6) log_prob_per_token from met""")
def e6_weighted_log_prob(spark, sf):
    return ops.prediction_metrics(predictions(spark, sf)).select("artifact", *rounded(["log_prob_per_token"]))


@query("e7_ece", f"with {METRIC_SQL} select artifact, round(ece, 6) ece from ece")
def e7_ece(spark, sf):
    return ops.calibration_error(predictions(spark, sf)).select("artifact", *rounded(["ece"]))


@query("d7_compare_artifacts", f"""with {METRIC_SQL},
long as (unpivot (select artifact, {', '.join(f'{c}::double {c}' for c in [*COUNTS, *ROUNDED])}
  from met join ece using (artifact)) on columns(* exclude artifact) into name metric value "value")
select metric, round(max("value") filter (artifact = 'baseline'), 6) baseline,
  round(max("value") filter (artifact = 'model'), 6) model,
  round(max("value") filter (artifact = 'model') - max("value") filter (artifact = 'baseline'), 6) delta
from long group by metric""")
def d7_compare_artifacts(spark, sf):
    long = ops.metrics_long(ops.prediction_metrics(predictions(spark, sf)))
    return ops.compare_artifacts(long, "baseline", "model").select("metric", *rounded(["baseline", "model", "delta"]))


@query("h5_missing_keys", f"""with {PRED_SQL},
k as (select artifact, doc_id, {KEY_SQL} row_key from flag),
l as (select row_key from k where artifact = 'baseline' and doc_id % 20 <> 0),
m as (select row_key from k where artifact = 'model' and doc_id % 30 <> 1)
select row_key, 'model' missing_from from (from l except from m)
union all select row_key, 'baseline' from (from m except from l)""")
def h5_missing_keys(spark, sf):
    rows = predictions(spark, sf).select("artifact", "row_key", (F.col("line_number") - 1).alias("doc"))
    left = rows.filter("artifact = 'baseline' and doc % 20 <> 0")
    right = rows.filter("artifact = 'model' and doc % 30 <> 1")
    return ops.missing_keys(left, right)


THRESHOLDS = [
    ("min_rows", "row_count", ">=", 100.0),
    ("max_missing_target_rows", "missing_target_rows", "<=", 0.0),
    ("max_missing_prediction_rows", "missing_prediction_rows", "<=", 1e9),
    ("min_model_json_parse_rate", "json_parse_rate", ">=", 0.9),
    ("min_model_json_exact_match_rate", "json_exact_match_rate", ">=", 0.99),
    ("min_model_odata_id_match_rate", "odata_id_match_rate", ">=", None),
    ("max_model_ece", "ece", "<=", 0.5),
    ("max_model_latency_sec_p95", "latency_sec_p95", "<=", 0.99),
    ("min_unknown", "not_a_metric", ">=", 0.0),
]


def _threshold_rows(spark, rows, fallback=False):
    schema = "check_name string, metric string, operator string, threshold double" + (
        ", fallback double" if fallback else "")
    return spark.createDataFrame(rows, schema)


CHECK_SQL = f"""with {METRIC_SQL},
o as (unpivot (select artifact, {', '.join(f'{c}::double {c}' for c in [*COUNTS, *ROUNDED])} from met join ece using (artifact))
  on columns(* exclude artifact) into name metric value "value"),
th as (select * from (values {', '.join(
    f"('{n}', '{m}', '{op}', {'null' if t is None else t}::double)" for n, m, op, t in THRESHOLDS)})
  v(check_name, metric, operator, threshold)),
checked as (select artifact, check_name, metric, operator, threshold, round("value", 6) observed,
  coalesce(case operator when '>=' then "value" >= threshold else "value" <= threshold end, false) passed
  from (select * from th, (select distinct artifact from met)) left join o using (metric, artifact) where threshold is not null)
"""


def _checks(spark, sf):
    long = ops.metrics_long(ops.prediction_metrics(predictions(spark, sf)))
    return ops.acceptance_checks(long.select("artifact", "metric", "value"), _threshold_rows(spark, THRESHOLDS), by=["artifact"])


@query("c10_acceptance_checks", CHECK_SQL + "select * from checked")
def c10_acceptance_checks(spark, sf):
    return _checks(spark, sf).withColumn("observed", F.round("observed", 6))


@query("c10_acceptance_status", CHECK_SQL + """
select artifact, count(*) n_checks, count(*) filter (not passed) n_failed,
  case when bool_and(passed) then 'pass' else 'fail' end status from checked group by artifact""")
def c10_acceptance_status(spark, sf):
    return ops.acceptance_status(_checks(spark, sf), by=["artifact"])


# --- run reports -------------------------------------------------------------------------------


def runs(spark, sf):
    """Every customer as one run report."""
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    docs = table(spark, sf, "customer").select(key.alias("ord"), F.to_json(obj(
        ("manifest", obj(
            ("adapter_method", F.when(key % 3 == 0, "dora").when(key % 3 == 1, "lora")),
            ("adapter_rank", F.when(key % 2 == 0, key % 16)), ("model", seg), ("tokenizer", "t"),
            ("adapter_init", F.when(key % 5 == 0, "pissa")), ("max_steps", key % 4))),
        ("metrics", obj(("loss", F.col("c_acctbal")), ("acc", F.when(key % 4 != 0, key)))),
    )).alias("value"))
    return docs.select("ord", F.from_json(F.get_json_object("value", "$.manifest"), "map<string,string>")
                       .alias("manifest"),
                       F.from_json(F.get_json_object("value", "$.metrics"), "map<string,double>").alias("metrics"))


RUN_SQL = """
run as (select c_custkey ord, case when c_custkey % 3 = 0 then 'dora' else 'lora' end||
  coalesce('-r'||case when c_custkey % 2 = 0 then c_custkey % 16 end, '')||
  case when c_custkey % 5 = 0 then '-pissa' else '' end arm, c_acctbal loss,
  case when c_custkey % 4 <> 0 then c_custkey::double end acc from customer),
last as (select arm, arg_max(loss, ord) loss, max(ord) ord, min(ord) first_ord from run group by arm),
vals as (select l.arm, l.loss, l.first_ord, r.acc from last l join run r on r.arm = l.arm and r.ord = l.ord),
b as (select * from vals where arm = (select arg_min(arm, first_ord) from vals where starts_with(arm, 'lora')))
"""


@query("e10_compare_runs", f"""with {RUN_SQL}
select v.arm, 'loss' metric, round(v.loss, 6) "value", round(v.loss - b.loss, 6) delta from vals v, b
union all select v.arm, 'acc', v.acc, v.acc - b.acc from vals v, b""")
def e10_compare_runs(spark, sf):
    return ops.compare_runs(runs(spark, sf)).select("arm", "metric", *rounded(["value", "delta"]))


@query("e11_fairness_issues", """
select 'model' field, count(distinct c_mktsegment) n_values, min(c_mktsegment) least, max(c_mktsegment) greatest
from customer
union all select 'max_steps', count(distinct c_custkey % 4), min(c_custkey % 4)::varchar, max(c_custkey % 4)::varchar
from customer""")
def e11_fairness_issues(spark, sf):
    return ops.fairness_issues(runs(spark, sf))


@query("e13_masked_accuracy_perplexity", """
with t as (select event_type, event_id % 7 pred, case when event_id % 3 = 0 then -100 else event_id % 5 end label,
  "value" / 100 loss from events)
select event_type, count(*) filter (label <> -100) n_tokens,
  round(avg((pred = label)::int) filter (label <> -100), 6) accuracy,
  round(exp(sum(loss) filter (label <> -100) / count(*) filter (label <> -100)), 6) perplexity from t group by 1""")
def e13_masked_accuracy_perplexity(spark, sf):
    eid = F.col("event_id")
    tokens = table(spark, sf, "events").select(
        "event_type", (eid % 7).alias("prediction"), F.when(eid % 3 == 0, -100).otherwise(eid % 5).alias("label"),
        (F.col("value") / 100).alias("loss"))
    return ops.masked_accuracy(tokens, "event_type").select(
        "event_type", "n_tokens", *rounded(["accuracy", "perplexity"]))


@query("e14_exact_match_accuracy_f1", """
with j as (select lang, text, case when doc_id % 3 = 0 then '  '||text||' ' else upper(text) end tp, quality label,
  case when doc_id % 5 = 0 then 1 - quality else quality end lp from documents join labels using (doc_id))
select lang, round(avg((trim(text) = trim(tp))::int), 6) exact_match, round(avg((label = lp)::int), 6) accuracy,
  round(coalesce(2.0 * count(*) filter (label = 1 and lp = 1) / nullif(2 * count(*) filter (label = 1 and lp = 1) +
  count(*) filter (label <> lp), 0), 0)::double, 6) f1 from j group by lang""")
def e14_exact_match_accuracy_f1(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    doc = F.col("doc_id")
    rows = rows.select(
        "lang", "text", F.when(doc % 3 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.upper("text"))
        .alias("text_pred"), F.col("quality").alias("label"),
        F.when(doc % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("label_pred"))
    return ops.exact_match_f1(rows, "lang").select("lang", *rounded(["exact_match", "accuracy", "f1"]))


@query("e19_stage_summary", """
select event_type, round(avg("value"), 6) mean, round(median("value"), 6) median, max("value") "max", min("value") "min"
from events group by event_type""")
def e19_stage_summary(spark, sf):
    return ops.stage_summary(table(spark, sf, "events"), "event_type", "value").select(
        "event_type", *rounded(["mean", "median"]), "max", "min")


def ordered_lists(spark, sf):
    """Parts of an order by line, and the same list with a hash-chosen drop and a reversal."""
    first = mix.first_seen(inputs.line_captures(spark, sf).select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_seq"),
                           ["o_orderkey", "l_linenumber"], ["l_seq"])
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    # An order holds at most one first capture per line number, so the list is short.
    lists = first.groupBy("o_orderkey").agg(F.array_distinct(F.transform(items, lambda s: s["l_partkey"])).alias("e"))
    kept = F.filter("e", lambda p: (p + F.col("o_orderkey")) % 4 != 0)
    return lists.withColumn("p", F.when(F.col("o_orderkey") % 2 == 0, F.reverse(kept)).otherwise(kept))


LIST_SQL = f"""{inputs.TREE_SQL},
one as (select l_orderkey k, l_linenumber n, arg_min(l_partkey, seq) p from lin group by all),
ded as (select k, p, min(n) n from one group by all),
e as (select k, p, row_number() over (partition by k order by n) i from ded),
kept as (select k, p, row_number() over (partition by k order by case when k % 2 = 0 then -i else i end) j from e
  where (p + k) % 4 <> 0),
sz as (select k, count(*) ne from e group by k),
sp as (select k, count(*) np from kept group by k),
sizes as (select k, ne, coalesce(np, 0) np from sz left join sp using (k))
"""


@query("e21_set_prf", f"""with {LIST_SQL}
select k o_orderkey, case when np = 0 then 0 else 1.0 end::double "precision", round(np / ne, 6) recall,
  round(2 * np / (ne + np), 6) f1 from sizes""")
def e21_set_prf(spark, sf):
    scores = ops.set_scores(F.col("e"), F.col("p"))
    return ordered_lists(spark, sf).select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in scores.items()])


@query("e21_brier_nll", f"""with {PRED_SQL}
select artifact, round(avg(pow(conf - exact_match::int, 2)), 6) brier,
  round(avg(-ln(greatest(case when exact_match then conf else 1 - conf end, 1e-12))), 6) nll
from flag where conf is not null and exact_match is not null group by artifact""")
def e21_brier_nll(spark, sf):
    rows = predictions(spark, sf).filter("confidence is not null and exact_match is not null")
    return ops.probability_scores(rows.withColumn("correct", F.col("exact_match")), "artifact").select(
        "artifact", *rounded(["brier", "nll"]))


@query("e21_leaf_scores", f"""with {PRED_SQL}
select 2 * count(*) n, round(sum(case when parse_ok then 2.0 else 0 end)::double / (2 * count(*)), 6) key_presence,
  round(sum(case when parse_ok then (ok2::int + idok::int) else 0 end)::double / (2 * count(*)), 6) value_exact
from (select flag.*, {h_sql("'ok'||artifact||':'||doc_id")} < 0.8 ok2 from flag) where has_target""")
def e21_leaf_scores(spark, sf):
    from treecorpus.operators.json_walk import is_scalar, json_walk

    rows = predictions(spark, sf).select("artifact", "line_number", "target_json", "prediction_json")
    on = ["artifact", "line_number"]
    target = json_walk(rows, carry=on, body="target_json").filter(is_scalar())
    guess = json_walk(rows, carry=on, body="prediction_json").filter(is_scalar())
    return ops.leaf_scores(target.select(*on, "path", "value"), guess.select(*on, "path", "value"), on).select(
        "n", *rounded(["key_presence", "value_exact"]))


@query("e22_kendall_tau", f"""with {LIST_SQL}
select k o_orderkey, case when np > 1 then case when k % 2 = 0 then -1.0 else 1.0 end::double end tau from sizes""")
def e22_kendall_tau(spark, sf):
    return ordered_lists(spark, sf).select("o_orderkey", F.round(ops.kendall_tau(F.col("e"), F.col("p")), 6).alias("tau"))


@query("e22_edit_distance", f"""with {LIST_SQL},
-- Each item as one letter: its place in the first list.
es as (select k, string_agg(chr((64 + i)::int), '' order by i) a from e group by k),
ps as (select kept.k, string_agg(chr((64 + i)::int), '' order by j) b from kept join e using (k, p) group by kept.k)
select k o_orderkey, levenshtein(a, coalesce(b, ''))::int distance from es left join ps using (k)""")
def e22_edit_distance(spark, sf):
    return ordered_lists(spark, sf).select("o_orderkey", ops.edit_distance(F.col("e"), F.col("p")).alias("distance"))


@query("k21_rouge", """
with t as (select conv_id, turn, text target, lead(text) over (partition by conv_id order by turn) prediction
  from conversations),
g as (select conv_id, turn, unnest(list_filter(string_split_regex(lower(target), '[^a-z0-9]+'), lambda w: w <> '')) w,
  1 t, 0 p from t where prediction is not null
  union all select conv_id, turn, unnest(list_filter(string_split_regex(lower(prediction), '[^a-z0-9]+'),
  lambda w: w <> '')), 0, 1 from t where prediction is not null),
c as (select conv_id, turn, w, sum(t) t, sum(p) p from g group by all)
select conv_id, turn, round(2 * sum(least(t, p)) / sum(t + p), 6) rouge from c group by all""")
def k21_rouge(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    reply = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    rows = turns.withColumnRenamed("text", "target").join(reply, ["conv_id", "turn"])
    return ops.rouge_n(rows, ["conv_id", "turn"]).select("conv_id", "turn", *rounded(["rouge"]))


@query("k6_safe_value", """
select p_partkey, p_name, case when regexp_full_match(p_brand, '[A-Za-z0-9_ -]{1,64}') then p_brand
  else '<redacted-string>' end brand from part""")
def k6_safe_value(spark, sf):
    body = F.to_json(obj(("n", F.col("p_name")), ("a", F.array(obj(("b", F.col("p_brand")))))))
    safe = json_text.safe_payload(body)
    return table(spark, sf, "part").select("p_partkey", F.get_json_object(safe, "$.n").alias("p_name"),
                                           F.get_json_object(safe, "$.a[0].b").alias("brand"))


@query("k7_redact_keys", """
select 'part' source, 'api_key' key, count(*) n from part union all select 'part', 'AuthToken', count(*) from part""")
def k7_redact_keys(spark, sf):
    brand = F.col("p_brand")
    values = json_text.redact_map(F.create_map(
        F.lit("api_key"), brand, F.lit("AuthToken"), brand, F.lit("brand"), brand))
    rows = table(spark, sf, "part").select(F.explode(values).alias("key", "value"))
    return rows.filter("value = '<redacted>'").groupBy(F.lit("part").alias("source"), "key").agg(
        F.count("*").alias("n"))
