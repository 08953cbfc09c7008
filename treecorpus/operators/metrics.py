"""Prediction rows and their metrics: match rates, calibration, percentiles, comparison, acceptance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from treecorpus.functions.classify import let
from treecorpus.functions.json_text import read_json
from treecorpus.operators.percentiles import exact_percentiles
from treecorpus.sources.corpus_io import json_lines, read_lines

# Where prediction rows may hold each field, in order of preference.
TARGET_PATHS = ["y_true.json", "target.json", "expected.json", "reference.json", "y_true", "target", "expected",
                "reference"]
PREDICTION_PATHS = [
    "y_pred.json", "y_pred.redfish_json", "y_pred.output_json", "y_pred.prediction", "y_pred.text", "y_pred.raw",
    "prediction.json", "prediction.text", "prediction.raw", "prediction", "predicted_json", "output_json",
    "generated_json", "generated_text", "completion", "output", "y_pred",
]
API_PATHS = ["x.rest_api", "rest_api", "uri", "url"]
KEY_PATHS = ["id", "row_id", "sample_id", "example_id", "uid"]
TOP_K_PATHS = ["y_pred_top_k", "top_k_predictions", "top_k", "candidates", "prediction.top_k", "y_pred.top_k"]
CANDIDATE_PATHS = ["json", "redfish_json", "prediction", "text", "raw"]
NUMBER_PATHS = {
    "generated_tokens": ["generated_tokens", "completion_tokens", "output_tokens", "tokens.generated",
                         "usage.completion_tokens", "metrics.generated_tokens"],
    "sequence_length": ["sequence_length", "seq_len", "tokens.sequence_length", "usage.total_tokens",
                        "metrics.sequence_length"],
    "padding_tokens": ["padding_tokens", "tokens.padding", "metrics.padding_tokens"],
    "latency_sec": ["latency_sec", "elapsed_sec", "duration_sec", "test_time_sec", "metrics.latency_sec",
                    "timing.latency_sec"],
    "memory_peak_mb": ["memory_peak_mb", "peak_memory_mb", "metrics.memory_peak_mb"],
    "confidence": ["confidence", "probability", "mean_token_probability", "calibration.confidence",
                   "metrics.confidence", "y_pred.confidence", "prediction.confidence"],
    "log_prob": ["log_prob", "logprob", "sequence_log_prob", "completion_log_prob", "metrics.log_prob"],
    "log_prob_per_token": ["log_prob_per_token", "mean_log_prob", "metrics.log_prob_per_token"],
}
WHOLE_NUMBERS = ["generated_tokens", "sequence_length", "padding_tokens"]


def first_path(value: Column, paths: list[str]) -> Column:
    """The first path that is present, as VARIANT. A present JSON null stops the search."""
    return F.coalesce(*[
        F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in p.split(".")), "variant") for p in paths
    ])


def read_predictions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, errors)`` of raw prediction lines; every non-blank line must be an object."""
    checked = json_lines(lines)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def load_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """:func:`read_predictions` of an artifact's files; one without any row is an error."""
    good, bad = read_predictions(read_lines(spark, path))
    if good.isEmpty() and bad.isEmpty():
        raise ValueError(f"no prediction rows in {path}")
    return good, bad


FIELDS = {"target": TARGET_PATHS, "prediction": PREDICTION_PATHS, "api": API_PATHS, "key": KEY_PATHS,
          "top_k": TOP_K_PATHS, **NUMBER_PATHS}
READ_SCHEMA = (
    "row_key string, rest_api string, target_json string, prediction_json string, parse string, parse_ok boolean, "
    "exact_match boolean, id_match boolean, top_k_match boolean, "
    + ", ".join(f"{n} {'bigint' if n in WHOLE_NUMBERS else 'double'}" for n in NUMBER_PATHS)
)


def _canonical(value) -> tuple[str | None, str]:
    """Canonical JSON of a container or of the JSON inside a text, and how it was read."""
    if value is None:
        return None, "missing prediction"
    if isinstance(value, (dict, list)):
        value = json.dumps(value)
    return read_json(value) if isinstance(value, str) else (None, "unsupported prediction type")


def _unwrapped(candidate):
    if isinstance(candidate, dict):
        return next((candidate[k] for k in CANDIDATE_PATHS if k in candidate), candidate)
    return candidate


def _as_number(value, whole: bool):
    try:
        number = None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None
    return int(number) if whole and number is not None else number


def _own_id(text: str | None):
    value = json.loads(text) if text is not None else None
    return value.get("@odata.id") if isinstance(value, dict) else None


def read_fields(found: dict, position: int) -> dict:
    """Evaluator fields of one row from the decoded values that :data:`FIELDS` found."""
    target, _ = _canonical(found["target"])
    target = None if target == "null" else target
    guess, how = _canonical(found["prediction"])
    ok = how in ("parsed", "fenced", "fragment")
    api, own = found["api"], _own_id(target)
    if not (isinstance(api, str) and api):
        api = own if isinstance(own, str) else ""
    key = found["key"]
    if key is None:
        identity = f'{{"rest_api":{json.dumps(api)},"target_json":{target or "null"}}}'
        key = f"position:{position}:identity:{hashlib.sha256(identity.encode()).hexdigest()[:16]}"
    else:
        key = f"id:{key}"
    top, top_match = found["top_k"], None
    if target is not None and top is not None:
        top_match = isinstance(top, list) and any(_canonical(_unwrapped(c))[0] == target for c in top)
    row = {
        "row_key": key, "rest_api": api, "target_json": target, "prediction_json": guess, "parse": how, "parse_ok": ok,
        "exact_match": None if target is None else ok and guess == target,
        "id_match": (ok and _own_id(guess) == api) if api else None, "top_k_match": top_match,
    }
    row.update({n: _as_number(found[n], n in WHOLE_NUMBERS) for n in NUMBER_PATHS})
    if row["confidence"] is not None:
        row["confidence"] = max(0.0, min(1.0, row["confidence"]))
    return row


def normalize_predictions(lines: DataFrame) -> DataFrame:
    """Evaluator fields of raw rows ``(artifact, line_number, line)``.

    Match flags are three-valued: ``exact_match`` is null without a target and false for an
    unparsable prediction; ``id_match`` is null without a URL. The paths are looked up in VARIANT;
    one Arrow stage then reads texts, so that the flags are plain columns for what follows.
    """
    base = [c for c in lines.columns if c != "line"]
    value = F.col("v")
    looked_up = lines.withColumn("v", F.try_parse_json("line")).select(
        *base, *[F.to_json(first_path(value, paths)).alias(f"_{name}") for name, paths in FIELDS.items()])
    kept = T.StructType([lines.schema[c] for c in base])
    out = T.StructType([*kept.fields, *T.StructType.fromDDL(READ_SCHEMA).fields])
    arrow = to_arrow_schema(out)

    def stage(batches):
        for batch in batches:
            columns = {n: batch.column(f"_{n}").to_pylist() for n in FIELDS}
            places = batch.column("line_number").to_pylist()
            rows = []
            for index, place in enumerate(places):
                found = {n: None if c[index] is None else json.loads(c[index]) for n, c in columns.items()}
                rows.append(read_fields(found, place - 1))
            arrays = [batch.column(c) for c in base]
            arrays += [pa.array([r[f.name] for r in rows], f.type) for f in arrow if f.name not in base]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return looked_up.mapInArrow(stage, out)


def parse_report(lines: DataFrame) -> DataFrame:
    """Rows per way a prediction was read, or failed to be."""
    return normalize_predictions(lines).groupBy("artifact", "parse").agg(F.count("*").alias("n"))


def _rate(hit: Column, known: Column) -> Column:
    return F.try_divide(F.count_if(hit), F.count_if(known))


def prediction_metrics(rows: DataFrame, by: str = "artifact", ece_bins: int = 10) -> DataFrame:
    """One row of metrics per artifact; a rate without a denominator is null."""
    latency = F.sum(F.coalesce("latency_sec", F.lit(0.0)))
    tokens = F.sum(F.coalesce("generated_tokens", F.lit(0)))
    weight = F.coalesce(F.nullif("generated_tokens", F.lit(0)), F.nullif("sequence_length", F.lit(0)), F.lit(1))
    per_token = F.coalesce(F.col("log_prob_per_token"), F.when(weight > 0, F.col("log_prob") / weight))
    used = F.when(per_token.isNotNull() & (weight > 0), weight)
    padding = F.when((F.col("sequence_length") != 0) & F.col("padding_tokens").isNotNull(),
                     F.col("padding_tokens") / F.col("sequence_length"))
    plain = rows.groupBy(by).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("target_json").isNull()).alias("missing_target_rows"),
        F.count_if(~F.col("parse_ok")).alias("missing_prediction_rows"),
        _rate(F.col("parse_ok"), F.lit(True)).alias("json_parse_rate"),
        _rate(F.col("exact_match"), F.col("exact_match").isNotNull()).alias("json_exact_match_rate"),
        _rate(F.col("id_match"), F.col("id_match").isNotNull()).alias("odata_id_match_rate"),
        _rate(F.col("top_k_match"), F.col("top_k_match").isNotNull()).alias("top_k_accuracy"),
        F.when(latency > 0, tokens / latency).alias("eval_tokens_per_sec"),
        F.when(latency > 0, F.count("*") / latency).alias("eval_samples_per_sec"),
        F.avg(padding).alias("padding_ratio"),
        F.avg("sequence_length").alias("mean_sequence_length"),
        F.max("sequence_length").cast("double").alias("max_sequence_length"),
        F.try_divide(F.sum(per_token * used), F.sum(used)).alias("log_prob_per_token"),
        F.max("memory_peak_mb").alias("memory_peak_mb"),
    )
    waits = exact_percentiles(rows, by, "latency_sec", {"latency_sec_p50": 0.5, "latency_sec_p95": 0.95})
    return plain.join(waits, by, "left").join(calibration_error(rows, by, ece_bins), by, "left")


def calibration_error(rows: DataFrame, by: str = "artifact", bins: int = 10) -> DataFrame:
    """``(by, ece)`` over rows with a confidence in [0, 1] and a known match; equal-width bins."""
    if bins <= 0:
        raise ValueError("ece bins must be positive")
    pairs = rows.filter(F.col("confidence").between(0.0, 1.0) & F.col("exact_match").isNotNull())
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    filled = pairs.groupBy(by, place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"),
        F.avg(F.col("exact_match").cast("double")).alias("accuracy"))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return filled.groupBy(by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def metrics_long(metrics: DataFrame, by: str = "artifact") -> DataFrame:
    """``(by, metric, value)``, nulls kept."""
    names = [c for c in metrics.columns if c != by]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(by, F.explode(pairs).alias("m")).select(by, "m.*")


def missing_keys(left: DataFrame, right: DataFrame, key: str = "row_key") -> DataFrame:
    """``(key, missing_from)`` in both directions."""
    gap = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn(
        "missing_from", F.lit(name))
    return gap(left, right, "model").unionByName(gap(right, left, "baseline"))


def compare_artifacts(long: DataFrame, baseline: str, model: str, by: str = "artifact") -> DataFrame:
    """``(metric, baseline, model, delta)``; the delta is null when either side is."""
    at = lambda name, col: F.max(F.when(F.col(by) == name, F.col("value"))).alias(col)
    rows = long.groupBy("metric").agg(at(baseline, "baseline"), at(model, "model"))
    return rows.withColumn("delta", F.col("model") - F.col("baseline"))


def acceptance_checks(observed: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Check ``(by…, metric, value)`` against ``(check_name, metric, operator, threshold, fallback)``, each group on its own.

    A null threshold is not checked; a missing or NaN value takes the fallback, and without one
    fails. Groups are few (artifacts): each is checked against every threshold, measured or not.
    """
    by = list(by)
    limits = thresholds.filter(F.col("threshold").isNotNull())
    if by:
        groups = observed.agg(F.collect_set(F.struct(*by))).scalar()
        limits = limits.withColumn("group", F.explode(groups)).select("*", *[F.col(f"group.{c}").alias(c) for c in by]).drop("group")
    rows = limits.join(observed, [*by, "metric"], "left")
    seen = F.coalesce("value", "fallback") if "fallback" in thresholds.columns else F.col("value")
    good = F.when(F.col("operator") == ">=", F.col("observed") >= F.col("threshold")).otherwise(
        F.col("observed") <= F.col("threshold"))
    return rows.withColumn("observed", seen).withColumn(
        "passed", F.coalesce(good & ~F.isnan("observed"), F.lit(False))
    ).select(*by, "check_name", "metric", "operator", "threshold", "observed", "passed")


def acceptance_status(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return checks.groupBy(*by).agg(
        F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"),
        F.when(F.coalesce(F.bool_and("passed"), F.lit(True)), "pass").otherwise("fail").alias("status"))


def arm_label(manifest: Column) -> Column:
    """Method, rank and non-default init of a run."""
    rank = F.coalesce(F.concat(F.lit("-r"), manifest["adapter_rank"]), F.lit(""))
    init = F.coalesce(manifest["adapter_init"], F.lit("default"))
    tail = F.when(init.isin("", "default"), "").otherwise(F.concat(F.lit("-"), init))
    return F.concat(F.coalesce(manifest["adapter_method"], F.lit("lora")), rank, tail)


def compare_runs(runs: DataFrame, baseline: str = "lora") -> DataFrame:
    """``(arm, metric, value, delta)`` of runs ``(ord, manifest, metrics)``.

    The base arm is the first (by ``ord``) that starts with the baseline label. Every arm shows
    every metric of any run; of runs with the same label the last counts.
    """
    arms = runs.withColumn("arm", arm_label(F.col("manifest")))
    last = arms.groupBy("arm").agg(F.max_by("metrics", "ord").alias("metrics"), F.min("ord").alias("first_ord"))
    base_arm = last.filter(F.col("arm").startswith(baseline)).agg(F.min_by("arm", "first_ord")).scalar()
    long = last.select("arm", F.explode("metrics").alias("metric", "value"))
    base = long.filter(F.col("arm") == base_arm).select("metric", F.col("value").alias("base"))
    # Arms are aligned on the metric names of all runs, a short list of configured names.
    names = arms.select(F.explode(F.map_keys("metrics")).alias("metric")).agg(F.collect_set("metric")).scalar()
    full = last.select("arm", F.explode(names).alias("metric"))
    return full.join(long, ["arm", "metric"], "left").join(base, "metric", "left").select(
        "arm", "metric", "value", (F.col("value") - F.col("base")).alias("delta"))


# Run header fields that must agree for a fair comparison.
FAIR_FIELDS = ["model", "tokenizer", "data_manifest", "eval_split", "max_steps", "seq_len"]


def fairness_issues(runs: DataFrame) -> DataFrame:
    """``(field, values)`` for fields with more than one value."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.coalesce(F.col("manifest")[f], F.lit("")).alias("value"))
        for f in FAIR_FIELDS
    ])
    seen = runs.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    return seen.groupBy("field").agg(F.count("*").alias("n_values"), F.min("value").alias("least"),
                                     F.max("value").alias("greatest")).filter("n_values > 1")


def masked_accuracy(tokens: DataFrame, by: str, ignore: int = -100) -> DataFrame:
    """Accuracy where the label is not ignored, and exp(total loss / tokens)."""
    known = F.col("label") != ignore
    return tokens.groupBy(by).agg(
        F.count_if(known).alias("n_tokens"),
        F.avg(F.when(known, (F.col("prediction") == F.col("label")).cast("double"))).alias("accuracy"),
        F.exp(F.try_divide(F.sum(F.when(known, F.col("loss"))), F.count_if(known))).alias("perplexity"))


def exact_match_f1(rows: DataFrame, by: str) -> DataFrame:
    """Stripped text equality, label accuracy and binary F1 of ``(text, text_pred, label, label_pred)``."""
    hit = lambda a, b: F.count_if((F.col("label") == a) & (F.col("label_pred") == b))
    tp, fp, fn = hit(1, 1), hit(0, 1), hit(1, 0)
    return rows.groupBy(by).agg(
        F.avg((F.trim("text") == F.trim("text_pred")).cast("double")).alias("exact_match"),
        F.avg((F.col("label") == F.col("label_pred")).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def stage_summary(rows: DataFrame, stage: str, value: str) -> DataFrame:
    plain = rows.groupBy(stage).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
    return plain.join(exact_percentiles(rows, stage, value, {"median": 0.5}), stage, "left")


def set_scores(expected: Column, predicted: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays as sets; two empty sets agree fully."""
    both = F.size(F.array_intersect(expected, predicted))
    n_expected, n_predicted = F.size(F.array_distinct(expected)), F.size(F.array_distinct(predicted))
    empty = (n_expected == 0) & (n_predicted == 0)
    share = lambda a, b: F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return {"precision": share(both, n_predicted), "recall": share(both, n_expected),
            "f1": share(2 * both, n_expected + n_predicted)}


def probability_scores(rows: DataFrame, by: str) -> DataFrame:
    """Brier score and negative log likelihood of ``(confidence, correct)``."""
    p = F.col("confidence")
    hit = F.col("correct")
    chance = F.greatest(F.when(hit, p).otherwise(1 - p), F.lit(1e-12))
    return rows.groupBy(by).agg(
        F.avg(F.pow(p - hit.cast("double"), 2)).alias("brier"), F.avg(-F.log(chance)).alias("nll"))


def leaf_scores(target: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """Share of target leaves whose path is predicted, and whose value is predicted too."""
    found = predicted.select(*on, "path", F.col("value").alias("p_value"), F.lit(True).alias("hit"))
    rows = target.join(found, [*on, "path"], "left")
    return rows.agg(
        F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(False)).cast("double")).alias("key_presence"),
        F.avg((F.coalesce("hit", F.lit(False)) & F.col("value").eqNullSafe(F.col("p_value"))).cast("double"))
        .alias("value_exact"))


@F.pandas_udf(T.IntegerType())
def edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Levenshtein distance of two lists, item by item."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return row[-1]

    return pd.Series([None if a is None or b is None else distance(a, b) for a, b in zip(left, right)])


def kendall_tau(expected: Column, predicted: Column) -> Column:
    """Tau-a over the common items of two duplicate-free lists; null below two common items."""
    common = F.array_intersect(expected, predicted)
    places = F.transform(common, lambda x: F.array_position(predicted, x))
    n = F.size(common)
    signs = F.flatten(F.transform(places, lambda p, i: F.transform(
        F.slice(places, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda q: F.signum((q - p).cast("double")))))
    total = F.aggregate(signs, F.lit(0.0), lambda a, s: a + s)
    return F.when(n > 1, total / (n * (n - 1) / 2))


def rouge_n(rows: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """F-measure of n-gram overlap of ``(target, prediction)`` per row; no stemming."""
    def grams(column: str, side: str) -> DataFrame:
        words = F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")
        spans = words if n == 1 else let(words, lambda w: F.when(F.size(w) >= n, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))),
            lambda i: F.array_join(F.slice(w, i, n), " "))))
        return rows.select(*keys, F.explode(spans).alias("gram")).groupBy(*keys, "gram").agg(
            F.count("*").alias(side))

    both = grams("target", "t").join(grams("prediction", "p"), [*keys, "gram"], "full")
    scored = both.groupBy(*keys).agg(
        F.sum(F.least(F.coalesce("t", F.lit(0)), F.coalesce("p", F.lit(0)))).alias("hit"),
        F.sum(F.coalesce("t", F.lit(0))).alias("nt"), F.sum(F.coalesce("p", F.lit(0))).alias("np"))
    f = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("nt") + F.col("np")), F.lit(0.0))
    return rows.select(*keys).join(scored, keys, "left").select(*keys, F.coalesce(f, F.lit(0.0)).alias("rouge"))
