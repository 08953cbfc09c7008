"""Judged request drafts: parse, compare sets, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted order evidence.
ORDER_EVIDENCE = ["explicit_after", "explicit_before", "explicit_then", "none", "numbered_steps"]


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parse_judge(rows: DataFrame) -> DataFrame:
    """Add ``accepted, rest_api_list, nonsense, invalid_json, reason, order_evidence`` from ``raw``.

    Never fails: each malformed answer has its reason.
    """
    get = lambda v, n: F.try_variant_get(v, f"$.{n}", "variant")
    v = rows.withColumn("v", F.try_parse_json("raw"))
    v = v.withColumn("inner", get(F.col("v"), "y_pred"))
    v = v.withColumn("p", F.when(_kind(F.col("inner")).startswith("OBJECT"), F.col("inner")).otherwise(F.col("v")))
    p = F.col("p")
    v = v.withColumns({
        "as_list": get(p, "rest_api_list"), "as_set": get(p, "rest_api_set"), "acc": get(p, "accepted"),
        "acc2": get(p, "accept"), "non": get(p, "nonsense"), "ord": get(p, "order_evidence"),
        "why": F.try_variant_get(p, "$.reason", "string"), "p_kind": _kind(p)})
    v = v.withColumns({
        "field": F.when(F.col("as_list").isNotNull(), "rest_api_list").when(F.col("as_set").isNotNull(), "rest_api_set"),
        "list_kind": _kind(F.coalesce("as_list", "as_set")),
        "acc_field": F.when(F.col("acc").isNotNull(), "accepted").when(F.col("acc2").isNotNull(), "accept"),
        "acc_kind": _kind(F.coalesce("acc", "acc2")), "non_kind": _kind(F.col("non")),
        "evidence": F.when(F.col("ord").isNull(), "none").when(
            _kind(F.col("ord")) == "STRING", F.try_variant_get("ord", "$", "string")).otherwise("")})
    failure = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(~F.col("p_kind").startswith("OBJECT"), "judge result is not a mapping")
        .when(F.col("field").isNull(), "rest_api_list or rest_api_set is required")
        .when(~F.col("list_kind").startswith("ARRAY"), F.concat("field", F.lit(" is not a list")))
        .when(~F.col("list_kind").isin("ARRAY<STRING>", "ARRAY<VOID>"),
              F.concat("field", F.lit(" must contain only strings")))
        .when(F.col("acc_field").isNull(), "accepted or accept is required")
        .when(F.col("acc_kind") != "BOOLEAN", F.concat("acc_field", F.lit(" must be a boolean")))
        .when(F.col("non_kind").isNull() | (F.col("non_kind") != "BOOLEAN"), "nonsense must be a boolean")
        .when(~F.col("evidence").isin(ORDER_EVIDENCE), "order_evidence must be one of " + ", ".join(ORDER_EVIDENCE)))
    v = v.withColumn("failure", failure)
    good = F.col("failure").isNull()
    boolean = lambda c: F.when(good, F.try_variant_get(c, "$", "boolean")).otherwise(False)
    items = F.try_variant_get(F.coalesce("as_list", "as_set"), "$", "array<string>")
    return v.select(
        *rows.columns,
        boolean(F.coalesce("acc", "acc2")).alias("accepted"),
        F.when(good, items).otherwise(F.array().cast("array<string>")).alias("rest_api_list"),
        boolean(F.col("non")).alias("nonsense"), (~good).alias("invalid_json"),
        F.coalesce("failure", "why", F.lit("")).alias("reason"),
        F.when(good, F.col("evidence")).otherwise("none").alias("order_evidence"))


def set_match(left: Column, right: Column) -> Column:
    """The same items, whatever their order and number."""
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def coverage(rows: DataFrame) -> DataFrame:
    """Add set flags of ``expected`` against the judged ``rest_api_list``."""
    judged = F.col("rest_api_list")
    same = ~F.col("invalid_json") & set_match(F.col("expected"), judged)
    return rows.withColumns({
        "set_match": same,
        "all_present": F.size(F.array_except("expected", judged)) == 0,
        "extra_present": F.size(F.array_except(judged, "expected")) > 0,
        "empty_expected": ~F.col("invalid_json") & (F.size("expected") == 0),
        "kept": F.col("accepted") & same & ~F.col("nonsense") & ~F.col("invalid_json")})


COUNTS = {
    "accepted_total": "kept", "nonsense_total": "nonsense", "invalid_json_total": "invalid_json",
    "pro_accept_total": "accepted and not invalid_json", "rest_api_set_match_total": "set_match",
    "empty_set_expected_total": "empty_expected",
    "empty_set_match_total": "empty_expected and size(rest_api_list) = 0",
}


def judge_counters(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals and zero-safe rates of covered rows per group."""
    totals = rows.groupBy(*by).agg(
        F.count("*").alias("draft_total"), F.count_if(~F.col("kept")).alias("rejected_total"),
        *[F.count_if(F.expr(test)).alias(name) for name, test in COUNTS.items()])
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return totals.withColumns({
        "nonsense_rate": rate(F.col("nonsense_total"), F.col("draft_total")),
        "invalid_json_rate": rate(F.col("invalid_json_total"), F.col("draft_total")),
        "pro_accept_rate": rate(F.col("pro_accept_total"), F.col("draft_total")),
        "rest_api_set_match_rate": rate(F.col("rest_api_set_match_total"), F.col("draft_total")),
        "empty_set_match_rate": rate(F.col("empty_set_match_total"), F.col("empty_set_expected_total"))})


def join_provider_outputs(candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs by candidate index; ``error`` where a provider had too few lines."""
    rows = candidates.join(outputs.select("candidate", "output"), "candidate", "left")
    return rows.withColumn("error", F.when(F.col("output").isNull(), "not enough provider lines"))
