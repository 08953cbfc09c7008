"""Records as uniform examples, and rendered prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.functions.classify import resource_kind
from treecorpus.functions.json_text import pretty_json, spaced_json
from treecorpus.functions.urls import odata_id, odata_type
from treecorpus.schemas import IDEMPOTENT_METHODS, READ_METHODS, WRITE_METHODS, trust_name


def compact_resource(body: Column) -> Column:
    """``struct(id, type, keys)``; a body that is not an object gives blanks and no keys."""
    keys = F.array_sort(F.filter(F.json_object_keys(body), lambda k: ~k.startswith("@")))
    return F.struct(
        F.coalesce(odata_id(body), F.lit("")).alias("id"), F.coalesce(odata_type(body), F.lit("")).alias("type"),
        F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))


def normalize_records(records: DataFrame, enriched: bool = False) -> DataFrame:
    """State before and after, request, response and derived semantics of each capture."""
    verb = F.upper("method")
    allowed = F.coalesce("allowed_methods", F.array().cast("array<string>"))
    state = compact_resource(F.col("body"))
    kind = resource_kind(F.col("url"), F.col("body")) if enriched else F.lit(None).cast("string")
    semantics = F.struct(
        verb.alias("method"), (~verb.isin(READ_METHODS)).alias("mutating"),
        verb.isin(READ_METHODS).alias("read_only"), verb.isin(IDEMPOTENT_METHODS).alias("idempotent"),
        F.lit(200).alias("expected_status"),
        F.exists(allowed, lambda m: F.upper(m).isin(WRITE_METHODS)).alias("mutable_endpoint"),
        kind.alias("resource_kind"))
    return records.select(
        "source", trust_name(F.col("trust")).alias("trust_level"), "schema_version", "url",
        state.alias("state_before"), state.alias("state_after"),
        F.struct("method", "url", F.lit(None).cast("string").alias("body")).alias("request"),
        F.col("body").alias("response"), allowed.alias("allowed_methods"), semantics.alias("semantics"), "vendor",
        *[c for c in ("seq", "split") if c in records.columns])


def prompt_pairs(rows: DataFrame) -> DataFrame:
    """``prompt`` and ``completion`` of reconstruction rows.

    Rows carry either ``input_json`` (with ``target_json``, which may be null, and ``rest_api``)
    or the normalized ``request``/``response``.
    """
    if "input_json" in rows.columns:
        body = F.col("input_json")
        target = F.coalesce("target_json", "input_json")
        api = F.col("rest_api")
    else:
        body = target = F.col("response")
        api = F.col("request.url")
    rest_api = F.coalesce(F.nullif(api, F.lit("")), odata_id(body), F.lit(""))
    methods = F.transform("allowed_methods", F.upper)
    shown = F.when(F.size(methods) > 0, F.array_join(methods, ", ")).otherwise("UNKNOWN")
    # Section headings of the prompt.
    prompt = F.concat(
        F.lit("### REST API\n"), rest_api, F.lit("\n\n### Allowed Methods\n"), shown,
        F.lit("\n\n### Redfish JSON Input\n"), pretty_json(body), F.lit("\n\n### Complete Redfish JSON\n"))
    return rows.withColumns({"prompt": prompt, "completion": F.concat(pretty_json(target), F.lit("\n"))})


def request_text(rows: DataFrame) -> DataFrame:
    """``text``: method, URL, and the body with sorted keys."""
    head = F.concat(F.coalesce("request.method", F.lit("GET")), F.lit(" "), F.coalesce("request.url", F.lit("")))
    return rows.withColumn("text", F.concat(head, F.lit("\n"), spaced_json(F.col("response"))))
