"""Labelled request rows and ordered call rows: build, render, parse, align, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.functions.json_text import pretty_json_value
from treecorpus.schemas import READ_METHODS


def context_violations(labels: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(row_id, rest_api, problem)``: labels absent from the row's contexts, and repeated contexts."""
    known = contexts.select("row_id", "rest_api").distinct()
    missing = labels.select("row_id", "rest_api").distinct().join(known, ["row_id", "rest_api"], "left_anti")
    repeated = contexts.groupBy("row_id", "rest_api").agg(F.count("*").alias("n")).filter("n > 1")
    return missing.withColumn("problem", F.lit("rest_api not present in current context")).unionByName(
        repeated.select("row_id", "rest_api", F.lit("duplicate rest_api in context").alias("problem")))


def build_list_rows(requests: DataFrame, labels: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(row_id, text, rest_api_list, allowed_methods)`` of rows without violations, labels in order."""
    bad = context_violations(labels, contexts).select("row_id").distinct()
    contexts = contexts.join(bad, "row_id", "left_anti")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "rest_api")))
    # One request names few resources; the list is the row's own target.
    lists = labels.groupBy("row_id").agg(F.transform(in_order, lambda s: s["rest_api"]).alias("rest_api_list"))
    methods = contexts.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "rest_api", F.transform("allowed_methods", F.upper)))).alias("allowed_methods"))
    return requests.join(bad, "row_id", "left_anti").join(lists, "row_id").join(methods, "row_id", "left")


def context_json(contexts: DataFrame, order: str = "rest_api") -> DataFrame:
    """``(row_id, json)``: the bodies of each row's contexts ``(row_id, rest_api, body)`` as one JSON list, by ``order``."""
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "body")))
    # One request shows few resources.
    return contexts.groupBy("row_id").agg(F.concat(
        F.lit("["), F.array_join(F.transform(in_order, lambda s: s["body"]), ","), F.lit("]")).alias("json"))


def default_method(allowed: Column) -> Column:
    """GET when allowed, else the first method, else GET."""
    return F.when(F.array_contains(allowed, "GET"), "GET").otherwise(
        F.coalesce(F.try_element_at(allowed, F.lit(1)), F.lit("GET")))


def call_rows(labels: DataFrame, contexts: DataFrame, explicit: DataFrame) -> DataFrame:
    """``(row_id, pos, rest_api, allowed_methods, method, arguments, error)`` per label.

    ``explicit(row_id, rest_api, method, arguments)`` overrides the default method. Arguments of
    reads are always empty. A method that is not allowed gives an error.
    """
    rows = labels.join(
        contexts.select("row_id", "rest_api", F.transform("allowed_methods", F.upper).alias("allowed_methods")),
        ["row_id", "rest_api"],
    ).join(explicit.select("row_id", "rest_api", F.upper("method").alias("given"), "arguments"),
           ["row_id", "rest_api"], "left")
    rows = rows.withColumn("method", F.coalesce("given", default_method(F.col("allowed_methods"))))
    error = F.when(~F.array_contains("allowed_methods", F.col("method")), F.concat(
        F.lit("method "), "method", F.lit(" is not in allowed_methods for "), "rest_api"))
    arguments = F.when(F.col("method").isin(READ_METHODS), "{}").otherwise(F.coalesce("arguments", F.lit("{}")))
    return rows.select("row_id", "pos", "rest_api", "allowed_methods", "method", arguments.alias("arguments"),
                       error.alias("error"))


def collect_calls(calls: DataFrame) -> DataFrame:
    """``(row_id, calls)`` in label order, of rows without an error."""
    bad = calls.filter("error is not null").select("row_id").distinct()
    call = F.struct("rest_api", "allowed_methods", "method", "arguments")
    in_order = F.array_sort(F.collect_list(F.struct("pos", call.alias("call"))))
    return calls.join(bad, "row_id", "left_anti").groupBy("row_id").agg(
        F.transform(in_order, lambda s: s["call"]).alias("calls"))


def render_list_rows(rows: DataFrame) -> DataFrame:
    """``prompt``, ``target_json`` and ``target_char_start`` of list rows ``(text, json, allowed_methods, rest_api_list)``.

    ``json`` is the JSON text of the context bodies, ``allowed_methods`` a map.
    """
    # Section headings of the prompt.
    prompt = F.concat(
        F.lit("### Operator Text\n"), "text", F.lit("\n\n### Current Redfish JSON\n"), pretty_json_value(F.col("json")),
        F.lit("\n\n### Allowed Methods\n"), pretty_json_value(F.to_json("allowed_methods")),
        F.lit("\n\n### Ordered REST API List\n"))
    return _rendered(rows, prompt, F.to_json(F.struct("rest_api_list")))


def render_call_rows(rows: DataFrame) -> DataFrame:
    """As :func:`render_list_rows` for call rows, which also show the list and have ``calls``."""
    # Section headings of the prompt.
    prompt = F.concat(
        F.lit("### Operator Text\n"), "text", F.lit("\n\n### Ordered REST API List\n"),
        pretty_json_value(F.to_json("rest_api_list")),
        F.lit("\n\n### Current Redfish JSON\n"), pretty_json_value(F.col("json")),
        F.lit("\n\n### Allowed Methods\n"), pretty_json_value(F.to_json("allowed_methods")),
        F.lit("\n\n### Ordered REST Calls\n"))
    typed = F.transform("calls", lambda c: F.struct(
        c["rest_api"].alias("rest_api"), c["allowed_methods"].alias("allowed_methods"), c["method"].alias("method"),
        F.parse_json(c["arguments"]).alias("arguments")))
    return _rendered(rows, prompt, F.to_json(F.struct(typed.alias("calls"))))


def _rendered(rows: DataFrame, prompt: Column, target: Column) -> DataFrame:
    rows = rows.withColumns({"prompt": prompt, "target_json": pretty_json_value(target)})
    return rows.withColumn("target_char_start", F.length("prompt"))


def inference_handoff(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "text", F.col("calls").alias("ordered_goals"))


def minimal_next_phase(rows: DataFrame) -> DataFrame:
    """What the call phase is given: text, ordered list, bodies, and methods."""
    return rows.select("row_id", "text", "rest_api_list", "json", "allowed_methods")


# The fields of a call in the order they are looked at, the VARIANT kind of each, and the wording of the failures.
CALL_FIELDS = {"rest_api": ("STRING", "a string"), "allowed_methods": ("ARRAY", "a list"), "method": ("STRING", "a string"),
               "arguments": ("OBJECT", "an object")}
NOT_JSON, NOT_OBJECT, INNER_NOT_OBJECT = "invalid_json", "y_pred must be an object", "y_pred.y_pred must be an object"
READ_WITH_ARGUMENTS = "read-only y_pred.calls.arguments must be empty"


def _is(value: Column, kind: str) -> Column:
    """Whether a VARIANT is of a kind; a missing one is of none."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _member(value: Column, name: str) -> Column:
    """A member as VARIANT: null only where the object has none of the name."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def _texts(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<string>")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _all_strings(value: Column) -> Column:
    return F.forall(_items(value), lambda v: _is(v, "STRING"))


def _first(cases: list[tuple[Column, Column | str]]) -> Column:
    """The message of the first case that holds, null if none does."""
    return F.coalesce(*[F.when(case, F.lit(message) if isinstance(message, str) else message) for case, message in cases])


def _listed(text: Column, field: str) -> Column:
    """``struct(error, list)`` of the named list of a prediction text, as VARIANT; an object under ``y_pred`` is looked into."""
    whole = F.try_parse_json(text)
    inner = _member(whole, "y_pred")
    held = F.when(inner.isNull(), whole).otherwise(inner)
    found = _member(held, field)
    error = _first([
        (whole.isNull(), NOT_JSON), (~_is(whole, "OBJECT"), NOT_OBJECT), (~_is(held, "OBJECT"), INNER_NOT_OBJECT),
        (~_is(found, "ARRAY"), f"y_pred.{field} must be a list")])
    return F.struct(error.alias("error"), found.alias("list"))


def _call_error(call: Column) -> Column:
    """What is wrong with a call, as a table of cases in order of precedence."""
    part = {name: _member(call, name) for name in CALL_FIELDS}
    method = F.upper(F.try_variant_get(call, "$.method", "string"))
    absent = F.array_compact(F.array(*[F.when(value.isNull(), F.lit(f"'{name}'")) for name, value in part.items()]))
    shape = {name: (~_is(part[name], kind), f"y_pred.calls.{name} must be {label}") for name, (kind, label) in CALL_FIELDS.items()}
    allowed = F.transform(_texts(part["allowed_methods"]), F.upper)
    return _first([
        (~_is(call, "OBJECT"), "each y_pred.calls item must be an object"),
        (F.size(absent) > 0, F.concat(F.lit("y_pred.calls item missing required field(s): ["), F.array_join(absent, ", "), F.lit("]"))),
        shape["rest_api"], shape["allowed_methods"],
        (~_all_strings(part["allowed_methods"]), "each y_pred.calls.allowed_methods item must be a string"),
        shape["method"],
        (~F.array_contains(allowed, method), F.concat(
            F.lit("y_pred.calls.method "), method, F.lit(" is not in allowed_methods for "), F.try_variant_get(call, "$.rest_api", "string"))),
        shape["arguments"],
        (method.isin(READ_METHODS) & (F.schema_of_variant(part["arguments"]) != "OBJECT<>"), READ_WITH_ARGUMENTS)])


def parse_calls(text: Column) -> Column:
    """Strict reading of ordered calls: ``struct(error, calls)``. Objects that repeat a key are no valid JSON here."""

    def read(found: Column) -> Column:
        calls = _items(found["list"])
        error = F.coalesce(found["error"], F.try_element_at(F.filter(F.transform(calls, _call_error), lambda e: e.isNotNull()), F.lit(1)))
        typed = F.transform(calls, lambda c: F.struct(
            F.try_variant_get(c, "$.rest_api", "string").alias("rest_api"), F.transform(_texts(_member(c, "allowed_methods")), F.upper).alias("allowed_methods"),
            F.upper(F.try_variant_get(c, "$.method", "string")).alias("method"), F.to_json(_member(c, "arguments")).alias("arguments")))
        return F.struct(error.alias("error"), typed.alias("calls"))

    return _settled(_listed(text, "calls"), read, "calls")


def parse_list(text: Column) -> Column:
    """Strict reading of an ordered list: ``struct(error, rest_api_list)``."""

    def read(found: Column) -> Column:
        error = _first([(found["error"].isNotNull(), found["error"]), (~_all_strings(found["list"]), "each y_pred.rest_api_list item must be a string")])
        return F.struct(error.alias("error"), _texts(found["list"]).alias("rest_api_list"))

    return _settled(_listed(text, "rest_api_list"), read, "rest_api_list")


def _settled(found: Column, read, name: str) -> Column:
    """``read`` of what was found, each worked out once per row; the value is null where there is an error."""
    once = lambda value, use: F.transform(F.array(value), use)[0]
    return once(once(found, read), lambda r: F.struct(r["error"].alias("error"), F.when(r["error"].isNull(), r[name]).alias(name)))


def align_calls(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Position by position: ``(row_id, pos, e, p)``, either side null past its end."""
    call = F.struct("rest_api", "allowed_methods", "method", "arguments")
    left = expected.select("row_id", "pos", call.alias("e"))
    right = predicted.select("row_id", "pos", call.alias("p"))
    return left.join(right, ["row_id", "pos"], "full")


RATES = ["call_ordered_exact_match_rate", "call_order_correct_rate", "allowed_methods_exact_match_rate",
         "method_exact_match_rate", "arguments_exact_match_rate", "arguments_json_parse_rate", "invalid_method_rate",
         "readonly_empty_arguments_rate"]


def evaluate_calls(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of rates per prediction ``(row_id, raw)`` against ``(row_id, pos, call…)``."""
    parsed = predicted.withColumn("parsed_calls", parse_calls(F.col("raw"))).select(
        "row_id", F.col("parsed_calls.error").alias("parse_error"), F.col("parsed_calls.calls").alias("calls"))
    guessed = parsed.select("row_id", F.posexplode("calls").alias("pos", "c")).select("row_id", "pos", "c.*")
    pairs = align_calls(expected, guessed)
    same = lambda f: F.count_if(F.col(f"e.{f}") == F.col(f"p.{f}"))
    read = lambda side: F.col(f"{side}.method").isin(READ_METHODS)
    counted = pairs.groupBy("row_id").agg(
        F.count("e").alias("n_expected"), F.count("p").alias("n_predicted"),
        F.count_if(F.col("e").isNotNull() | F.col("p").isNotNull()).alias("n"),
        F.count_if(F.col("e") == F.col("p")).alias("exact"),
        same("rest_api").alias("rest_api"), same("allowed_methods").alias("allowed"), same("method").alias("method"),
        same("arguments").alias("arguments"), F.count_if(read("e")).alias("n_read"),
        F.count_if(read("e") & read("p") & (F.col("p.arguments") == "{}")).alias("read_ok"))
    rows = parsed.select("row_id", "parse_error").join(counted, "row_id", "left")
    ok = F.col("parse_error").isNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda a, b: F.when(~ok, 0.0).otherwise(F.coalesce(F.try_divide(zero(a), zero(b)), F.lit(1.0)))
    exact = ok & (zero("exact") == zero("n"))
    return rows.select(
        "row_id", "parse_error", zero("n_expected").alias("n_expected"),
        F.when(ok, zero("n_predicted")).otherwise(0).alias("n_predicted"),
        exact.cast("double").alias("call_ordered_exact_match_rate"),
        rate("rest_api", "n").alias("call_order_correct_rate"),
        rate("allowed", "n").alias("allowed_methods_exact_match_rate"),
        rate("method", "n").alias("method_exact_match_rate"),
        rate("arguments", "n").alias("arguments_exact_match_rate"),
        ok.cast("double").alias("arguments_json_parse_rate"),
        (~ok & F.coalesce(F.col("parse_error").contains("not in allowed_methods"), F.lit(False))).cast("double")
        .alias("invalid_method_rate"),
        rate("read_ok", "n_read").alias("readonly_empty_arguments_rate"))


def call_metrics(rows: DataFrame) -> DataFrame:
    """Mean rates over all rows."""
    return rows.agg(
        F.count("*").alias("rows_total"), F.count_if(F.col("parse_error").isNull()).alias("parsed_total"),
        F.count_if(F.col("call_ordered_exact_match_rate") == 1).alias("accepted_total"),
        *[F.avg(c).alias(c) for c in RATES])
