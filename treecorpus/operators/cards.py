"""Tool cards: induce from observations, ground against a catalog, tally evidence, render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.operators.goals import variant_kind
from treecorpus.operators.json_walk import fingerprints, json_walk

KEY = ["tool", "op"]


def error_class(status: Column) -> Column:
    return (
        F.when(status.isin(409, 412), "precondition_unmet")
        .when((status == 429) | (status >= 500), "retriable").otherwise("fatal"))


def response_fields(observations: DataFrame) -> DataFrame:
    """``(tool, op, field, type)``: top-level fields of successful bodies, type as first seen."""
    members = F.from_json("body", "map<string,variant>")
    rows = observations.filter("status < 400").select(*KEY, "ord", F.explode(members).alias("field", "v"))
    return rows.select(*KEY, "field", "ord", variant_kind(F.col("v")).alias("type")).groupBy(*KEY, "field").agg(
        F.min_by("type", "ord").alias("type"))


def error_rules(observations: DataFrame) -> DataFrame:
    """``(tool, op, status, error_class, n_evidence, first_evidence)`` per observed error status."""
    return observations.filter("status >= 400").groupBy(*KEY, "status").agg(
        F.count("*").alias("n_evidence"), F.min("ord").alias("first_evidence")
    ).withColumn("error_class", error_class(F.col("status")))


def induce_cards(observations: DataFrame) -> DataFrame:
    """``(tool, op, fields, statuses, n_observed)``: the claims of each card.

    Fields and statuses are schema-sized sets per card; the evidence itself stays in long form
    (:func:`error_rules`).
    """
    fields = response_fields(observations).groupBy(*KEY).agg(F.array_sort(F.collect_set("field")).alias("fields"))
    rules = error_rules(observations).groupBy(*KEY).agg(F.array_sort(F.collect_set("status")).alias("statuses"))
    seen = observations.groupBy(*KEY).agg(F.count("*").alias("n_observed"))
    return seen.join(fields, KEY, "left").join(rules, KEY, "left")


def verdict(status: Column, body: Column, fields: Column, statuses: Column) -> Column:
    """Whether an observation confirms a card; null when the card says nothing testable."""
    keys = F.json_object_keys(body)
    success = F.when((F.size(fields) > 0) & keys.isNotNull(), F.size(F.array_except(fields, keys)) == 0)
    return F.when(status >= 400, F.when(F.array_contains(statuses, status), True)).otherwise(success)


def card_tallies(cards: DataFrame, observations: DataFrame) -> DataFrame:
    """``(tool, op, confirmations, contradictions, status)``; the order of observations does not matter."""
    judged = judge_observations(cards, observations)
    tallies = judged.groupBy(*KEY).agg(
        F.count_if("verdict").alias("confirmations"), F.count_if(~F.col("verdict")).alias("contradictions"))
    return tallies.withColumn("status", grounding_status(F.col("confirmations"), F.col("contradictions")))


def judge_observations(cards: DataFrame, observations: DataFrame) -> DataFrame:
    claims = cards.select(*KEY, "fields", "statuses")
    return observations.join(claims, KEY).select(
        *KEY, verdict(F.col("status"), F.col("body"), F.col("fields"), F.col("statuses")).alias("verdict"))


def grounding_status(confirmations: Column, contradictions: Column) -> Column:
    return F.when(contradictions > confirmations, "contradicted").when(confirmations > 0, "grounded").otherwise(
        "provisional")


def ground_slots(claims: DataFrame, spec: DataFrame, catalog: DataFrame) -> DataFrame:
    """Signature slots ``(tool, op, slot, fingerprint, enum)`` that the catalog declares.

    ``spec(tool, op, slot, fingerprint)`` declares slots; a card whose fingerprint is not the
    spec's is stale and loses all of them. Enums are clipped to ``catalog(tool, slot, allowed)``,
    in the card's order.
    """
    current = spec.select(*KEY, F.col("fingerprint").alias("now")).distinct()
    declared = spec.select(*KEY, "slot").distinct()
    rows = claims.join(current, KEY, "left").filter(
        (F.col("fingerprint") == "") | F.col("now").isNull() | (F.col("fingerprint") == F.col("now")))
    rows = rows.drop("now").join(declared, [*KEY, "slot"], "left_semi").join(catalog, ["tool", "slot"], "left")
    clipped = F.when(F.col("allowed").isNotNull(), F.filter(
        "enum", lambda v: F.array_contains("allowed", v))).otherwise(F.col("enum"))
    return rows.withColumn("enum", clipped).drop("allowed")


def stale_cards(claims: DataFrame, spec: DataFrame) -> DataFrame:
    """``(tool, op)`` of cards whose fingerprint differs from the spec's."""
    current = spec.select(*KEY, F.col("fingerprint").alias("now")).distinct()
    return claims.filter("fingerprint <> ''").join(current, KEY).filter("fingerprint <> now").select(*KEY).distinct()


def spec_fingerprints(specs: DataFrame) -> DataFrame:
    """``(tool, op, fingerprint)`` of ``specs (tool, op, schema)``: the digest of the schema, a JSON text, whatever the order of its keys."""
    keyed = specs.withColumn("spec", F.to_json(F.struct(*KEY)))
    leaves = json_walk(keyed, carry=("spec",), body="schema", fields=("ord", "parent_ord", "key", "path", "json_type", "value"))
    roots = fingerprints(leaves, "spec").filter("ord = 0").select("spec", F.col("digest").alias("fingerprint"))
    return keyed.join(roots, "spec").select(*KEY, "fingerprint")


def ground_claims(cards: DataFrame, claims: DataFrame, citations: DataFrame, observed: DataFrame, spec: DataFrame,
                  catalog: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tool, op, kind, name, enum)`` of the claims that hold, and ``(tool, op, status, kept, dropped)`` of the cards.

    ``cards (tool, op, fingerprint, status)``; ``claims (tool, op, kind, name, enum)`` are their error rules
    (``rule``), signature slots (``slot``) and response fields (``field``). A card whose fingerprint is
    not that of ``spec (tool, op, fingerprint, slots)`` is stale: all its claims fall and it is
    contradicted. Else a rule holds if one of its ``citations (tool, op, name, evidence)`` is an
    ``observed (evidence)``, a slot if the spec declares it, its enum clipped to ``catalog (tool, slot,
    allowed)`` in the card's order, a field if ``fields (tool, op, name)`` has it. Cards without a spec,
    tools without a catalog entry, and operations of which no field was ever observed are not
    checked for that.
    """
    current = spec.groupBy(*KEY).agg(F.max("fingerprint").alias("now"), F.max("slots").alias("slots"))
    known = cards.join(current, KEY, "left")
    stale = (F.coalesce("fingerprint", F.lit("")) != "") & F.col("now").isNotNull() & (F.col("fingerprint") != F.col("now"))
    known = known.withColumn("stale", F.coalesce(stale, F.lit(False)))
    cited = citations.join(observed.select("evidence").distinct(), "evidence", "left_semi").select(*KEY, "name").distinct()
    live = claims.join(known.filter(~F.col("stale")).select(*KEY, "slots"), KEY)
    rules = live.filter("kind = 'rule'").drop("slots").join(cited, [*KEY, "name"], "left_semi")
    slots = live.filter("kind = 'slot'").filter(F.col("slots").isNull() | F.array_contains("slots", F.col("name"))).drop("slots").join(
        catalog.select("tool", F.col("slot").alias("name"), "allowed"), ["tool", "name"], "left")
    clipped = F.when(F.col("allowed").isNotNull(), F.filter("enum", lambda v: F.array_contains("allowed", v))).otherwise(F.col("enum"))
    slots = slots.withColumn("enum", clipped).drop("allowed")
    seen = fields.select(*KEY).distinct().withColumn("checked", F.lit(True))
    named = fields.select(*KEY, "name").distinct().withColumn("there", F.lit(True))
    found = live.filter("kind = 'field'").drop("slots").join(seen, KEY, "left").join(named, [*KEY, "name"], "left")
    found = found.filter("checked is null or there").drop("checked", "there")
    order = [*KEY, "kind", "name", "enum"]
    kept = rules.select(order).unionByName(slots.select(order)).unionByName(found.select(order))
    counts = claims.groupBy(*KEY).agg(F.count("*").alias("n"))
    left = kept.groupBy(*KEY).agg(F.count("*").alias("kept"))
    report = known.join(counts, KEY, "left").join(left, KEY, "left").select(
        *KEY, F.when(F.col("stale"), "contradicted").otherwise(F.col("status")).alias("status"),
        F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("n", F.lit(0)) - F.coalesce("kept", F.lit(0))).alias("dropped"))
    return kept, report


def card_clause(slots: Column, rules: Column, fields: Column, max_len: int = 240) -> Column:
    """``card=[sig:…;err:…;exp:…]`` from arrays of structs and names, cut to ``max_len``.

    ``slots`` holds ``(slot, type, required, enum)``, ``rules`` holds ``(status, error_class)``.
    """
    tag = lambda s: F.concat(
        s["slot"], F.when(s["required"], "!").otherwise(""),
        F.when(F.size(s["enum"]) > 0, ":enum").otherwise(F.concat(F.lit(":"), s["type"])))
    by_slot = F.transform(F.array_sort(F.transform(slots, lambda s: F.struct(s["slot"].alias("k"), tag(s).alias("t")))),
                          lambda s: s["t"])
    errors = F.array_sort(F.array_distinct(F.transform(
        rules, lambda r: F.concat(r["status"].cast("string"), F.lit("="), r["error_class"]))))
    part = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(name), F.array_join(items, ",")))
    clause = F.concat(F.lit("card=["), F.concat_ws(
        ";", part("sig:", by_slot), part("err:", errors), part("exp:", F.array_sort(fields))), F.lit("]"))
    return F.when(F.length(clause) > max_len, F.concat(F.substring(clause, 1, max_len - 1), F.lit("]"))).otherwise(clause)


def action_template(tool: Column, op: Column, target: Column, arguments: Column, schema_id: Column,
                    card: Column | None = None) -> Column:
    """Value-independent text of an action; ``arguments`` maps slot to type."""
    pairs = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat_ws(
        " ", F.concat(F.lit("tool="), tool), F.concat(F.lit("op="), op), F.concat(F.lit("target="), target),
        F.concat(F.lit("args=["), F.array_join(pairs, ","), F.lit("]")),
        F.concat(F.lit("schema="), F.nullif(schema_id, F.lit(""))), *([card] if card is not None else []))


def safe_candidates(actions: DataFrame, ceiling: int, tool: str | None = None) -> DataFrame:
    """Legal, valid actions at or below the risk ceiling, optionally of one tool."""
    safe = actions.filter(F.col("legal") & F.col("valid") & (F.col("risk") <= ceiling))
    return safe if tool is None else safe.filter(F.col("tool") == tool)
