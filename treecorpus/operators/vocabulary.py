"""Vocabulary and pattern tables over captured bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.operators.json_walk import ALLOWABLE, Place

SETTINGS = "@Redfish.Settings"
#: The columns of the walk that :func:`vocabulary` reads.
FIELDS = ("key", "parent_key", "seg", "json_type", "value")


def drop_volatile(text: Column) -> Column:
    """Names that do not end in ``.<digits>`` and hold no job id."""
    return ~text.rlike(r"\.\d+$") & ~text.contains("JID_")


def may_speak(place: Place) -> bool:
    """Whether a value at this place may give a token of :func:`vocabulary`: a walk may leave out the others."""
    key = place.key
    if key is None and place.parent_key is not None and ALLOWABLE in place.parent_key:
        return True
    if key is not None and (key.startswith("#") or any(n in key for n in ("@odata.id", "@odata.type", "@odata.context", "target", ALLOWABLE))):
        return True
    return any(SETTINGS in s or "Attributes" in s for s in place.seg)


def vocabulary(leaves: DataFrame) -> DataFrame:
    """``(kind, token)``: targets, actions, types, contexts, allowable keys and values, flattened
    settings and attributes, each once. Values that are not strings appear as text, null not at all.
    ``leaves`` need the columns :data:`FIELDS` of the places that pass :func:`may_speak`.
    """
    key, value = F.col("key"), F.col("value")
    last = F.substring_index(value, "/", -1)
    inside = lambda name: F.exists("seg", lambda s: s.contains(name))
    below = lambda name: F.exists(F.slice(F.col("seg"), 1, F.greatest(F.size("seg") - 1, F.lit(0))),
                                  lambda s: s.contains(name))
    pair = lambda kind, test, token: F.when(test, F.struct(F.lit(kind).alias("kind"), token.alias("token")))
    text = F.col("json_type") == "string"
    found = F.array_compact(F.array(
        pair("api_target", text & key.contains("@odata.id"), value),
        pair("type", text & key.contains("@odata.type"), value),
        pair("context", text & key.contains("@odata.context"), value),
        pair("target", text & key.contains("target"), value),
        pair("action", text & key.contains("target"), last),
        pair("target_name", text & key.contains("target"), F.substring_index(F.substring_index(value, "/", -2), "/", 1)),
        pair("primary_action", key.startswith("#") & (F.try_element_at("seg", F.lit(-2)) == "Actions"), key),
        pair("allowable_key", key.contains(ALLOWABLE), key),
        pair("allowable_value", key.isNull() & F.col("parent_key").contains(ALLOWABLE), value),
        pair("setting_key", key.isNotNull() & below(SETTINGS), key),
        pair("setting_value", inside(SETTINGS) & value.isNotNull() & ~key.contains(ALLOWABLE), value),
        pair("attribute_key", key.isNotNull() & below("Attributes"), key),
        pair("attribute_value", inside("Attributes") & F.col("json_type").isin("string", "integer", "number", "boolean"), value),
    ))
    rows = leaves.select(F.explode(found).alias("f")).select("f.*").filter("token is not null").distinct()
    cleaned = F.col("kind").isin("api_target", "action", "target")
    return rows.filter(~cleaned | drop_volatile(F.col("token")))


def scan_patterns(docs: DataFrame, rules: list[tuple[str, str]], doc: str, text: str,
                  exempt: Column | None = None) -> DataFrame:
    """``(doc, rule, match)``: the first match of each rule in each document.

    ``rules`` are a short list of ``(name, pattern)``; each is one expression of the scan's
    projection, so the texts are read once and never multiplied by the rules before matching.
    """
    rows = docs if exempt is None else docs.filter(~exempt)
    found = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.nullif(F.regexp_extract(F.col(text), f"({pattern})", 1), F.lit(""))
                 .alias("match"))
        for name, pattern in rules
    ])
    return rows.select(doc, F.explode(found).alias("f")).select(doc, "f.*").filter("match is not null")


#: Combinations that one row of work stands for.
RANGE = 10_000


def combinations(actions: DataFrame, parts: int = RANGE) -> DataFrame:
    """The columns of ``actions (…, parameters array<struct<name, values>>)``, ``number`` and ``chosen array<struct<name, value>>`` of every combination.

    Combinations are numbered like the figures of a mixed-radix number, the last parameter running
    fastest. Ranges of ``parts`` numbers are spread over all tasks, and each number is decoded by
    itself, so no row holds a product, however large it is. A parameter without values leaves none.
    """
    tasks = max(16, 4 * actions.sparkSession.sparkContext.defaultParallelism)
    sizes = F.transform("parameters", lambda p: F.size(p["values"]).cast("long"))
    product = lambda figures: F.aggregate(figures, F.lit(1).cast("long"), lambda a, x: a * x)
    # A figure counts as many as all figures behind it have combinations.
    weights = F.transform("sizes", lambda x, i: product(F.slice("sizes", i + 2, F.size("sizes"))))
    keep = actions.columns
    counted = actions.withColumn("sizes", sizes).withColumns({"n": product(F.col("sizes")), "weights": weights}).filter("n > 0")
    ranges = counted.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {parts}"))))
    # Few bytes that become many rows: a fixed number of tasks, which adaptive execution leaves alone.
    ranges = ranges.repartition(tasks, *[c for c in keep if c != "parameters"], "range")
    first = F.col("range") * parts
    numbers = ranges.withColumn("number", F.explode(F.sequence(first, F.least(F.col("n"), first + parts) - 1)))
    figure = lambda i: F.floor(F.col("number") / F.get("weights", i)) % F.get("sizes", i)
    chosen = F.transform("parameters", lambda p, i: F.struct(p["name"].alias("name"), F.get(p["values"], figure(i).cast("int")).alias("value")))
    return numbers.select(*keep, "number", chosen.alias("chosen"))


def action_prompts(actions: DataFrame) -> DataFrame:
    """Settings of ``(action, parameters array<struct<name, values>>)``: one per single value, and,
    with more than one parameter, one per combination of all of them.
    """
    single = actions.select("action", F.explode("parameters").alias("p")).select(
        "action", F.explode("p.values").alias("v"), F.col("p.name").alias("name"))
    single = single.select("action", F.concat_ws(" ", "name", "v").alias("setting"))
    said = F.array_join(F.transform("chosen", lambda c: F.concat(c["name"], F.lit(" "), c["value"])), ", ")
    combined = combinations(actions.filter(F.size("parameters") > 1)).select("action", said.alias("setting"))
    return single.unionByName(combined)


def _json_string(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _quoted(text: Column) -> Column:
    """The text in single quotes, or in double quotes where it holds single ones only; backslashes and line ends are escaped."""
    plain = text
    for sign, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(sign), F.lit(shown))
    return F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def prompt_rows(actions: DataFrame) -> DataFrame:
    """``action, number, prompt, goal, input`` of ``(action_type, action, parameters)``: training texts of all settings.

    ``number`` is null for a single value. A combination shows its settings as a mapping: of a name that
    comes twice the last value counts, at the first place. An action without parameters gives its own
    row. Text beyond ASCII stays as it is.
    """
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind, action = F.col("action_type"), F.col("action")
    # The wording of the texts.
    prompt = lambda ahead, held: say("Input: ", kind, " ", action, ahead, ". Goal: ", action, " Parameter: ", held, ".<|endoftext|>").alias("prompt")
    goal = lambda held: say("Goal: ", action, " Parameter: ", held).alias("goal")
    entry = lambda ahead: say("Input: ", kind, " ", action, ahead, ".").alias("input")
    none = F.lit(None).cast("long").alias("number")

    single = actions.select("action_type", "action", F.explode("parameters").alias("p")).select(
        "action_type", "action", F.explode("p.values").alias("value"), F.col("p.name").alias("name"))
    own = say("{", _json_string(F.col("name")), ": ", _json_string(F.col("value")), "}")
    setting = say(" with ", F.col("name"), " ", F.col("value"))
    rows = single.select("action", none, prompt(setting, own), goal(own), entry(setting))

    many = combinations(actions.filter(F.size("parameters") > 1))
    names = F.array_distinct(F.transform("chosen", lambda c: c["name"]))
    last = lambda name: F.element_at(F.filter("chosen", lambda c: c["name"] == name), -1)["value"]
    many = many.withColumn("items", F.transform(names, lambda name: F.struct(name.alias("name"), last(name).alias("value"))))
    listed = lambda one: F.array_join(F.transform("items", lambda c: one(c["name"], c["value"])), ", ")
    mapping = say(" with  {", listed(lambda n, v: say(_quoted(n), ": ", _quoted(v))), "}")
    held = say("{", listed(lambda n, v: say(_json_string(n), ": ", _json_string(v))), "}")
    many = many.select("action", "number", prompt(mapping, held), goal(held), entry(say(" with ", listed(lambda n, v: say(n, v)))))

    bare = actions.filter(F.coalesce(F.size("parameters"), F.lit(0)) <= 0).select(
        "action", none, prompt(F.lit(""), F.lit("[]")), say("Goal: ", kind, " Parameter: [].").alias("goal"), entry(F.lit("")))
    return rows.unionByName(many).unionByName(bare)


def preference_rows(prompts: DataFrame, chosen: DataFrame, rejected: DataFrame, index: str) -> DataFrame:
    """Prompt, chosen and rejected items aligned by row index."""
    return prompts.join(chosen, index).join(rejected, index)
