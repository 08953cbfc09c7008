"""Goal surfaces: JSON values as labelled, checkable goals, and their template text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.functions import goal_ids as g
from treecorpus.functions.classify import any_of, is_metadata_document
from treecorpus.functions.json_text import pretty_json_value
from treecorpus.functions.urls import odata_type
from treecorpus.operators.json_walk import ALLOWABLE, is_scalar, json_walk, mentions

RECORD = ["url", "seq", "vendor", "source", "odata_type"]


def with_type(records: DataFrame) -> DataFrame:
    return records.withColumn("odata_type", F.coalesce(odata_type(F.col("body")), F.lit("")))


def variant_kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL") | (name == "DOUBLE"), "number").when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array").otherwise("object")
    )


def variant_text(value: Column, kind: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "boolean", F.initcap(text)).when(kind == "null", None).otherwise(text)


def _annotated(place) -> bool:
    return place.key is not None and place.key.endswith(ALLOWABLE)


def state_documents(records: DataFrame) -> DataFrame:
    """The records that goals are made of: typed, schema documents dropped."""
    return with_type(records.filter(~is_metadata_document(F.col("url"), F.col("body"))))


def goal_leaves(records: DataFrame) -> DataFrame:
    """All that goals need of the bodies, in one walk: goal scalars and allowable-value lists.

    ``records`` come from :func:`state_documents`. Stage the result where several operators read it.
    """
    leaves = json_walk(records, carry=RECORD, keep=lambda place: _annotated(place) or g.goal_place(place),
                       fields=("ord", "path", "key", "seg", "json_type", "value", "sibling_value", "shared"))
    return leaves.withColumn("plain", _plain(leaves).cast("int")).drop("shared")


def _plain(leaves: DataFrame) -> Column:
    """Whether no other surface of the record can have the path of a leaf (1 or 0): its path occurs once, and the record has
    neither allowable-value lists nor a known type; paths of actions never count as plain."""
    typed = any_of([F.col("odata_type").contains(part) for part in TYPED])
    return ~(F.col("shared") | typed | F.col("path").startswith("Actions.") | F.coalesce(F.col("key").endswith(ALLOWABLE), F.lit(False)))


def scalar_facts(records: DataFrame, carry: list[str]) -> DataFrame:
    """Scalars that may become state goals: no skipped subtrees, metadata keys or sensitive paths."""
    return json_walk(records, carry=carry, keep=g.goal_place, fields=("ord", "path", "json_type", "value")).filter(
        is_scalar())


def allowable_values(records: DataFrame) -> DataFrame:
    """One row per value of each annotated property; sensitive properties are left out."""
    return _allowed(json_walk(records, carry=RECORD, annotations=True,
                              fields=("ord", "path", "seg", "json_type", "value", "sibling_value")))


def _allowed(rows: DataFrame) -> DataFrame:
    """The values of walked allowable-value lists."""
    prop = F.substring(F.col("path"), F.lit(1), F.length("path") - len(ALLOWABLE))
    return (
        rows.withColumn("path", prop)
        .filter(~g.is_sensitive(F.col("path")))
        .withColumn("under_actions", F.array_contains("seg", "Actions"))
        .withColumn("allowed", F.from_json("value", "array<string>"))
        .select("*", F.posexplode(F.from_json("value", "array<variant>")).alias("pos", "item"))
        .withColumn("kind", variant_kind(F.col("item")))
        .withColumn("text", variant_text(F.col("item"), F.col("kind")))
    )


RAW = (
    "rank int, ord long, mode string, verifier_kind string, family string, fact_path string, action_name string, "
    "argument_name string, target_value string, target_type string, current_value string, "
    "allowed_values array<string>"
)


def _raw(rows: DataFrame, **given) -> DataFrame:
    """Unlabelled surface rows; columns not given are null. Labels are computed once, after the union."""
    columns = []
    for field in RAW.split(", "):
        name, kind = field.split(" ")
        value = given.get(name)
        columns.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name))
    return rows.select(*RECORD, *columns)


def _label(rows: DataFrame) -> DataFrame:
    """Goal ids and families of raw surface rows."""
    state = F.col("mode") == "state"
    rows = rows.withColumn("resource_type", g.resource_type_id(F.col("odata_type")))
    rows = rows.withColumns({
        "family": F.coalesce(
            "family",
            F.when(state, g.family_for_path(F.col("resource_type"), F.col("fact_path")))
            .otherwise(g.family_for_action(F.col("action_name")))),
        "value_id": g.goal_value_id(F.col("target_value"), F.col("target_type")),
        "argument_name": F.coalesce("argument_name", F.lit("")),
    })
    tail = (
        F.when(state, F.concat_ws(".", "fact_path", F.lit("eq"), "value_id"))
        .when(F.col("argument_name") == "", F.concat_ws(".", "action_name", F.lit("invoke")))
        .otherwise(F.concat_ws(".", "action_name", "argument_name", F.lit("eq"), "value_id")))
    return rows.select(
        F.concat_ws(".", "family", "resource_type", tail).alias("goal_id"), "family", "resource_type",
        F.when(state, F.col("fact_path")).otherwise("").alias("property_path"), "mode",
        F.coalesce("action_name", F.lit("")).alias("action_name"), "argument_name", "target_value", "target_type",
        "vendor", "source", F.col("url").alias("resource_uri"), "odata_type", "fact_path", "current_value",
        "allowed_values", "verifier_kind", F.struct("seq", "rank", "ord").alias("at"))


def _within(ord: Column, pos: Column) -> Column:
    """The order of (ord, pos) as one long; a position is less than 2**31."""
    return ord.cast("long") * F.lit(2**31) + pos


def _lists(leaves: DataFrame) -> DataFrame:
    return _allowed(leaves.filter(F.col("key").endswith(ALLOWABLE) & (F.col("json_type") == "array") & (F.col("value") != "[]")))


def _state_rows(leaves: DataFrame) -> DataFrame:
    return _listed_rows(leaves).unionByName(_fact_rows(leaves))


def _listed_rows(leaves: DataFrame) -> DataFrame:
    allowed = _lists(leaves).filter(~F.col("under_actions") & (F.col("text") != ""))
    return _raw(
        allowed, rank=0, ord=_within(F.col("ord"), F.col("pos")), mode="state", verifier_kind="state_eq",
        fact_path=F.col("path"), target_value=F.col("text"), target_type=F.col("kind"),
        current_value=F.when(~F.col("path").contains("[]"), F.col("sibling_value")), allowed_values=F.col("allowed"))


def _fact_rows(leaves: DataFrame) -> DataFrame:
    facts = leaves.filter(is_scalar() & ~F.coalesce(F.col("key").endswith(ALLOWABLE), F.lit(False)) & (F.col("value") != ""))
    return _raw(
        facts, rank=1, ord=F.col("ord"), mode="state", verifier_kind="state_eq", fact_path=F.col("path"),
        target_value=F.col("value"), target_type=F.col("json_type"), current_value=F.col("value"))


def _action_rows(records: DataFrame, leaves: DataFrame) -> DataFrame:
    records = records.filter(F.col("body").contains("Actions"))
    actions = F.from_json(F.get_json_object("body", "$.Actions"), "map<string,string>")
    named = (
        records.select(*RECORD, F.explode(actions).alias("action_key", "action_body"))
        .filter(F.json_object_keys("action_body").isNotNull())
        .drop("action_body")
        .withColumn("action_name", F.regexp_replace("action_key", "^#+", ""))
        .filter(~g.is_sensitive(F.col("action_name")))
    )
    slots = _lists(leaves).filter(
        (F.element_at("seg", 1) == "Actions") & (F.size("seg") > 2)
    ).select(
        "url", "seq", "source", F.element_at("seg", 2).alias("action_key"),
        F.substring_index("path", ".", -1).alias("argument"), "ord", "pos", "text", "kind", "allowed",
    )
    rows = named.join(slots, ["url", "seq", "source", "action_key"], "left")
    return _raw(
        rows, rank=2, ord=F.coalesce(_within(F.col("ord"), F.col("pos")), F.lit(0)), mode="transition",
        verifier_kind="transition", fact_path=F.concat_ws(".", F.lit("Actions"), "action_key", "argument"),
        action_name=F.col("action_name"), argument_name=F.col("argument"), target_value=F.col("text"),
        target_type=F.coalesce("kind", F.lit("null")), allowed_values=F.col("allowed"))


def state_surfaces(records: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """State goals from allowable values outside actions, then from scalar leaves.

    ``leaves`` are the :func:`goal_leaves` of the records, if they are staged.
    """
    return _label(_state_rows(goal_leaves(with_type(records)) if leaves is None else leaves))


def action_surfaces(records: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Transition goals: one per allowed argument value, or one ``invoke`` per bare action."""
    typed = with_type(records)
    return _label(_action_rows(typed, goal_leaves(typed) if leaves is None else leaves))


def _pairs(*values: tuple[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(v).alias("text"), F.lit(k).alias("kind")) for v, k in values])


def _typed_rows(records: DataFrame) -> DataFrame:
    odata = F.col("odata_type")
    given = {"mode": "state", "verifier_kind": "state_eq", "ord": F.col("pos")}

    system_schema = (
        f"PowerState string, `PowerState{ALLOWABLE}` array<string>, Boot struct<"
        f"BootSourceOverrideTarget:string,`BootSourceOverrideTarget{ALLOWABLE}`:array<string>,"
        f"BootSourceOverrideEnabled:string,`BootSourceOverrideEnabled{ALLOWABLE}`:array<string>>"
    )
    own = F.col("b").getField(f"PowerState{ALLOWABLE}")
    boot = F.col("b").getField("Boot")
    lists = [(3, "power", "PowerState", F.col("b.PowerState"),
              F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("On"), F.lit("Off"))))]
    for index, prop in enumerate(("BootSourceOverrideTarget", "BootSourceOverrideEnabled")):
        lists.append((4 + index, "boot", f"Boot.{prop}", boot.getField(prop), boot.getField(f"{prop}{ALLOWABLE}")))
    entries = F.array(*[
        F.struct(F.lit(rank).alias("rank"), F.lit(family).alias("family"), F.lit(path).alias("path"),
                 current.alias("current"), allowed.alias("allowed"))
        for rank, family, path, current, allowed in lists
    ])
    system = (
        records.filter(odata.contains("ComputerSystem"))
        .select(*RECORD, F.from_json("body", system_schema).alias("b"))
        .select(*RECORD, F.explode(entries).alias("e"))
        .select(*RECORD, "e.*", F.posexplode("e.allowed").alias("pos", "text"))
        .filter("text <> '' or family = 'power'")
    )
    rows = _raw(system, **{**given, "rank": F.col("rank"), "family": F.col("family"), "fact_path": F.col("path"),
                           "target_value": F.col("text"), "target_type": "string",
                           "current_value": F.col("current"), "allowed_values": F.col("allowed")})

    protocol = records.filter(~odata.contains("ComputerSystem") & odata.contains("ManagerNetworkProtocol")).select(
        *RECORD, F.from_json("body", "NTP struct<ProtocolEnabled:boolean,NTPServers:array<string>>").alias("b")
    ).filter(F.col("b.NTP").isNotNull())
    flags = protocol.select(*RECORD, F.initcap(F.col("b.NTP.ProtocolEnabled").cast("string")).alias("current"),
                            F.posexplode(F.array(F.lit("True"), F.lit("False"))).alias("pos", "text"))
    rows = rows.unionByName(_raw(flags, **{
        **given, "rank": 6, "family": "network", "fact_path": "NTP.ProtocolEnabled", "target_value": F.col("text"),
        "target_type": "boolean", "current_value": F.col("current"),
        "allowed_values": F.array(F.lit("True"), F.lit("False"))}))
    servers = protocol.select(*RECORD, F.col("b.NTP.NTPServers").alias("allowed"),
                              F.posexplode("b.NTP.NTPServers").alias("pos", "text"))
    rows = rows.unionByName(_raw(servers, **{
        **given, "rank": 7, "verifier_kind": "contains", "family": "network", "fact_path": "NTP.NTPServers",
        "target_value": F.col("text"), "target_type": "string", "current_value": F.to_json("allowed"),
        "allowed_values": F.col("allowed")}))

    bios = records.filter(
        ~odata.contains("ComputerSystem") & ~odata.contains("ManagerNetworkProtocol") & odata.contains("Bios")
    ).select(*RECORD, F.explode(F.from_json(F.get_json_object("body", "$.Attributes"), "map<string,variant>"))
             .alias("name", "item")).withColumn("kind", variant_kind(F.col("item")))
    text = variant_text(F.col("item"), F.col("kind"))
    return rows.unionByName(_raw(bios, **{
        **given, "ord": 0, "rank": 8, "family": "bios", "fact_path": F.concat(F.lit("Attributes."), "name"),
        "target_value": text, "target_type": F.col("kind"), "current_value": text}))


#: The parts of a type that :func:`typed_surfaces` asks for.
TYPED = ("ComputerSystem", "ManagerNetworkProtocol", "Bios")


def typed_surfaces(records: DataFrame) -> DataFrame:
    """Goals of three known types: systems (power, boot), network protocol (NTP), BIOS attributes."""
    return _label(_typed_rows(with_type(records)))


SURFACE_KEY = ["goal_id", "vendor", "source", "resource_uri", "fact_path"]


def first_surfaces(rows: DataFrame) -> DataFrame:
    """First surface per goal, provenance, path and value."""
    payload = [c for c in rows.columns if c not in SURFACE_KEY and c != "at"]
    return (
        rows.groupBy(*SURFACE_KEY, g.id_part(F.coalesce("target_value", F.lit("None"))).alias("value_part"))
        .agg(F.min_by(F.struct(*payload), "at").alias("s"))
        .select(*SURFACE_KEY, "s.*")
    )


def build_surfaces(records: DataFrame, leaves: DataFrame | None = None, one_per_url: bool = False) -> DataFrame:
    """All surfaces of state documents (schema documents dropped), first seen kept.

    ``leaves`` are the :func:`goal_leaves` of the :func:`state_documents`, if they are staged. ``one_per_url`` says
    that the records hold one row per URL (see :func:`tree.last_wins`), as for :func:`first_goals`.
    """
    leaves = goal_leaves(state_documents(records)) if leaves is None else leaves
    # Bodies that cannot hold what is looked for are left before any is parsed.
    acting, typed = (state_documents(records.filter(mentions(*words))) for words in (["Actions"], TYPED))
    others = lambda part: _listed_rows(part).unionByName(_action_rows(acting, part)).unionByName(_typed_rows(typed))
    return first_goals(leaves, others, one_per_url)


def first_state_surfaces(records: DataFrame, leaves: DataFrame | None = None, one_per_url: bool = False) -> DataFrame:
    """The :func:`first_surfaces` of the :func:`state_surfaces`; ``one_per_url`` as in :func:`build_surfaces`."""
    return first_goals(goal_leaves(with_type(records)) if leaves is None else leaves, _listed_rows, one_per_url)


def first_goals(leaves: DataFrame, others: Callable[[DataFrame], DataFrame], one_per_url: bool) -> DataFrame:
    """First surfaces of the scalar leaves and of the ``others`` that the leaves give.

    Surfaces are the same only at the same URL and path. With one record per URL a plain leaf has its path for
    itself, so most surfaces are first as they are, and only those that may meet another are grouped.
    """
    if not one_per_url:
        return first_surfaces(_label(others(leaves).unionByName(_fact_rows(leaves))))
    rest = leaves.filter("plain = 0")
    grouped = first_surfaces(_label(others(rest).unionByName(_fact_rows(rest))))
    return _label(_fact_rows(leaves.filter("plain = 1"))).select(*grouped.columns).unionByName(grouped)


def template_text(goals: DataFrame, count: int = 2) -> DataFrame:
    """``count`` deterministic requests per goal; none when ``count`` is not positive."""
    odd = F.col("variant") % 2 == 1
    resource = g.words(F.col("resource_type"))
    value = g.spoken_value(F.col("target_value"), F.col("target_type"))
    action = g.words(F.when(F.col("action_name") == "", "action").otherwise(F.col("action_name")))
    args = F.concat_ws(" ", g.words(F.col("argument_name")), value)
    prop = g.words(F.when(F.col("property_path") == "", F.col("goal_id")).otherwise(F.col("property_path")))
    say = lambda *p: F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else x for x in p])
    text = (
        F.when((F.col("mode") == "transition") & (F.col("argument_name") != ""),
               F.when(odd, say("invoke", action, "on", resource, "with", args))
               .otherwise(say("run", action, "on", resource, "setting", args)))
        .when(F.col("mode") == "transition", say("invoke", action, "on", resource))
        .when(odd, say("make", resource, prop, value))
        .otherwise(say("set", resource, prop, "to", value))
    )
    variants = F.array() if count <= 0 else F.sequence(F.lit(0), F.lit(count - 1))
    return goals.withColumn("variant", F.explode(variants.cast("array<int>"))).withColumn("text", text)


def compound_text(atoms: DataFrame, group: list[str], ordered: Column) -> DataFrame:
    """Join the atoms ``(group…, pos, text)`` of a goal set: `` then `` when ordered, else `` and ``; ``n`` counts them."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    rows = atoms.groupBy(*group).agg(joined.alias("texts"), F.bool_or(ordered).alias("ordered"), F.count("*").alias("n"))
    return rows.select(
        *group, F.when(F.col("ordered"), F.array_join("texts", " then "))
        .otherwise(F.array_join("texts", " and ")).alias("text"), F.col("n"))


# The wording of the paraphrase prompt.
PROMPT_HEAD = (
    "Generate natural-language operator requests for a server-management agent.\n"
    "Each request must mean exactly the atomic sub-goals below.\n"
)
PROMPT_ORDER = "Use the ordering implied by the dependency hints."
PROMPT_NO_ORDER = "Do not add ordering words such as then, before, after, first, or second."
PROMPT_RULES = (
    "\nDo not add, remove, weaken, strengthen, or reorder goals beyond the dependency hints.\n"
    "Return one request per line, no numbering, no markdown.\n\n"
)


def paraphrase_prompt(goals: DataFrame, count: int, dependencies: Column | None = None) -> DataFrame:
    """Add the ``prompt`` for one goal per row; unsafe strings are redacted.

    ``dependencies`` is a JSON list of hints; with any hint the prompt asks for their order.
    """
    hints = F.lit("[]") if dependencies is None else F.coalesce(dependencies, F.lit("[]"))
    shown = F.to_json(F.array(F.struct(
        "goal_id", "family", "resource_type", "property_path", F.lit("eq").alias("operator"), F.lit("state").alias("mode"),
        g.safe_value(F.col("target_value"), F.col("target_type")).alias("target_value"))))
    return goals.withColumn("prompt", F.concat(
        F.lit(PROMPT_HEAD), F.when(hints == "[]", PROMPT_NO_ORDER).otherwise(PROMPT_ORDER),
        F.lit(f"{PROMPT_RULES}Requested count: {count}\nAtomic sub-goals:\n"), pretty_json_value(shown),
        F.lit("\n\nDependency hints:\n"), pretty_json_value(hints), F.lit("\n")))


def verify_goals(surfaces: DataFrame, observed: DataFrame) -> DataFrame:
    """Check surfaces against observed leaves ``(url, path, value, json_type)``.

    Values are equal when their type class and text are equal; integers and floats are one class,
    booleans another. ``contains`` looks for an item of the list at the path; ``transition`` is
    never satisfied by an observation.
    """
    kind_class = lambda c: F.when(c.isin("integer", "number"), "number").otherwise(c)
    lookup = F.when(F.col("verifier_kind") == "contains", F.concat("fact_path", F.lit("[]"))).otherwise(
        F.when(~F.col("fact_path").contains("[]"), F.col("fact_path")))
    checks = surfaces.withColumns({"check_path": lookup, "target_class": kind_class(F.col("target_type"))})
    # Without a text nothing is equal; containers stay out of the join.
    facts = observed.filter("value is not null").select(
        F.col("url").alias("resource_uri"), F.col("path").alias("check_path"),
        F.col("value").alias("observed"), kind_class(F.col("json_type")).alias("observed_class"))
    equal = (F.col("observed_class") == F.col("target_class")) & F.when(
        F.col("target_class") == "number",
        F.expr("try_cast(observed as double) = try_cast(target_value as double)"),
    ).otherwise(F.col("observed") == F.col("target_value"))
    key = ["goal_id", "resource_uri", "fact_path", "target_value", "verifier_kind"]
    state = checks.filter("verifier_kind <> 'transition'").join(facts, ["resource_uri", "check_path"], "left")
    # The looked-up path follows from the key; with it the groups lie where the join has put them.
    done = state.groupBy(*key, "check_path").agg(F.coalesce(F.bool_or(equal), F.lit(False)).alias("satisfied")).drop("check_path")
    never = checks.filter("verifier_kind = 'transition'").select(*key, F.lit(False).alias("satisfied"))
    reason = F.when(F.col("verifier_kind") == "transition", "transition_requires_followup_observation").otherwise(
        F.col("verifier_kind"))
    return done.unionByName(never).withColumns({
        "reward": F.when(F.col("satisfied"), 1.0).otherwise(0.0), "reason": reason})


def goal_manifest(surfaces: DataFrame) -> DataFrame:
    """``(dimension, key, n, goal_ids)`` by family, type, vendor and source, and the total."""
    # Counted per goal first, so that the five groupings read one row per goal and provenance.
    goals = surfaces.groupBy("family", "resource_type", "vendor", "source", "goal_id").agg(F.count("*").alias("m"))
    rows = goals.groupingSets(
        [["family"], ["resource_type"], ["vendor"], ["source"], []],
        "family", "resource_type", "vendor", "source",
    ).agg(
        F.grouping_id("family", "resource_type", "vendor", "source").alias("gid"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.countDistinct("goal_id").alias("goal_ids"))
    dimension = (
        F.when(F.col("gid") == 7, "family").when(F.col("gid") == 11, "resource_type")
        .when(F.col("gid") == 13, "vendor").when(F.col("gid") == 14, "source").otherwise("total"))
    return rows.select(
        dimension.alias("dimension"),
        F.coalesce("family", "resource_type", "vendor", "source", F.lit("")).alias("key"), "n", "goal_ids")
