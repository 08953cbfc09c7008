"""Resource and document classification rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from treecorpus.functions.urls import odata_id, odata_type

# Type prefixes in match order, and the kind each one names.
TYPE_PREFIXES = [
    ("#AttributeRegistry.", "attribute_registry"),
    ("#MessageRegistryFile.", "registry_file"),
    ("#BootOptionCollection.", "boot_option_collection"),
    ("#BootOption.", "boot_option"),
    ("#ActionInfo.", "action_info"),
    ("#Bios.", "bios"),
    ("#ComputerSystem.", "computer_system"),
]
# Documents that describe schema instead of state (label building).
METADATA_TYPES = ["AttributeRegistry", "JsonSchemaFile", "MessageRegistry", "PrivilegeRegistry"]
METADATA_URL_PARTS = ["/jsonschemas/", "/registries/"]
# The wider rule set used before ranking.
RANKING_URL_PARTS = [
    "/jsonschemas/", "/schemas/", "/schemastore/", "/registries/", "/metricdefinitions/", "/messageregistry",
]
RANKING_TYPES = [
    "jsonschemafile", "metricdefinition", "metricreportdefinition", "messageregistryfile",
    "attributeregistry", "schemafile",
]
# Fixed value: the context of schema files.
SCHEMA_FILE_CONTEXT = "/redfish/v1/$metadata#JsonSchemaFile.JsonSchemaFile"
# Sidecar names in a capture folder.
SIDECARS = ["corpus.json", "manifest.json", "manifest.v1.json", "rest_api_map.v1.json"]
# Folder markers in match order.
VENDOR_MARKERS = [
    ("idrac_fixtures", "dell"),
    ("dell", "dell"),
    ("hpe_fixtures", "hpe"),
    ("hpe", "hpe"),
    ("ilo", "hpe"),
    ("supermicro_gb300_corpus", "supermicro"),
    ("supermicro_fixtures", "supermicro"),
    ("supermicro", "supermicro"),
]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def resource_kind(url: Column, body: Column) -> Column:
    """First matching type prefix, BIOS settings refined by URL, then URL fallbacks."""
    lowered = F.lower(F.regexp_replace(url, "/+$", ""))
    pending = lowered.endswith("/bios/settings")

    def by_type(rtype: Column) -> Column:
        chain = F.when(rtype.startswith("#Bios.") & pending, "bios_pending")
        for prefix, kind in TYPE_PREFIXES:
            chain = chain.when(rtype.startswith(prefix), kind)
        return (
            chain.when(pending, "bios_pending")
            .when(lowered.endswith("/bios"), "bios")
            .when(lowered.contains("/bootoptions/"), "boot_option")
            .when(lowered.endswith("/bootoptions"), "boot_option_collection")
            .otherwise("other"))

    return let(F.coalesce(odata_type(body), F.lit("")), by_type)


def is_metadata_document(url: Column, body: Column) -> Column:
    """Schema and registry documents, as the label builder sees them."""
    # Most bodies have none of the words, so they are not parsed. Escapes may spell a word otherwise.
    def may_have(*words: str) -> Column:
        return F.coalesce(any_of([body.contains(w) for w in ("\\", *words)]), F.lit(False))

    by_type = may_have(*METADATA_TYPES) & F.coalesce(odata_type(body), F.lit("")).rlike("|".join(METADATA_TYPES))
    by_url = F.lower(url).rlike("|".join(METADATA_URL_PARTS))

    def by_keys(keys: Column) -> Column:
        has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
        return has("$schema") | has("Definitions") | has("definitions") | (
            has("RegistryPrefix") & (has("Messages") | has("RegistryEntries")))

    return by_type | by_url | (may_have("$schema", "efinitions", "RegistryPrefix") & let(F.json_object_keys(body), by_keys))


def is_ranking_metadata(url: Column, body: Column) -> Column:
    """Schema, registry and metric-definition documents, as the ranking check sees them."""
    head = F.substring_index(F.coalesce(odata_type(body), F.lit("")), ".", 1)
    return any_of([F.lower(url).contains(p) for p in RANKING_URL_PARTS]) | F.lower(
        F.regexp_replace(head, "^#+", "")
    ).isin(RANKING_TYPES)


def is_operational(body: Column) -> Column:
    """No ``$schema``, a context, and not the context of schema files."""
    keys = F.json_object_keys(body)
    context = F.get_json_object(body, "$['@odata.context']")
    return (
        ~F.coalesce(F.array_contains(keys, "$schema"), F.lit(False))
        & F.coalesce(F.array_contains(keys, "@odata.context"), F.lit(False))
        & ~F.coalesce(context, F.lit("")).contains(SCHEMA_FILE_CONTEXT)
    )


def is_sidecar(file_name: Column, body: Column) -> Column:
    keys = F.json_object_keys(body)
    return file_name.isin(SIDECARS) & ~F.coalesce(F.array_contains(keys, "@odata.id"), F.lit(False))


def resolved_url(body: Column, from_name: Column) -> Column:
    """The body's own id when it is a non-empty string, else the URL spelled by the file name."""
    own = odata_id(body)
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$['@odata.id']", "variant"))
    return F.when((own != "") & (typed == "STRING"), own).otherwise(from_name)


def infer_vendor(path: Column) -> Column:
    """First marker equal to a lower-case path part, or its prefix before ``_`` or ``-``."""
    parts = F.split(F.lower(path), "/")

    def carries(marker: str) -> Column:
        return F.exists(parts, lambda p: (p == marker) | p.startswith(marker + "_") | p.startswith(marker + "-"))

    chain = None
    for marker, vendor in VENDOR_MARKERS:
        hit = carries(marker)
        chain = F.when(hit, vendor) if chain is None else chain.when(hit, vendor)
    return chain.otherwise("")
