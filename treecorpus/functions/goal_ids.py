"""Naming rules of goals: id parts, families, sensitive paths, operator-readable words."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from treecorpus.functions.classify import any_of, let

# Subtrees and keys that never become goals.
SKIP_SUBTREES = ["Actions", "Links", "Members"]
SKIP_KEYS = [
    "@odata.context", "@odata.etag", "@odata.id", "@odata.type", "Created", "Description", "Id", "Modified",
    "Name", "Password", "RoleId", "Token", "UserName",
]
# Path segments (snake case) that carry secrets or identities.
SENSITIVE_NAMES = [
    "apikey", "api_key", "certificate", "credential", "key", "macaddress", "mac_address", "password",
    "privatekey", "private_key", "roleid", "role_id", "secret", "serialnumber", "serial_number", "sshkey",
    "ssh_key", "token", "username", "user_name",
]
# Substrings of a snake-cased path with the same meaning.
SENSITIVE_SUBSTRINGS = [
    "asset_tag", "change_password", "credential", "host_name", "hostname", "key", "macaddress", "mac_address",
    "password", "private", "secret", "serial", "token", "uuid",
]
# Type fragments in match order and the id each one gives.
TYPE_IDS = [
    ("ComputerSystem", "computer_system"),
    ("ManagerNetworkProtocol", "manager_network_protocol"),
    ("Bios", "bios"),
    ("VirtualMedia", "virtual_media"),
    ("LogService", "log_service"),
    ("Task", "task"),
]
# Path fragments in match order and the family each group names.
PATH_FAMILIES = [
    (["power"], "power"),
    (["boot"], "boot"),
    (["bios", "attribute"], "bios"),
    (["ntp", "network", "ethernet"], "network"),
    (["thermal", "fan", "temperature"], "thermal"),
    (["status", "health"], "status"),
    (["log"], "log"),
]
# Fixed value: strings that may appear in goal ids and prompts.
SAFE_TEXT = r"\A[A-Za-z0-9_ -]{1,64}\z"
REDACTED = "<redacted-string>"


def snake(value: Column) -> Column:
    split = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1_$2")
    plain = F.regexp_replace(F.regexp_replace(split, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    # A pattern for the empty string instead of a test, so that the chain is evaluated once.
    return F.lower(F.regexp_replace(plain, "^$", "resource"))


def id_part(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(plain, "^$", "empty")


def goal_value_id(text: Column, kind: Column) -> Column:
    return (
        F.when(kind == "boolean", text)
        .when(kind.isin("integer", "number"), id_part(text))
        .when((kind == "string") & text.rlike(SAFE_TEXT), id_part(text))
        .otherwise("value")
    )


def resource_type_id(rtype: Column) -> Column:
    chain = None
    for fragment, name in TYPE_IDS:
        chain = F.when(rtype.contains(fragment), name) if chain is None else chain.when(rtype.contains(fragment), name)
    tail = F.substring_index(rtype, ".", -1)
    return chain.when(rtype.contains(".") & (tail != "") & ~tail.startswith("v"), snake(tail)).otherwise("resource")


def family_for_path(type_id: Column, path: Column) -> Column:
    def family(lowered: Column) -> Column:
        chain = None
        for fragments, name in PATH_FAMILIES:
            test = any_of([lowered.contains(f) for f in fragments])
            chain = F.when(test, name) if chain is None else chain.when(test, name)
        return chain

    # snake() of the empty string is "resource"; a path without a first segment is a plain state.
    first = F.replace(F.substring_index(path, ".", 1), F.lit("[]"), F.lit(""))
    return F.coalesce(
        let(F.lower(F.concat(type_id, F.lit("."), path)), family), F.when(first == "", "state").otherwise(snake(first)))


def family_for_action(action: Column) -> Column:
    lowered = F.lower(action)
    return (
        F.when(lowered.contains("reset") | lowered.contains("power"), "action")
        .when(lowered.contains("log"), "log")
        .when(lowered.contains("virtualmedia"), "virtual_media")
        .when(action.contains("."), snake(F.substring_index(action, ".", 1)))
        .otherwise("action")
    )


# The same two lists as one pattern over a snake-cased path that still has its dots.
SENSITIVE = (
    "|".join(s.replace("_", "[_.]") for s in SENSITIVE_SUBSTRINGS)
    + r"|(?:^|\.)(?:" + "|".join(SENSITIVE_NAMES) + r")(?:\.|$)"
)


def is_sensitive(path: Column) -> Column:
    split = F.regexp_replace(F.replace(path, F.lit("[]"), F.lit("")), "([a-z0-9])([A-Z])", "$1_$2")
    plain = F.regexp_replace(split, "[^A-Za-z0-9.]+", "_")
    return F.lower(F.regexp_replace(plain, r"_*\._*|^_+|_+$", ".")).rlike(SENSITIVE)


def sensitive_path(path: str) -> bool:
    """:func:`is_sensitive` for the walk, which asks once per place."""
    split = re.sub("([a-z0-9])([A-Z])", r"\1_\2", path.replace("[]", ""))
    plain = re.sub(r"_*\._*|^_+|_+$", ".", re.sub("[^A-Za-z0-9.]+", "_", split)).lower()
    return re.search(SENSITIVE, plain) is not None


def goal_place(place) -> bool:
    """Whether values at this place of a body may become state goals."""
    skipped = any(s in _SKIPPED or s.endswith("@Redfish.AllowableValues") for s in place.seg)
    return not skipped and not sensitive_path(place.path)


_SKIPPED = frozenset(SKIP_SUBTREES + SKIP_KEYS)


def words(text: Column) -> Column:
    """Ids and dotted paths as lower-case words."""
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    plain = F.trim(F.lower(F.regexp_replace(split, "[^A-Za-z0-9]+", " ")))
    return F.regexp_replace(plain, "^$", "resource")


def squash_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def safe_value(text: Column, kind: Column | None = None) -> Column:
    """Strings outside the safe pattern are redacted; other types stay."""
    safe = F.when(text.rlike(SAFE_TEXT), text).otherwise(REDACTED)
    return safe if kind is None else F.when(kind == "string", safe).otherwise(text)


def spoken_value(text: Column, kind: Column) -> Column:
    """A target value as template text."""
    return (
        F.when(kind == "boolean", F.when(text == "True", "enabled").otherwise("disabled"))
        .when((kind == "string") & ~text.rlike(SAFE_TEXT), "the requested value")
        .otherwise(text)
    )
