"""Fixed schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Provenance tiers.
TRUST = {"REAL": 5, "REPLAY": 4, "SIM_VENDOR": 3, "SIM_GENERIC": 2, "SIM_DRIFT": 1}
READ_METHODS = ["GET", "HEAD"]
WRITE_METHODS = ["POST", "PATCH", "PUT", "DELETE"]
IDEMPOTENT_METHODS = ["GET", "HEAD", "PUT", "DELETE"]

RESOURCE = "struct<id:string,type:string,keys:array<string>>"
EXAMPLE_SCHEMA = (
    "source string, trust_level string, schema_version string, url string, "
    f"state_before {RESOURCE}, state_after {RESOURCE}, "
    "request struct<method:string,url:string,body:string>, response string, allowed_methods array<string>, "
    "semantics struct<method:string,mutating:boolean,read_only:boolean,idempotent:boolean,expected_status:int,"
    "mutable_endpoint:boolean,resource_kind:string>, vendor string"
)


def trust_name(level: Column) -> Column:
    chain = None
    for name, value in TRUST.items():
        chain = F.when(level == value, name) if chain is None else chain.when(level == value, name)
    return chain


def trust_level(name: Column) -> Column:
    chain = None
    for label, value in TRUST.items():
        chain = F.when(name == label, value) if chain is None else chain.when(name == label, value)
    return chain
