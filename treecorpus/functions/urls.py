"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trim_url(url: Column) -> Column:
    """Drop trailing slashes; a URL of slashes only stays as it is."""
    short = F.regexp_replace(url, "/+$", "")
    return F.when(short == "", url).otherwise(short)


def path_tokens(url: Column) -> Column:
    return F.filter(F.split(url, "/"), lambda s: s != "")


def proper_prefixes(url: Column) -> Column:
    """All proper segment prefixes of a URL, shortest first."""
    parts = F.split(url, "/")
    rows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )
    return F.filter(rows, lambda p: (p != "") & (p != url))


def url_from_file_name(name: Column) -> Column:
    stem = F.regexp_replace(name, r"\.json$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, "^_+", ""), "_+$", "")
    return F.concat(F.lit("/"), F.translate(stem, "_", "/"))


def odata_id(body: Column) -> Column:
    return F.get_json_object(body, "$['@odata.id']")


def odata_type(body: Column) -> Column:
    return F.get_json_object(body, "$['@odata.type']")
