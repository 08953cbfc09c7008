"""URL filter: rules indexed by their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecorpus.llm.common import ascii_lower

RULE_SCHEMA = "host string, path string, verdict string"
#: The token of rules that have no literal token of their own; every URL carries it.
ANY = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def host_tokens(host: Column) -> Column:
    return F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))


def path_tokens(path: Column, whole: bool) -> Column:
    """Segments of a path; of a rule's path only those closed by a slash, as the last may be a prefix."""
    parts = F.split(path, "/")
    if not whole:
        parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))


def rule_pattern(host: str | None, path: str | None) -> str:
    """The regular expression of a rule over host followed by path (a host has no slash)."""
    tail = re.escape(path) if path else r"(?:/[\s\S]*)?\z"
    return (r"\A(?:[^/]*\.)?" + re.escape(host) if host else r"\A[^/]*") + tail


def rule_index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Rules with their pattern and the one token that fewest of the URLs carry."""
    patterns = F.udf(lambda host, path: rule_pattern(host, path), "string")  # one call per rule, not per URL
    named = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).distinct()
    named = named.select(
        F.concat("host", "path").alias("rule"), "verdict", patterns("host", "path").alias("pattern"),
        F.array_union(host_tokens(F.col("host")), path_tokens(F.col("path"), whole=False)).alias("tokens"))
    long = named.select("rule", "verdict", "pattern", F.explode(
        F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(ANY)))).alias("token"))
    counts = url_tokens.join(long.select("token").distinct(), "token", "left_semi").groupBy("token").agg(
        F.count("*").alias("n"))
    rarest = Window.partitionBy("rule", "verdict").orderBy("n", "token")
    return (
        long.join(counts, "token")  # a token that no URL carries rules the rule out
        .withColumn("place", F.row_number().over(rarest)).filter("place = 1").drop("place", "n"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains (an empty host:
    all) when the path starts with the rule's; an empty path fits all. The longest rule wins, of
    equally long ones a block. URLs without a rule get ``default`` and a null rule. A null URL or
    one without ``://`` has an empty host and path; repeated rows are judged alike; empty pages or
    rules are fine. Columns of ``pages`` with the four names are replaced, all others stay.

    Distinct URLs send their tokens to the index and only rules found there are run as regular
    expressions, so a URL that fills a third of the table is matched once.
    """
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    cut = pages.select(*kept, host.alias("host"), path.alias("path"))
    urls = cut.select("host", "path").distinct()
    tokens = urls.select("host", "path", F.explode(F.array_union(
        F.array(F.lit(ANY)), F.array_union(host_tokens(F.col("host")), path_tokens(F.col("path"), whole=True)))).alias("token"))
    hits = tokens.join(rule_index(rules, tokens), "token").filter(
        F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("length"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return cut.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
