"""The resource graph: nodes, containment, references, relations, candidates, census.

Every function takes ``by``, the columns that say whose tree a URL belongs to (a host, a corpus):
different hosts have the same URLs, and nothing may link them. They lead the rows that come out.

Edges stay long rows. Duplicates are resolved with max_by/min_by aggregates (combined before the
shuffle), and joins are plain equi-joins that adaptive execution may split on hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.functions.urls import odata_type, path_tokens, proper_prefixes, trim_url
from treecorpus.operators.json_walk import json_walk


def has_action_target(body: Column) -> Column:
    """Some member of ``Actions`` is an object with a ``target`` key, whatever its value."""
    actions = F.from_json(F.get_json_object(body, "$.Actions"), "map<string,string>")
    # Bodies without the word are not parsed; escapes may spell it otherwise.
    return F.coalesce((body.contains("Actions") | body.contains("\\")) & F.exists(
        F.map_values(actions),
        lambda v: F.coalesce(F.array_contains(F.json_object_keys(v), "target"), F.lit(False)),
    ), F.lit(False))


def last_wins(records: DataFrame, by: Sequence[str] = (), body_where: Column | None = None) -> DataFrame:
    """One row per trimmed URL: the last body, at the position of the first.

    With ``body_where`` a last body that does not pass is null. Such captures still win over earlier ones,
    but their bodies are neither sorted nor shuffled.
    """
    if body_where is not None:
        records = records.withColumn("body", F.when(body_where, F.col("body")))
    cols = [c for c in records.columns if c != "url" and c not in by]
    return (
        records.withColumn("url", trim_url(F.col("url")))
        .groupBy(*by, "url")
        .agg(F.max_by(F.struct(*cols), "seq").alias("r"), F.min("seq").alias("first_seq"))
        .select(*by, "url", "first_seq", "r.*")
    )


def graph_nodes(records: DataFrame) -> DataFrame:
    """Nodes of the graph; ``records`` must hold one row per URL (see :func:`last_wins`)."""
    return records.withColumns({
        "resource_type": F.coalesce(odata_type(F.col("body")), F.lit("")),
        "depth": F.size(path_tokens(F.col("url"))),
        "has_action_target": has_action_target(F.col("body")),
    })


def harvest_refs(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(url, ref, ord)``: references anywhere in the body, first appearance, never the URL itself."""
    return (
        json_walk(records, carry=(*by, "url"), keys=("@odata.id",), fields=("ord", "json_type", "value"))
        .filter((F.col("json_type") == "string") & (F.col("value") != "") & (F.col("value") != F.col("url")))
        .groupBy(*by, "url", trim_url(F.col("value")).alias("ref"))
        .agg(F.min("ord").alias("ord"))
    )


def containment_parent(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(url, parent)``: the nearest walked ancestor by URL segments, null when there is none.

    URLs with the same folder (the URL without its last segment) have the same ancestors, so the
    parent is found once per folder: its prefixes are exploded and met with the node set by
    equality. Prefixes of one URL extend each other, so the nearest one is also the longest, and the
    reduction is a plain max of lengths. Neither folders nor parents travel next to a URL, which holds both.
    """
    # The longest proper prefix is what stands before the last slash; the shorter ones are listed once per folder.
    cut = F.col("url").substr(F.lit(1), F.length("url") - F.length(F.substring_index("url", "/", -1)) - 1)
    folder = F.when(F.col("url").contains("/") & (cut != ""), cut)
    folders = nodes.select(*by, folder.alias("folder")).filter(F.col("folder").isNotNull()).distinct()
    lengths = F.transform(proper_prefixes(F.concat("folder", F.lit("/"))), F.length)
    steps = folders.select(*by, "folder", F.explode(lengths).alias("reach"))
    own = [F.col(c) == F.col(f"of {c}") for c in by]
    known = nodes.select(*[F.col(c).alias(f"of {c}") for c in by], F.col("url").alias("prefix"))
    steps = steps.join(known, [F.substring("folder", F.lit(1), F.col("reach")) == F.col("prefix"), *own], "left_semi")
    nearest = steps.groupBy(*by, "folder").agg(F.max("reach").alias("reach"))
    nearest = nearest.select(*[F.col(c).alias(f"of {c}") for c in by], "folder", "reach")
    same = [folder == F.col("folder"), *own]
    parent = F.when(F.col("reach").isNotNull(), F.substring("url", F.lit(1), F.col("reach")))
    return nodes.select(*by, "url").join(nearest, same, "left").select(*by, "url", parent.alias("parent"))


def containment_children(parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(parent, child)`` in sorted order (a range sort; no list per parent is built)."""
    return (
        parents.filter(F.col("parent").isNotNull())
        .select(*by, "parent", F.col("url").alias("child"))
        .orderBy(*by, "parent", "child")
    )


def reference_edges(refs: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """References whose target was walked, without self references."""
    known = nodes.select(*by, F.col("url").alias("ref"))
    return refs.filter(F.col("ref") != F.col("url")).join(known, [*by, "ref"], "left_semi").select(*by, "url", "ref", "ord")


def neighbors(parents: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(url, neighbor, rank, ord)``: children, then the parent, then references; first place kept."""
    linked = parents.filter(F.col("parent").isNotNull())
    rows = (
        linked.select(*by, F.col("parent").alias("url"), F.col("url").alias("neighbor"),
                      F.lit(0).alias("rank"), F.lit(0).alias("ord"))
        .unionByName(linked.select(*by, "url", F.col("parent").alias("neighbor"),
                                   F.lit(1).alias("rank"), F.lit(0).alias("ord")))
        .unionByName(edges.select(*by, "url", F.col("ref").alias("neighbor"), F.lit(2).alias("rank"), "ord"))
    )
    return (
        rows.groupBy(*by, "url", "neighbor")
        # One number for (rank, ord): numbers are combined in a hash table, structs only after a sort.
        .agg(F.min(F.shiftleft(F.col("rank").cast("long"), 32) + F.col("ord")).alias("at"))
        .select(*by, "url", "neighbor", F.shiftright("at", 32).cast("int").alias("rank"),
                F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("ord"))
    )


def child_relation(records: DataFrame, parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(url, relation)``: the parent's top-level key that holds the reference, else a segment.

    ``parents`` are those of :func:`containment_parent`, so only references into the URL's own subtree are looked at.
    """
    keyed = (
        json_walk(records, carry=(*by, "url"), keys=("@odata.id",), fields=("ord", "top_key", "json_type", "value"))
        .filter((F.col("json_type") == "string") & (F.col("value") != "")
                & ~F.col("top_key").startswith("@") & F.col("value").startswith(F.concat("url", F.lit("/"))))
        .groupBy(*by, F.col("url").alias("parent"), trim_url(F.col("value")).alias("url"))
        .agg(F.min_by("top_key", "ord").alias("ref_key"))
    )
    tokens = path_tokens(F.col("url"))
    last, before = F.element_at(tokens, -1), F.try_element_at(tokens, F.lit(-2))
    return parents.join(keyed, [*by, "parent", "url"], "left").select(
        *by, "url",
        F.coalesce(
            F.nullif(F.col("ref_key"), F.lit("")),
            F.when(F.size(tokens) == 0, "")
            .when((F.size(tokens) >= 2) & last.rlike("[0-9]"), before)
            .otherwise(last),
        ).alias("relation"),
    )


def candidates(nodes: DataFrame, relations: DataFrame, methods: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per (URL, METHOD) with the v1 features; a URL without methods gets GET."""
    rows = nodes.select(*by, "url", "resource_type", "has_action_target", *[
        c for c in ("host",) if c in nodes.columns and c not in by
    ]).join(relations, [*by, "url"], "left")
    default = F.array(F.lit("GET"))
    if methods is None:
        rows = rows.withColumn("methods", default)
    else:
        rows = rows.join(methods.select(*by, "url", "methods"), [*by, "url"], "left").withColumn(
            "methods", F.when(F.size("methods") > 0, F.col("methods")).otherwise(default)
        )
    upper = F.array_distinct(F.transform("methods", F.upper))
    return rows.select(
        *[c for c in rows.columns if c not in ("relation", "methods")],
        path_tokens(F.col("url")).alias("endpoint_path_tokens"),
        F.explode(upper).alias("http_method"),
        F.col("relation").alias("child_relation_name"),
    )


def frontier(refs: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Discovered but never walked URLs."""
    return refs.select(*by, F.col("ref").alias("url")).distinct().join(nodes.select(*by, "url"), [*by, "url"], "left_anti")


def corpus_census(nodes: DataFrame, parents: DataFrame, group: str = "source", by: Sequence[str] = ()) -> DataFrame:
    """Share of nodes with a type, a parent, Links, an action target, an Oem section."""
    def share(test: Column, name: str) -> Column:
        return F.avg(F.when(test, 1.0).otherwise(0.0)).alias(name)

    # What is asked of the bodies is settled before the join, which moves none of them.
    body_keys = F.json_object_keys("body")
    rows = nodes.select(*dict.fromkeys([*by, "url", group]), "resource_type", "has_action_target",
                        F.array_contains(body_keys, "Links").alias("links"), F.array_contains(body_keys, "Oem").alias("own"))
    return rows.join(parents, [*by, "url"], "left").groupBy(group).agg(
        F.count("*").alias("n"),
        share(F.col("resource_type") != "", "typed"),
        share(F.col("parent").isNotNull(), "parented"),
        share(F.col("links"), "linked"),
        share(F.col("has_action_target"), "actionable"),
        share(F.col("own"), "oem"),
    )
