"""Inputs that the fixtures never hold: contradictions, infinities, bodies that cannot be read, many files."""

import json

from conftest import rows
from treecorpus.operators import fleet, goals, json_walk, mix, tree
from treecorpus.operators.percentiles import exact_percentiles
from treecorpus.sources.captures import read_captures, read_files


def test_contradicting_predicates_never_hold(spark):
    nodes = spark.createDataFrame([("/a",), ("/b",)], "url string")
    leaves = spark.createDataFrame([("/a", "P", "On"), ("/a", "Q", "1"), ("/b", "P", "Off")], "url string, path string, value string")
    ask = lambda *pairs: rows(fleet.fleet_predicate(leaves, spark.createDataFrame(pairs, "path string, value string"), nodes))
    assert ask(("P", "On"), ("P", "Off")) == [("/a", 1, False), ("/b", 1, False)]
    assert ask(("P", "On"), ("Q", "1"), ("P", "On")) == [("/a", 2, True), ("/b", 0, False)]


def test_percentiles_of_infinities_and_outliers(spark):
    inf = float("inf")
    values = {"a": [1.0, 2.0, inf], "b": [-inf, 1.0, 2.0, 3.0, inf], "c": [*map(float, range(1001)), 1e18], "d": [inf, inf], "e": [5.0]}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in exact_percentiles(frame, "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got["a"] == (2.0, inf) and got["b"] == (2.0, inf) and got["d"] == (inf, inf) and got["e"] == (5.0, 5.0)
    assert got["c"] == (500.5, 0.95 * 1001)


def test_a_bad_body_does_not_end_the_walk(spark):
    bodies = ['{"a": "\\ud800x"}', "[" * 20_000 + "]" * 20_000, '{"n": ' + "9" * 5000 + "}", "not json", None, '{"a": 1}']
    frame = spark.createDataFrame([(f"/{i}", i, b) for i, b in enumerate(bodies)], "url string, seq int, body string")
    found = {(r.url, r.path, r.value) for r in json_walk.json_walk(frame).filter("path = 'a'").collect()}
    assert found == {("/0", "a", "\ufffdx"), ("/5", "a", "1")}
    assert rows(json_walk.unreadable(frame)) == [("/1", 1, "too deep"), ("/2", 2, "malformed"), ("/3", 3, "malformed"), ("/4", 4, "missing")]


def test_long_bodies_keep_their_order(spark):
    body = json.dumps({"pad": list(range(215_000)), "Mode@Redfish.AllowableValues": ["A", "B"], "Mode": "A"})
    frame = spark.createDataFrame([("/x", "0", "v", "s", body)], "url string, seq string, vendor string, source string, body string")
    assert {r.target_value for r in goals.state_surfaces(frame).filter("property_path = 'Mode'").collect()} >= {"A", "B"}


def test_files_are_read_by_many_tasks(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"f{i % 2}"
        folder.mkdir(exist_ok=True)
        (folder / f"_redfish_v1_{i}.json").write_text(json.dumps({"@odata.id": f"/redfish/v1/{i}"}))
    files = read_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= 16 and files.selectExpr("spark_partition_id() p").distinct().count() >= 8
    records, _ = read_captures(spark, str(tmp_path), source="s", vendor="v")
    assert records.count() == 300


def test_hosts_with_the_same_urls_stay_apart(spark):
    def body(url, kind, *members):
        return json.dumps({"@odata.id": url, "@odata.type": f"#{kind}.v1.{kind}", "Members": [{"@odata.id": m} for m in members]})

    data = [
        ("a", "/redfish/v1/", 0, body("/redfish/v1", "Root", "/redfish/v1/Systems/1")), ("b", "/redfish/v1", 1, body("/redfish/v1", "Root")),
        ("a", "/redfish/v1/Systems/1", 2, body("/redfish/v1/Systems/1", "System", "/redfish/v1/Chassis/1")),
        ("b", "/redfish/v1/Systems", 3, body("/redfish/v1/Systems", "Systems", "/redfish/v1/Systems/1")),
        ("b", "/redfish/v1/Systems/1", 4, body("/redfish/v1/Systems/1", "Other")), ("b", "/redfish/v1/Chassis/1", 5, body("/redfish/v1/Chassis/1", "Chassis")),
        ("a", "/redfish/v1/Systems/1", 6, body("/redfish/v1/Systems/1", "Newer", "/redfish/v1/Chassis/1")),
    ]
    records, by = spark.createDataFrame(data, "host string, url string, seq long, body string"), ["host"]
    both = tree.graph_nodes(tree.last_wins(records, by))
    parents = tree.containment_parent(both, by)
    refs = tree.harvest_refs(both, by)
    edges = tree.reference_edges(refs, both, by)

    def joined(part):
        """Everything about one host, from its own records alone."""
        nodes = tree.graph_nodes(tree.last_wins(part))
        alone = tree.containment_parent(nodes)
        own_refs = tree.harvest_refs(nodes)
        own_edges = tree.reference_edges(own_refs, nodes)
        return [nodes.select("url", "first_seq", "resource_type"), alone, own_refs.select("url", "ref"), own_edges.select("url", "ref"),
                tree.neighbors(alone, own_edges), tree.child_relation(nodes, alone), tree.frontier(own_refs, nodes),
                tree.candidates(nodes.drop("host"), tree.child_relation(nodes, alone)).select("url", "http_method", "child_relation_name")]

    together = [both.select("host", "url", "first_seq", "resource_type"), parents, refs.select("host", "url", "ref"), edges.select("host", "url", "ref"),
                tree.neighbors(parents, edges, by), tree.child_relation(both, parents, by), tree.frontier(refs, both, by),
                tree.candidates(both, tree.child_relation(both, parents, by), by=by).select("host", "url", "http_method", "child_relation_name")]
    for host in "ab":
        for mine, alone in zip(together, joined(records.filter(f"host = '{host}'"))):
            assert rows(mine.filter(f"host = '{host}'").drop("host")) == rows(alone)
    assert rows(tree.frontier(refs, both, by)) == [("a", "/redfish/v1/Chassis/1")]


def test_a_sample_is_a_top_n(spark):
    frame = spark.range(1000).withColumnRenamed("id", "k")
    plan = mix.seeded_sample(frame, "k", 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
    assert mix.seeded_sample(frame, "k", 0, 1).count() == 0 and mix.seeded_sample(frame, "k", 2000, 1).count() == 1000
