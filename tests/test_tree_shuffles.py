"""What the graph operators move: no bodies, no references that cannot name a child, no rows sorted for a minimum."""

import json

import pytest

from conftest import rows
from treecorpus.operators import tree

BODIES = {
    "/v1": {"Systems": {"@odata.id": "/v1/s"}, "Far": {"@odata.id": "/v1/s/1/x"}, "Links": {}},
    "/v1/s": {"Members": [{"@odata.id": "/v1/s/1/"}, {"@odata.id": "/v1/s/10"}], "Up": {"@odata.id": "/v1"}},
    "/v1/s/1": {"Oem": {"A": {"@odata.id": "/v1/s/10"}}, "Own": {"@odata.id": "/v1/s/1/x"},
                "Actions": {"#Go": {"target": "/v1/s/1/go"}}},
    "/v1/s/10": {"Oem": 1, "Actions": {}},
    "/v1/s/1/x": {},
}


@pytest.fixture(scope="module")
def nodes(spark):
    frame = [(u, i, "a", json.dumps(b)) for i, (u, b) in enumerate(BODIES.items())]
    return spark.createDataFrame(frame, "url string, seq long, source string, body string")


def plan_of(frame, kind="executedPlan"):
    return getattr(frame._jdf.queryExecution(), kind)().toString()


def test_relations_look_at_references_into_the_own_subtree(nodes):
    found = tree.child_relation(nodes, tree.containment_parent(nodes.select("url")))
    assert dict(rows(found)) == {"/v1": "v1", "/v1/s": "Systems", "/v1/s/1": "Members", "/v1/s/10": "Members", "/v1/s/1/x": "Own"}
    assert "StartsWith(value" in plan_of(found, "optimizedPlan")


def test_neighbors_are_combined_without_a_sort(nodes):
    near = tree.neighbors(tree.containment_parent(nodes.select("url")), tree.reference_edges(tree.harvest_refs(nodes), nodes))
    assert not [line for line in plan_of(near).splitlines() if "SortAggregate" in line and "min(" in line]
    held = {(r.url, r.neighbor): (r.rank, r.ord) for r in near.collect()}
    assert held["/v1", "/v1/s"][0] == 0 and held["/v1/s", "/v1"] == (1, 0)
    assert held["/v1/s/1", "/v1/s/10"][0] == 2 and held["/v1/s/1", "/v1/s/10"][1] > 0
    assert dict(near.dtypes) == {"url": "string", "neighbor": "string", "rank": "int", "ord": "int"}


def test_the_census_joins_no_bodies(nodes):
    census = tree.corpus_census(tree.graph_nodes(nodes), tree.containment_parent(nodes.select("url")))
    assert tuple(census.head()) == ("a", 5, 0.0, 0.8, 0.2, 0.2, 0.4)
    plan = plan_of(census, "optimizedPlan")
    assert "body" not in plan[plan.index("Join"):plan.index("Join") + plan[plan.index("Join"):].index("Project")]
    assert "json_object_keys" not in plan[:plan.index("Join")]


def test_neither_folders_nor_prefixes_travel_next_to_urls(spark):
    urls = ["/", "//", "a", "a/b", "/a", "/a/b", "/a//b", "/a//b/c", "/a/b/c/d", "é/ü", "é/ü/x/y", "/v/w/x", ""]
    found = tree.containment_parent(spark.createDataFrame([(u,) for u in urls], "url string"))

    def nearest(url):
        parts = url.split("/")
        return next((p for p in ("/".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)) if p and p != url and p in urls), None)

    assert dict(found.collect()) == {u: nearest(u) for u in urls}
    plan = plan_of(found, "optimizedPlan").splitlines()
    assert not [line for line in plan if "Project [url" in line and "AS folder" in line]
    assert not [line for line in plan if "Generate" in line and "prefix" in line]
