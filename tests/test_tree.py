"""Graph, goals and slots on small hand-made captures."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from treecorpus.functions import goal_ids as g
from treecorpus.operators import goals, json_walk as walk, slots, tree

SYSTEM = {
    "@odata.id": "/v1/Systems/1", "@odata.type": "#ComputerSystem.v1.ComputerSystem",
    "Status": {"Origin": {"@odata.id": "/v1/Chassis/1/"}},
    "Boot": {"BootSourceOverrideTarget": "Pxe", "BootSourceOverrideTarget@Redfish.AllowableValues": ["Pxe", "Hdd"]},
    "Actions": {"#ComputerSystem.Reset": {"target": "/v1/Systems/1/Reset",
                                          "ResetType@Redfish.AllowableValues": ["On", "ForceOff"]}},
    "Password": "x", "Serial": {"Number": 1}, "Ratio": 1.5, "Flag": True, "None": None, "List": [1, {"a": "b"}],
}
BODIES = {
    "/v1": {"@odata.id": "/v1", "Systems": {"@odata.id": "/v1/Systems"}},
    "/v1/Systems/": {"@odata.type": "#Collection.Collection", "Members": [{"@odata.id": "/v1/Systems/1"}]},
    "/v1/Systems/1": SYSTEM,
    "/v1/Chassis/1": {"@odata.type": "#Chassis.v1.Chassis"},
}


@pytest.fixture(scope="module")
def nodes(spark):
    data = [(u, i, "s", "", json.dumps(b)) for i, (u, b) in enumerate(BODIES.items())]
    data.append(("/v1/Chassis/1", 0, "s", "", "{}"))
    return tree.last_wins(spark.createDataFrame(data, "url string, seq long, source string, vendor string, body string"))


def test_parents_skip_unwalked_levels(nodes):
    parents = dict(rows(tree.containment_parent(nodes.select("url"))))
    assert parents == {"/v1": None, "/v1/Systems": "/v1", "/v1/Systems/1": "/v1/Systems", "/v1/Chassis/1": "/v1"}


def test_references_and_neighbors(nodes):
    refs = tree.harvest_refs(nodes)
    assert ("/v1/Systems/1", "/v1/Chassis/1") in [r[:2] for r in rows(refs.select("url", "ref"))]
    near = tree.neighbors(tree.containment_parent(nodes.select("url")), tree.reference_edges(refs, nodes))
    assert [r[1] for r in rows(near.filter("url = '/v1/Systems/1'").orderBy("rank"))] == ["/v1/Chassis/1", "/v1/Systems"]


def test_relation_prefers_the_parents_key(nodes):
    found = dict(rows(tree.child_relation(nodes, tree.containment_parent(nodes.select("url")))))
    assert found == {"/v1": "v1", "/v1/Systems": "Systems", "/v1/Systems/1": "Members", "/v1/Chassis/1": "Chassis"}


def test_action_target(nodes):
    flags = dict(rows(tree.graph_nodes(nodes).select("url", "has_action_target")))
    assert flags["/v1/Systems/1"] is True and flags["/v1/Chassis/1"] is False


def test_last_body_wins(nodes):
    # The empty body has the smaller sequence number.
    assert nodes.filter("url = '/v1/Chassis/1'").select("body").head()[0] == json.dumps(BODIES["/v1/Chassis/1"])


def test_walk_order_and_types(nodes):
    leaves = walk.json_walk(nodes, carry=("url",)).filter("url = '/v1/Systems/1'").orderBy("ord").collect()
    kinds = {r["path"]: r["json_type"] for r in leaves}
    assert [r["ord"] for r in leaves] == list(range(len(leaves)))
    assert kinds["Ratio"] == "number" and kinds["Flag"] == "boolean" and kinds["None"] == "null"
    assert kinds["List[]"] in ("integer", "object") and kinds["List[].a"] == "string"
    assert [r["key"] for r in leaves if r["parent_ord"] == 0] == list(SYSTEM)


def test_walk_of_deep_and_broken_bodies(spark):
    deep = "[" * 3000 + "]" * 3000
    frame = spark.createDataFrame([("a", 0, "{oops"), ("b", 0, None), ("c", 0, deep[:2] + "1" + deep[-2:])],
                                  "url string, seq long, body string")
    assert rows(walk.json_walk(frame).groupBy("url").count()) == [("c", 3)]


def test_goals(nodes):
    found = {r["goal_id"] for r in goals.build_surfaces(nodes).collect()}
    assert "boot.computer_system.Boot.BootSourceOverrideTarget.eq.Hdd" in found
    assert "action.computer_system.ComputerSystem.Reset.ResetType.eq.ForceOff" in found
    assert "power.computer_system.PowerState.eq.Off" in found
    assert "flag.computer_system.Flag.eq.True" in found
    assert "ratio.computer_system.Ratio.eq.1.5" in found
    assert not [f for f in found if "Password" in f or "Serial" in f]


def test_sensitive_paths(spark):
    paths = {
        "Serial.Number": True, "Status.Health": False, "A.ApiKey": True, "Cert.Certificate": True,
        "CertificateService.x": False, "Host.Name": True, "Oem[].Token": True, "Monkey": True, "User.Name": False,
        "UserName": True,
    }
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert dict(rows(frame.select("path", g.is_sensitive(F.col("path"))))) == paths


def test_slots(nodes):
    found = {r["path"]: (r["choices"], r["current_value"]) for r in slots.inline_slots(nodes).collect()}
    assert found == {
        "Boot.BootSourceOverrideTarget": (["Pxe", "Hdd"], "Pxe"),
        "Actions.#ComputerSystem.Reset.ResetType": (["On", "ForceOff"], None),
    }


def test_verify(nodes):
    done = {r["goal_id"]: r["satisfied"] for r in goals.verify_goals(
        goals.build_surfaces(nodes), walk.json_walk(nodes, carry=("url",))).collect()}
    assert done["boot.computer_system.Boot.BootSourceOverrideTarget.eq.Pxe"] is True
    assert done["boot.computer_system.Boot.BootSourceOverrideTarget.eq.Hdd"] is False
    assert done["ratio.computer_system.Ratio.eq.1.5"] is True
    assert done["action.computer_system.ComputerSystem.Reset.ResetType.eq.On"] is False


def test_template_count(nodes):
    surfaces = goals.build_surfaces(nodes)
    assert goals.template_text(surfaces, 0).count() == 0
    assert goals.template_text(surfaces, 3).count() == 3 * surfaces.count()


def plain_digest(value):
    """An order-free form of a JSON value."""
    if isinstance(value, dict):
        return ("object", tuple(sorted((k, plain_digest(v)) for k, v in value.items())))
    if isinstance(value, list):
        return ("array", tuple(plain_digest(v) for v in value))
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return (type(value).__name__, value)
    return ("number", float(value))


def test_fingerprints(spark):
    """Equal digests for equal values whatever the order of keys, different ones for all others."""
    values = [{"a": 1, "b": {"x": [1, 2], "y": None}}, {"b": {"y": None, "x": [1, 2]}, "a": 1.0}, {"a": True, "b": {"x": [2, 1], "y": None}},
              {"a": "1"}, {"a": "true"}, {"a": True}, [], {}, [[]], [{}], "", None, 0, False, {"": ""}, {"": None}, {"a,b": "c"}, {"a": "b", "c": "d"},
              {"a": {"b": 1}, "c": 2}, {"a": {"b": 1, "c": 2}}, ["a", "b"], ["b", "a"], ["ab"], [["a"], "b"], {"k": [[[[1]]]]}, {"deep": {"a": {"b": {"c": {"d": [1, {"e": 2}]}}}}}]
    records = spark.createDataFrame([(f"/{i}", json.dumps(v)) for i, v in enumerate(values)], "url string, body string")
    leaves = walk.json_walk(records, carry=("url",), fields=("ord", "parent_ord", "key", "path", "json_type", "value"))
    got = walk.fingerprints(leaves)
    assert got.count() == leaves.count()
    roots = {int(r.url[1:]): r.digest for r in got.filter("ord = 0").collect()}
    # A body that is null is no value of the walk.
    assert set(roots) == {i for i, v in enumerate(values) if v is not None}
    for i in roots:
        for j in roots:
            assert (roots[i] == roots[j]) == (plain_digest(values[i]) == plain_digest(values[j])), (values[i], values[j])
    parts = {r.digest for r in got.filter("path = 'b'").collect()}
    assert len(parts) == 2


def test_fingerprints_need_a_whole_walk(spark):
    records = spark.createDataFrame([("/a", '{"a": {"b": 1}}')], "url string, body string")
    leaves = walk.json_walk(records, carry=("url",), fields=("ord", "parent_ord", "key", "path", "json_type", "value")).filter("path <> 'a'")
    with pytest.raises(ValueError, match="not whole"):
        walk.fingerprints(leaves)


def test_walk_as_a_table_function(spark):
    """The lateral function gives the rows of the walk, bodies that cannot be read none."""
    bodies = [json.dumps(SYSTEM), "{", None, "[1, [2, {\"a\": null}]]", "3", "\"x\"", "null", '{"a.b": {"c": [true, 1.5]}}', json.dumps(SYSTEM)]
    records = spark.createDataFrame([(f"/{i}", b) for i, b in enumerate(bodies)], "url string, body string")
    walk.register_sql(spark, "walked")
    got = spark.sql("SELECT url, w.* FROM {t} t, LATERAL walked(t.body) w", t=records)
    want = walk.json_walk(records, carry=("url",))
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 30
