"""Goals of records that are one per URL: only those that may meet another are grouped."""

import json

from pyspark.sql import functions as F

from conftest import rows
from treecorpus.operators import goals, json_walk as walk
from treecorpus.sources import corpus_io

ALLOWED = "@Redfish.AllowableValues"
BODIES = {
    "/plain": {"@odata.type": "#Task.v1.Task", "State": "Done", "Total": 3, "Deep": {"er": True}},
    "/dots": {"@odata.type": "#Task.v1.Task", "a.b": "x", "a": {"b": "x"}, "c": "y"},
    "/list": {"@odata.type": "#Task.v1.Task", "L": ["a b", "a_b", "z"], "M": [{"k": 1}, {"k": 1}], "only": "one"},
    "/mode": {"@odata.type": "#Task.v1.Task", "Mode": "A", f"Mode{ALLOWED}": ["A", "B"]},
    "/system": {"@odata.type": "#ComputerSystem.v1.ComputerSystem", "PowerState": "On", "Boot": {"BootSourceOverrideTarget": "Pxe"},
                "Actions": {"#ComputerSystem.Reset": {"target": "/x", f"ResetType{ALLOWED}": ["On", "Off"]}, "#ComputerSystem.Ping": {}}},
    "/bios": {"@odata.type": "#Bios.v1.Bios", "Attributes": {"Brand": "b", "Size": 4}},
    "/schema": {"@odata.type": "#Task.v1.Task", "$schema": "x", "State": "Done"},
    "/act": {"@odata.type": "#Task.v1.Task", "Actions.#A.b": "v", "Actions": {"#A.b": {}}},
}


def records(spark):
    frame = [(u, 1, "s", "v", json.dumps(b)) for u, b in BODIES.items()]
    return spark.createDataFrame(frame, "url string, seq long, source string, vendor string, body string")


def test_the_same_goals(spark):
    frame = records(spark)
    columns = sorted(goals.build_surfaces(frame).columns)
    whole = rows(goals.build_surfaces(frame).select(columns))
    assert rows(goals.build_surfaces(frame, one_per_url=True).select(columns)) == whole
    assert len({r[columns.index("resource_uri")] for r in whole}) == 7
    assert rows(goals.first_state_surfaces(frame, one_per_url=True).select(columns)) == rows(
        goals.first_surfaces(goals.state_surfaces(frame)).select(columns))


def test_plain_leaves(spark):
    leaves = goals.goal_leaves(goals.state_documents(records(spark)))
    plain = {(r.url, r.path) for r in leaves.filter("plain = 1").filter(walk.is_scalar()).collect()}
    assert plain == {("/plain", "State"), ("/plain", "Total"), ("/plain", "Deep.er"), ("/dots", "c"), ("/list", "only")}


def test_manifest_counts_goals_before_it_groups(spark):
    surfaces = goals.build_surfaces(records(spark), one_per_url=True).persist()
    found = {(r.dimension, r.key): (r.n, r.goal_ids) for r in goals.goal_manifest(surfaces).collect()}
    assert found["total", ""] == (surfaces.count(), surfaces.select("goal_id").distinct().count())
    assert found["source", "s"] == found["vendor", "v"] == found["total", ""]
    plan = goals.goal_manifest(surfaces)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")


def test_goal_rows_are_compressed(spark, tmp_path):
    surfaces = goals.build_surfaces(records(spark), one_per_url=True).drop("at")
    corpus_io.write_rows(surfaces, str(tmp_path / "goals"))
    assert [p for p in (tmp_path / "goals").iterdir() if p.name.endswith(".json.gz")]
    assert corpus_io.read_goal_surfaces(spark, str(tmp_path / "goals")).count() == surfaces.count()


def test_verification_groups_where_it_joined(spark):
    frame = records(spark)
    done = goals.verify_goals(goals.build_surfaces(frame, one_per_url=True), walk.json_walk(frame, carry=("url",)))
    assert done.filter("satisfied").count() == done.filter(F.col("reason") == "state_eq").filter("satisfied").count() > 0
    text = goals.compound_text(goals.template_text(goals.first_state_surfaces(frame, one_per_url=True), 1).select(
        "resource_uri", F.struct("fact_path").alias("pos"), "text"), ["resource_uri"], F.lit(False))
    assert {r.resource_uri: r.n for r in text.collect()}["/plain"] == 3
