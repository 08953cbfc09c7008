"""Queries with as many rows as the input: what they shuffle is cut by the bytes of the input, not by the session's partitions."""

import json

import pytest

from conftest import rows
from treecorpus import session
from treecorpus.operators import json_walk as walk, vocabulary
from treecorpus.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["e18_vocabulary", "b11_minimal_next_phase", "b10_render_contract_rows", "b10_render_call_rows"])
def test_no_shuffle_is_left_to_the_session(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if any(step in line for step in ("Exchange", "Aggregate", "Sort", "Join"))]


def test_staging_reads_files_in_small_splits(spark, tmp_path):
    """A task that combines and sorts what it reads takes few rows, however large the files are."""
    (tmp_path / "in").mkdir()
    key, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key, None)
    session.staged(spark, "splits", str(tmp_path / "in"), lambda: seen.append(spark.conf.get(key)) or spark.range(1))
    assert seen == ["16m"] and spark.conf.get(key, None) == before


def test_a_walk_may_leave_out_places_without_tokens(spark):
    bodies = [
        {"@odata.id": "/v1/a", "x@odata.type": "#T", "@odata.context": "c", "Name": "n", "Deep": {"my@odata.id.x": "/v1/b", "Size": 3}},
        {"Actions": {"#Go": {"target": "/v1/a/Actions/Go", "T@Redfish.AllowableValues": ["p", ["q"], 4, None, {"k": "v"}]}, "Oem": {"#Sub": {}}}},
        {"X": {"@Redfish.Settings": {"Time": [1, {"At": "now"}], "Off": None}}, "@Redfish.SettingsObject": "s", "#": "no"},
        {"MyAttributes": {"A": True, "B": [2.5, None, {"C": "d"}]}, "Attributes": [{"E": "f"}, "g"], "targets": ["/no"], "Plain": ["h", {"I": 1}]},
        {"Mixed": [[{"target": 7}, {"target": "JID_1"}]], "Attributes": "alone", "T@Redfish.AllowableValues": "one"},
        ["top", {"@odata.id": "/v1/c.1"}], "text", 5, None, {},
    ]
    frame = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [(None,), ("{",)], "body string")
    whole = vocabulary.vocabulary(walk.json_walk(frame, carry=()))
    lean = walk.json_walk(frame, carry=(), keep=vocabulary.may_speak, fields=vocabulary.FIELDS)
    assert rows(vocabulary.vocabulary(lean)) == rows(whole) and len(rows(whole)) == 27
    assert not lean.filter("key in ('Name', 'Size', 'Plain', 'I')").head(1)
