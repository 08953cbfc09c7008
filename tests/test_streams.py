"""Stateful streams against their batch operators, whatever order the input comes in."""

import json
import os
import random
import time

import pytest

from treecorpus.operators import slots
from treecorpus.sources import capture_stream, captures
from treecorpus.streaming import enum_index

RECORDS = "url string, trust int, seq long, body string"


def registry(*attributes):
    return json.dumps({"@odata.type": "#AttributeRegistry.v1_0_0.AttributeRegistry", "RegistryEntries": {"Attributes": [
        {"AttributeName": name, "Type": kind, "ReadOnly": fixed, "Value": [{"ValueName": v} for v in values]} for name, kind, fixed, values in attributes]}})


def info(*parameters):
    return json.dumps({"@odata.type": "#ActionInfo.v1_0_0.ActionInfo", "Parameters": [
        {"Name": name, "DataType": kind, "Required": need, "AllowableValues": values} for name, kind, need, values in parameters]})


def settings(**allowed):
    return json.dumps({"@odata.type": "#ComputerSystem.v1_0_0.ComputerSystem", "Boot": {f"{k}@Redfish.AllowableValues": v for k, v in allowed.items()},
                       "Actions": {"#X.Reset": {"Mode@Redfish.AllowableValues": ["inline"], "Only@Redfish.AllowableValues": ["a", "b"]}}})


CAPTURES = [
    ("/r/1", 5, 4, registry(("Speed", "Integer", False, []), ("Mode", "Enumeration", False, ["A", "B"]), ("Gone", "String", False, []))),
    ("/r/1", 5, 2, registry(("Speed", "Enumeration", True, ["x"]), ("Mode", "Enumeration", False, ["first"]), ("Mode", "String", False, []))),
    ("/r/1", 3, 1, registry(("Old", "String", False, []))),
    ("/r/2", 5, 3, registry(("Speed", "Boolean", False, []), ("Late", "Password", False, []))),
    ("/r/2", 4, 0, registry(("Late", "Integer", False, []), ("Never", "Integer", False, []))),
    ("/r/3", 5, 9, registry(("Target", "Enumeration", True, ["r"]), ("", "String", False, []))),
    ("/s/1", 5, 5, settings(Target=["Pxe", "Hdd"], Speed=["1", "2"], Empty=[])),
    ("/s/2", 5, 1, settings(Target=["Usb"])),
    ("/s/2", 5, 0, "{\"@odata.type\": \"#ComputerSystem.v1_0_0.ComputerSystem\"}"),
    ("/a/1", 1, 7, info(("Mode", "String", True, ["On", "Off"]), ("Delay", "Integer", False, []))),
    ("/a/2", 2, 8, info(("Delay", "Number", True, []))),
    ("/bad", 5, 1, "{\"x@Redfish.AllowableValues\": ["), ("/none", 5, 1, None),
    ("/s/3", 5, 11, settings(**{"Tärget": ["é"]})),
]


def best(captures):
    out = {}
    for row in captures:
        if row[0] not in out or (-row[1], row[2]) < (-out[row[0]][1], out[row[0]][2]):
            out[row[0]] = row
    return list(out.values())


def wanted(spark, captures):
    records = spark.createDataFrame(best(captures), RECORDS)
    rows = [("PATCH", *r) for r in slots.patch_schema(records).collect()] + [("POST", *r) for r in slots.post_schema(records).collect()]
    return sorted((schema, name, kind, required, choices, origin) for schema, name, kind, required, choices, origin in rows)


@pytest.mark.parametrize("order", ["as given", "backwards", "shuffled"])
def test_enum_index(spark, tmp_path, order):
    captures = list(CAPTURES)
    if order == "backwards":
        captures.reverse()
    elif order == "shuffled":
        random.Random(2).shuffle(captures)
    for i in range(0, len(captures), 2):
        spark.createDataFrame(captures[i:i + 2], RECORDS).coalesce(1).write.parquet(str(tmp_path / f"lot={i}"))
        for part in (tmp_path / f"lot={i}").glob("*.parquet"):
            os.utime(part, (1_700_000_000 + 60 * i,) * 2)
    stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = enum_index.enum_index(spark, stream)
    rows = sorted((r.schema, r.name, r.type, r.required, r.choices, r.extracted_from) for r in got.select(
        "schema", "name", "type", "required", "choices", "extracted_from").collect())
    want = wanted(spark, captures)
    assert rows == want
    names = {r[1] for r in want}
    assert {"Speed", "Mode", "Late", "Target", "Delay", "Only"} <= names and not {"Gone", "Old", "Never", "Empty"} & names
    assert dict((r[:2], r[4]) for r in want)["PATCH", "Mode"] == ["first"]


def test_record_slots_are_those_of_the_batch(spark):
    """One list per record holds what the three extractors give, first fragments chosen."""
    records = spark.createDataFrame(CAPTURES, RECORDS)
    listed = {(r.url, r.seq, s.schema, s.name, s.type, tuple(s.choices or ())) for r in slots.record_slots(records).collect() for s in r.slots}
    each = set()
    for method, frame in (("PATCH", slots.registry_slots(records).filter("not read_only")), ("POST", slots.action_info_slots(records))):
        each |= {(r.url, r.seq, method, r.name, r.type, tuple(r.choices or ())) for r in frame.collect()}
    for r in slots.inline_slots(records).collect():
        each.add((r.url, r.seq, "POST" if r.path.startswith("Actions") else "PATCH", r.name, r.type, tuple(r.choices or ())))
    assert listed == each and len(each) > 20


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)


LOTS = [
    {"_redfish_v1.json": b'{"@odata.id": "/redfish/v1"}', "a/_x.json": b'{"Name": "x"}', "a/b/c/d/e/_deep.json": b'{"Name": "deep"}',
     "a/manifest.json": b'{"k": 1}', "a/notes.txt": b"no", "z/_empty.json": b" "},
    {"a/_y.json": b'{"Name": "\xff\xfe"}', "a/b/_bad.json": b"{", "q/_list.json": b"[1]", "q/corpus.json": b'{"@odata.id": "/kept"}'},
    {"a/_x.json": b'{"Name": "x again"}'},
]


def test_a_growing_folder(spark, tmp_path):
    """Lots that come between triggers are read once each; all in all as the batch reader reads them."""
    root, at = tmp_path / "in", tmp_path / "done"
    root.mkdir()
    assert [x.count() for x in capture_stream.ingest_folder(spark, str(root), str(at), "lab", settle=0.2)] == [0, 0]
    counts = []
    for lot in LOTS[:2]:
        write(root, lot)
        time.sleep(0.5)
        records, skipped = capture_stream.ingest_folder(spark, str(root), str(at), "lab", vendor="v", settle=0.2)
        counts.append((records.count(), skipped.count()))
    assert counts == [(3, 2), (5, 4)]
    batch, left_out = captures.read_captures(spark, str(root), "lab", vendor="v")
    plain = lambda frame: sorted(tuple(r) for r in frame.collect())
    assert plain(records) == plain(batch) and plain(skipped) == plain(left_out)
    assert {r.reason for r in skipped.collect()} == {"sidecar", "empty", "malformed", "not an object"}
    # A file written anew is a new capture; the old one stays known.
    write(root, LOTS[2])
    time.sleep(0.5)
    records, _ = capture_stream.ingest_folder(spark, str(root), str(at), "lab", vendor="v", settle=0.2)
    assert sorted(r.body for r in records.collect() if r.url == "/x") == ['{"Name": "x again"}', '{"Name": "x"}']


def test_files_wait_until_they_settle(spark, tmp_path):
    root, at = tmp_path / "in", tmp_path / "done"
    write(root, LOTS[0])
    assert capture_stream.ingest_folder(spark, str(root), str(at), "lab", settle=600)[0].count() == 0
    assert capture_stream.ingest_folder(spark, str(root), str(at), "lab", settle=-1)[0].count() == 3


def test_only_annotated_bodies_go_to_python(spark):
    """What the walk is given of a body without annotations is nothing; the body itself stays in the plan below it."""
    plan = slots.record_slots(spark.createDataFrame(CAPTURES, RECORDS))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert "CASE WHEN (Contains(body" in below and "body" not in above


def test_a_name_that_very_many_urls_have_is_merged_by_its_first_fragment(spark):
    """Changes that leave a name's first fragment alone don't look at what its other URLs said; withdrawals do."""
    said = "schema string, name string, url string, trust int, seq long, there boolean, tier int, ord int, type string, required boolean, choices array<string>, extracted_from string"
    row = lambda name, url, seq, there=True: ("PATCH", name, url, 5, seq, there, *((1, 0, url, False, None, "inline") if there else (None,) * 6))
    index = spark.createDataFrame([row("Hot", "/1", 1), row("Gone", "/2", 2), row("Back", "/3", 3)], said)
    told = [row("Hot", "/0", 4), row("Hot", "/9", 0), row("Gone", "/2", 1, False), row("Back", "/3", 9), row("New", "/7", 1), row("Nil", "/7", 1, False)]
    # The log is what was told of all URLs; only Gone and Back are to be read from it, so Hot is left out of it here.
    log = [(*row("Gone", "/2", 2), 0), (*row("Gone", "/4", 6), 0), (*row("Gone", "/5", 5), 0), (*row("Gone", "/5", 5, False), 1),
           (*row("Back", "/3", 3), 0), (*row("Back", "/6", 7), 0), *[(*r, 2) for r in told if r[1] != "Hot"]]
    got = enum_index.merged(index, spark.createDataFrame(told, said), spark.createDataFrame(log, said + ", epoch long"))
    assert {(r.name, r.type) for r in got.collect()} == {("Hot", "/9"), ("Gone", "/4"), ("Back", "/6"), ("New", "/7")}


def test_the_index_needs_no_state_store_with_python(spark, tmp_path):
    """No captures, and a session whose settings are as before."""
    spark.createDataFrame([], RECORDS).write.parquet(str(tmp_path / "in"))
    before = {key: spark.conf.get(key, None) for key in enum_index.ROCKS}
    got = enum_index.enum_index(spark, spark.readStream.schema(RECORDS).parquet(str(tmp_path / "in")))
    assert got.columns == ["schema", "name", "type", "required", "choices", "extracted_from"] and got.isEmpty()
    assert {key: spark.conf.get(key, None) for key in enum_index.ROCKS} == before
