"""Sources, mixing, sampling and positions."""

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from treecorpus.functions import hashing, json_text
from treecorpus.operators import mix, normalize, positions, vocabulary
from treecorpus.session import scratch_path
from treecorpus.sources import captures, corpus_io


@pytest.fixture(scope="module")
def records(spark):
    data = [(f"/u/{i % 40}", i, "s", 1 + i % 5, "GET", None, None, "", "{}") for i in range(200)]
    return spark.createDataFrame(
        data, "url string, seq long, source string, trust int, method string, allowed_methods array<string>, "
              "vendor string, schema_version string, body string")


def test_dedup_keeps_trust_then_first(records):
    out = mix.dedup_by_trust(records)
    best = {}
    for r in sorted(records.collect(), key=lambda r: (-r["trust"], r["seq"])):
        best.setdefault(r["url"], r["seq"])
    assert dict(rows(out.select("url", "seq"))) == best
    assert rows(mix.dedup_by_trust(out.drop("pos")).select("url", "seq")) == rows(out.select("url", "seq"))


def test_split_is_a_partition_and_grows(records):
    rows_ = mix.dedup_by_trust(records)
    held = {}
    for fraction in (0.0, 0.2, 0.6, 1.0):
        parts = mix.hash_split(rows_, fraction, "SIM_DRIFT").groupBy("split").agg(F.collect_set("url").alias("u"))
        found = {r["split"]: set(r["u"]) for r in parts.collect()}
        assert sum(map(len, found.values())) == 40
        held[fraction] = found.get("eval", set())
    assert not held[0.0] and held[0.2] <= held[0.6] <= held[1.0] and len(held[1.0]) == 40
    with pytest.raises(ValueError):
        mix.hash_split(rows_, 1.5)


def test_blake2b_parity(spark):
    keys = ["/a", "/b/ç"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(
        hashing.unit_hash(F.col("k"), 3, "blake2b")).collect()]
    want = [int.from_bytes(hashlib.blake2b(f"3:{k}".encode(), digest_size=8).digest(), "big") / 2**64 for k in keys]
    assert got == want


def test_hashed_position_is_a_permutation(spark):
    frame = spark.range(5000).repartition(7)
    placed = {r["id"]: r["pos"] for r in positions.hashed_position(frame, "id", 4).collect()}
    order = sorted(placed, key=lambda i: (hashlib.md5(f"4:{i}".encode()).hexdigest(), i))
    assert [placed[i] for i in order] == list(range(5000))


def test_grouped_position_of_a_hot_group(spark):
    data = [("hot" if i % 3 else f"c{i % 11}", random.Random(i).randrange(10**6), i) for i in range(3000)]
    frame = spark.createDataFrame(data, "k string, t long, i long")
    got = {r["i"]: r["pos"] for r in positions.grouped_position(frame, ["k"], ["t", "i"], F.floor(F.col("t") / 1000)).collect()}
    want = {}
    for key in {d[0] for d in data}:
        for place, row in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: d[1:])):
            want[row[2]] = place
    assert got == want


def test_sample_contexts_differ(spark):
    drawn = mix.sample_contexts(spark.range(500).withColumnRenamed("id", "candidate"), spark.range(4), "id", 3, 1)
    groups = drawn.groupBy("candidate").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    assert groups.filter("n <> 3 or d <> 3").count() == 0 and groups.count() == 500
    assert drawn.select("id").distinct().count() == 4
    with pytest.raises(ValueError):
        mix.sample_contexts(spark.range(1), spark.range(9), "id", 4, 1)


def test_sample_sizes(spark):
    frame = spark.range(100)
    assert mix.seeded_sample(frame, "id", 1000, 1).count() == 100
    assert mix.seeded_sample(frame, "id", 0, 1).count() == 0
    assert mix.seeded_split(frame, "id", 0.25, 1).filter("part = 'train'").count() == 25


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("cap")
    files = {
        "a/_v1_Systems.json": {"Name": "x"}, "a/b/chassis.json": {"@odata.id": "/v1/Chassis", "@odata.type": "#C.v1.C"},
        "list.json": [1], "manifest.json": {"corpora": []}, "note.txt": {},
        "rest_api_map.v1.json": {"allowed_methods_mapping": {"/v1/Chassis": ["GET", "PATCH"]}},
        "x/manifest.json": {"@odata.id": "/v1/Manifest"},
    }
    for name, body in files.items():
        path = root / "dataset" / "acme" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(body))
    (root / "dataset" / "acme" / "latin.json").write_bytes(b'{"@odata.id": "/v1/L", "t": "5\xb0"}')
    (root / "dataset" / "acme" / "empty.json").write_text("")
    (root / "dataset" / "acme" / "cut.json").write_text('{"a": ')
    (root / "m.json").write_text(json.dumps({"corpora": [
        {"id": "c1", "kind": "full", "archive": "x/acme.tar.gz", "vendor": "acme"}, {"id": "c2", "kind": "raw"}]}))
    return root


def test_read_captures(spark, folder):
    good, bad = captures.read_captures(spark, str(folder / "dataset" / "acme"), "src", vendor="acme")
    assert rows(good.select("url", "url_from")) == [
        ("/v1/Chassis", "odata"), ("/v1/L", "odata"), ("/v1/Manifest", "odata"), ("/v1/Systems", "filename")]
    assert "�" in good.filter("url = '/v1/L'").head()["body"]
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["empty", "malformed", "not an object", "sidecar", "sidecar"]


def test_missing_folder_is_empty(spark, folder):
    good, bad = captures.read_captures(spark, str(folder / "nowhere"), "src")
    assert good.count() == 0 and bad.count() == 0


def test_sources_from_manifest(spark, folder):
    out, skipped = captures.sources_from_manifest(spark, str(folder / "m.json"), str(folder))
    assert sorted(r["reason"] for r in skipped.collect()) == ["empty", "malformed", "not an object", "sidecar", "sidecar"]
    assert out.count() == 4 and out.filter("allowed_methods is null").count() == 3
    assert rows(out.select("url", "corpus_id", "vendor").filter("url = '/v1/Chassis'")) == [("/v1/Chassis", "c1", "acme")]
    assert out.filter("url = '/v1/Chassis'").head()["allowed_methods"] == ["GET", "PATCH"]
    none, _ = captures.sources_from_manifest(spark, str(folder / "m.json"), str(folder), ids=["zz"])
    assert none.count() == 0


def test_corpus_round_trip(spark, records):
    path = scratch_path(spark, "t")
    split = mix.hash_split(mix.dedup_by_trust(records), 0.5, "SIM_DRIFT")
    corpus_io.write_corpus(normalize.normalize_records(split), mix.mix_manifest(split, mix.split_policy_id()), path)
    back = corpus_io.read_corpus(spark, path)
    assert rows(back.select("url", "split", "semantics.mutating")) == [
        (r["url"], r["split"], False) for r in sorted(split.collect(), key=lambda r: repr((r["url"], r["split"])))]
    total = corpus_io.read_manifest(spark, path).filter("dimension = 'total'").head()
    assert total["n"] == 40 and total["n_train"] + total["n_eval"] == 40


def test_reading_json_text():
    assert json_text.read_json('{"b": 1.0, "a": [2]}') == ('{"a":[2],"b":1}', "parsed")
    assert json_text.read_json('```json\n{"a": 1}\n```') == ('{"a":1}', "fenced")
    assert json_text.read_json('say "{" then {"a": "}"} end') == ('{"a":"}"}', "fragment")
    assert json_text.read_json("nothing") == (None, "prediction is not JSON")
    assert json_text.read_json("{a: 1}") == (None, "prediction JSON parse failed")
    assert json_text.read_json("[1, 2)") == (None, "prediction is not JSON")
    assert json_text.read_json(None) == (None, "missing prediction")


def test_lines_are_numbered_per_file(spark, tmp_path):
    for name, n in (("a.jsonl", 400), ("b.jsonl", 3)):
        (tmp_path / name).write_text("".join(f'{{"i": {i}}}\n' for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = corpus_io.read_lines(spark, str(tmp_path)).withColumn("i", F.get_json_object("line", "$.i").cast("long"))
        assert got.rdd.getNumPartitions() >= 1
        assert got.filter("i <> line_number").count() == 0 and got.count() == 403
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_request_records(spark, tmp_path):
    good = {"rest_api": "/a", "allowed_methods": ["get"], "json": {}}
    lines = [json.dumps(good), "", json.dumps({"x": {**good, "rest_api": "/b"}}), json.dumps(good), "[]"]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    kept, errors = corpus_io.load_request_records(spark, str(tmp_path / "r.jsonl"))
    assert rows(kept.select("line_number", "rest_api")) == [(1, "/a"), (3, "/b")]
    assert rows(errors) == [(4, "duplicate rest_api /a"), (5, "row must be a JSON object")]


def plain_prompts(kind, action, parameters):
    """The texts of one action, written out with itertools."""
    rows = []

    def add(ahead, held, given):
        rows.append((f"Input: {kind} {action} with {ahead}. Goal: {action} Parameter: {json.dumps(held, ensure_ascii=False)}.<|endoftext|>",
                     f"Goal: {action} Parameter: {json.dumps(held, ensure_ascii=False)}", f"Input: {kind} {action} with {given}."))

    for name, values in parameters:
        for value in values:
            add(f"{name} {value}", {name: value}, f"{name} {value}")
    if len(parameters) > 1:
        for chosen in itertools.product(*[[(name, v) for v in values] for name, values in parameters]):
            held = dict(chosen)
            add(f" {held}", held, ", ".join(f"{k}{v}" for k, v in held.items()))
    return rows or [(f"Input: {kind} {action}. Goal: {action} Parameter: [].<|endoftext|>", f"Goal: {kind} Parameter: [].", f"Input: {kind} {action}.")]


def test_prompt_rows(spark):
    actions = [("set", "a", [("X", ["1", "2"]), ("Y", ["it's", 'say "x"', "b\\c", "é"]), ("Z", ["p", "q", "r"])]),
               ("run", "b", [("X", ["1"])]), ("run", "c", []), ("run", "twice", [("X", ["1", "2"]), ("X", ["3"])])]
    frame = spark.createDataFrame(actions, "action_type string, action string, parameters array<struct<name:string,values:array<string>>>")
    got = sorted((r.prompt, r.goal, r.input) for r in vocabulary.prompt_rows(frame).collect())
    assert got == sorted(x for a in actions for x in plain_prompts(*a))


def test_a_large_product_is_spread(spark):
    """A hundred thousand combinations of one action come from many tasks, each decoded from its number."""
    parameters = [(f"p{i}", [str(v) for v in range(10)]) for i in range(5)]
    frame = spark.createDataFrame([("a", parameters), ("none", [("x", []), ("y", ["1"])])], "action string, parameters array<struct<name:string,values:array<string>>>")
    rows = vocabulary.combinations(frame, 1000)
    counts = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 100_000 and len(counts) > 8 and max(counts) < 40_000
    digits = F.array_join(F.transform("chosen", lambda c: c["value"]), "")
    assert rows.filter(digits.cast("long") != F.col("number")).isEmpty() and rows.select("number").distinct().count() == 100_000


def test_dense_index_on_sparse_orders(spark):
    """Orders that lie far apart, with most of them close together: every range numbers its share, and no window orders all."""
    seqs = [0, 1, 2, *range(10**12, 10**12 + 500), *(10**15 * k for k in range(1, 20))]
    rows = spark.createDataFrame([(f"k{i % 400}", s) for i, s in enumerate(reversed(seqs))], "key string, seq long").repartition(5)
    index = positions.dense_index(rows, "key", "seq", range_rows=50)
    first = {}
    for i, s in enumerate(reversed(seqs)):
        first[f"k{i % 400}"] = min(s, first.get(f"k{i % 400}", s))
    assert {r.key: r.id for r in index.collect()} == {k: i for i, k in enumerate(sorted(first, key=lambda k: (first[k], k)))}
    plan = index._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    hot = index.select("id", positions.one_hot(F.col("id"), 3).alias("h")).collect()
    assert all(r.h == [int(r.id == i) for i in range(3)] for r in hot)
    assert positions.dense_index(rows.limit(0), "key", "seq").collect() == []
