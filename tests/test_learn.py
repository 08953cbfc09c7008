"""Metrics, contracts, tokens, ranking and plan checks."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from treecorpus.operators import contracts, encoder, judge, metrics, ranking, rl, tokens

SF = "/root/testdata/sf0.001"


def brute_span(ids, target, ends):
    width, mask = max(map(len, ends)), [0] * len(ids)
    for i in range(len(ids) - len(target) + 1):
        if ids[i:i + len(target)] == target:
            for j in range(i + len(target), len(ids)):
                window = ids[j:j + width]
                if any(window[-len(e):] == e for e in ends):
                    for k in range(i, min(j + width, len(ids))):
                        mask[k] = 1
                    break
    return mask


def brute_section(ids, target, start, end):
    mask = [0] * len(ids)
    for i in range(len(ids) - len(target) + 1):
        if ids[i:i + len(target)] == target:
            depth = 1
            for j in range(i + len(start), len(ids)):
                depth += (ids[j:j + len(start)] == start) - (ids[j:j + len(end)] == end)
                if depth == 0:
                    for k in range(i, j + len(end)):
                        mask[k] = 1
                    break
    return mask


def test_masks_against_brute_force():
    for seed in range(200):
        ids = random.Random(seed).choices([0, 1, 2, 3], k=random.Random(seed).randrange(0, 40))
        assert tokens.span_mask(ids, [1, 2], [[3]], False) == brute_span(ids, [1, 2], [[3]])
        assert tokens.span_mask(ids, [1], [[3, 0], [2, 2]], False) == brute_span(ids, [1], [[3, 0], [2, 2]])
        assert tokens.span_mask(ids, [1, 2], [[2, 3]], False) == brute_span(ids, [1, 2], [[2, 3]])
        assert tokens.span_mask(ids, [1, 2], [[2, 3], [3], [0, 0, 1]], False) == brute_span(ids, [1, 2], [[2, 3], [3], [0, 0, 1]])
        assert tokens.section_mask(ids, [1], [1], [2], False) == brute_section(ids, [1], [1], [2])
    assert tokens.span_mask([5, 6], [1], [[3]], True) == [1, 1]
    assert tokens.span_mask([1, 2, 3], [1, 2], [[2, 3]], False) == [0, 0, 0]


def test_chunks_cover_the_input(spark):
    frame = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 5, 8, 9, 20, 21)], "n int, input_ids array<int>")
    for row in tokens.chunk_tokens(frame, 8, 3, pad=-1).groupBy("n").agg(
            F.sort_array(F.collect_list(F.struct("chunk", "input_ids"))).alias("c")).collect():
        parts = [list(c["input_ids"]) for c in row["c"]]
        assert set(range(row["n"])) <= {i for p in parts for i in p}
        if row["n"] <= 8:
            assert parts == [list(range(row["n"]))]
        else:
            assert all(len(p) == 8 for p in parts) and not any(-1 in p for p in parts[:-1])


def test_packing(spark):
    frame = spark.createDataFrame(
        [(1, list(range(10)), [90, 91]), (2, [1], list(range(50, 70))), (3, [], [7]), (4, [1], [])],
        "k int, prompt_ids array<int>, completion_ids array<int>")
    out = {r["k"]: r for r in tokens.pack_prompt_completion(frame, 6).collect()}
    assert out[1]["input_ids"] == [6, 7, 8, 9, 90, 91] and out[1]["labels"] == [-100] * 4 + [90, 91]
    assert out[2]["input_ids"] == [1, 50, 51, 52, 53, 54]
    assert out[3]["attention_mask"] == [1, 0, 0, 0, 0, 0]
    assert out[4]["error"] and not out[1]["error"]
    with pytest.raises(ValueError):
        tokens.pack_prompt_completion(frame, 1)


def brute_top(states, candidates, k):
    def vector(text):
        import hashlib
        v = np.zeros(ranking.DIM)
        padded = f" {text.lower()} "
        for i in range(len(padded) - 2):
            v[int(hashlib.md5(padded[i:i + 3].encode()).hexdigest()[:8], 16) % ranking.DIM] += 1
        n = np.linalg.norm(v)
        return v / n if n else v

    out = set()
    cand = [(h, u, key, vector(t)) for h, u, key, t in candidates]
    for host, url, text in states:
        mine = vector(text)
        scored = sorted((-round(float(mine @ v), 9), key, u) for h, u, key, v in cand if h == host and u != url)
        out |= {(host, url, u, place + 1) for place, (_, _, u) in enumerate(scored[:k])}
    return out


def test_top_k_in_blocks_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "sys", "chassis"]
    states = [("hot" if i % 3 else f"h{i % 4}", f"/u/{i:03}", " ".join(rng.choices(words, k=3))) for i in range(150)]
    candidates = [(h, u, u, t) for h, u, t in states]
    left = spark.createDataFrame(states, "host string, url string, text string")
    right = spark.createDataFrame(candidates, "host string, url string, key string, text string")
    want = brute_top(states, candidates, 4)
    for block in (2048, 13):  # one block per host; the hot host in several blocks
        got = ranking.top_k(left, right, 4, block=block)
        assert {tuple(r) for r in got.select("host", "url", "candidate_url", "place").collect()} == want


def test_best_candidate_of_own_host(spark):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(30, 8)), rng.normal(size=(70, 8))
    queries = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(q)], "query_id long, host int, query array<double>")
    keys = spark.createDataFrame([(i, i % 4, v.tolist(), i % 5 != 0) for i, v in enumerate(c)],
                                 "candidate_id long, host int, key array<double>, legal boolean")
    at = np.arange(70)
    got = rows(ranking.best_candidate(queries, keys, k=2, own=["host"]).select("query_id", "candidate_id"))
    want = []
    for i in range(30):
        scores = np.where((at % 5 != 0) & (at % 4 == i % 3), q[i] @ c.T, -np.inf)
        want += [(i, int(j)) for j in np.argsort(-scores)[:2]]
    assert got == sorted(want, key=repr)


def test_best_candidate_by_blocks(spark):
    """Blocks of a few rows, an owner with most rows, ties, no legal candidate, and a query that is a candidate itself."""
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(90, 4)), 1)
    owner = [0 if i < 60 else 1 + i % 4 for i in range(90)]
    legal = [i % 7 not in (0, 3) and owner[i] != 2 for i in range(90)]
    queries = spark.createDataFrame([(i, owner[i], v[i].tolist()) for i in range(90)], "query_id long, host int, query array<double>")
    keys = spark.createDataFrame([(i, owner[i], v[i].tolist(), legal[i]) for i in range(90)], "candidate_id long, host int, key array<double>, legal boolean")
    want = []
    for i in range(90):
        scored = sorted((-round(float(v[i] @ v[j]), 9), j) for j in range(90) if owner[j] == owner[i] and legal[j] and j != i)
        want += [(i, j, place) for place, (_, j) in enumerate(scored[:3], 1)]
    for block in (1024, 7):
        got = ranking.best_candidate(queries, keys, k=3, own=["host"], others_only=True, block=block)
        assert sorted(tuple(r) for r in got.select("query_id", "candidate_id", "place").collect()) == sorted(want)


def test_acceptance_of_every_artifact(spark):
    observed = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 3.0), ("b", "x", float("nan"))], "artifact string, metric string, value double")
    limits = spark.createDataFrame([("low", "m", "<=", 2.0), ("there", "x", ">=", 0.0), ("free", "m", ">=", None)],
                                   "check_name string, metric string, operator string, threshold double")
    checks = metrics.acceptance_checks(observed, limits, by=["artifact"])
    assert {(r.artifact, r.check_name): r.passed for r in checks.collect()} == {
        ("a", "low"): True, ("a", "there"): False, ("b", "low"): False, ("b", "there"): False}
    assert {r.artifact: (r.n_checks, r.n_failed, r.status) for r in metrics.acceptance_status(checks, by=["artifact"]).collect()} == {
        "a": (2, 1, "fail"), "b": (2, 2, "fail")}


def test_td_and_relabel_edges(spark):
    frame = spark.createDataFrame(
        [(1, 1.0, 0, 2.0, True), (1, 1.0, 0, 9.0, False), (2, 1.0, 1, 5.0, True), (3, 0.5, 0, 5.0, False)],
        "k int, reward double, done int, q double, legal boolean")
    assert rows(rl.td_target(frame, ["k"], 0.5)) == [(1, 2.0), (2, 1.0), (3, 0.5)]
    steps = spark.createDataFrame([("e", i, f"s{i}") for i in range(6)], "ep string, step long, next_state string")
    out = rl.her_relabel(steps, "ep", 5, 3)
    assert out.count() == 30 and out.filter("at < step or at > 5").count() == 0
    assert out.filter("step = 5 and reward <> 1").count() == 0
    assert rl.her_relabel(steps, "ep", 0, 3).count() == 0


def test_calibration_bins(spark):
    frame = spark.createDataFrame([("a", 1.0, True), ("a", 0.95, False), ("a", 0.1, None), ("b", None, True)],
                                  "artifact string, confidence double, exact_match boolean")
    assert math.isclose(metrics.calibration_error(frame).head()["ece"], abs(0.5 - 0.975))
    with pytest.raises(ValueError):
        metrics.calibration_error(frame, bins=0)


def test_present_null_wins(spark):
    lines = [{"prediction": None, "completion": '{"a": 1}', "target": {"a": 1}}, {"completion": '{"a": 1.0}', "target": {"a": 1}},
             {"output": 5, "uri": "/x", "id": 7}, {"output": '{"@odata.id": "/x"}', "uri": "/x", "latency_sec": "0.5", "confidence": 3}]
    frame = spark.createDataFrame([("a", i + 1, json.dumps(v)) for i, v in enumerate(lines)],
                                  "artifact string, line_number long, line string")
    out = metrics.normalize_predictions(frame).orderBy("line_number").collect()
    assert [r["parse"] for r in out] == ["missing prediction", "parsed", "unsupported prediction type", "parsed"]
    assert [r["exact_match"] for r in out] == [False, True, None, None]
    assert [r["id_match"] for r in out] == [None, None, False, True]
    assert out[2]["row_key"] == "id:7" and out[1]["row_key"].startswith("position:1:identity:")
    assert out[3]["latency_sec"] == 0.5 and out[3]["confidence"] == 1.0


def test_call_errors(spark):
    call = {"rest_api": "/a", "allowed_methods": ["get", "PATCH"], "method": "get", "arguments": {}}
    texts = {
        json.dumps({"calls": [call]}): None, "x": "invalid_json", "[]": "y_pred must be an object",
        json.dumps({"y_pred": {"calls": [1]}}): "each y_pred.calls item must be an object",
        json.dumps({"calls": [{**call, "arguments": {"a": 1}}]}): "read-only y_pred.calls.arguments must be empty",
        json.dumps({"calls": [{**call, "method": "PUT"}]}): "y_pred.calls.method PUT is not in allowed_methods for /a",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = frame.select("raw", contracts.parse_calls(F.col("raw")).alias("p")).select("raw", "p.error").collect()
    assert dict((r["raw"], r["error"]) for r in got) == texts


def test_call_errors_in_order(spark):
    """Each failure has its wording, and of several the first counts."""
    call = {"rest_api": "/a", "allowed_methods": ["get", "PATCH"], "method": "patch", "arguments": {"b": [1, {"z": 1, "a": 2.5}], "a": None}}
    wrong = lambda **change: json.dumps({"calls": [call, {**call, **change}]})
    without = lambda *names: json.dumps({"y_pred": {"calls": [{k: v for k, v in call.items() if k not in names}, 3]}})
    texts = {
        None: "invalid_json", "": "invalid_json", "3": "y_pred must be an object", "null": "y_pred must be an object",
        '{"y_pred": null}': "y_pred.y_pred must be an object", '{"y_pred": [1]}': "y_pred.y_pred must be an object",
        '{"calls": null}': "y_pred.calls must be a list", "{}": "y_pred.calls must be a list",
        '{"calls": [], "y_pred": {}}': "y_pred.calls must be a list", '{"calls": []}': None, wrong(): None,
        '{"calls": [null]}': "each y_pred.calls item must be an object",
        without("method", "rest_api"): "y_pred.calls item missing required field(s): ['rest_api', 'method']",
        wrong(rest_api=1): "y_pred.calls.rest_api must be a string", wrong(rest_api=None, method=2): "y_pred.calls.rest_api must be a string",
        wrong(allowed_methods="GET"): "y_pred.calls.allowed_methods must be a list",
        wrong(allowed_methods=["GET", 1], method=3): "each y_pred.calls.allowed_methods item must be a string",
        wrong(method=None): "y_pred.calls.method must be a string", wrong(allowed_methods=[]): "y_pred.calls.method PATCH is not in allowed_methods for /a",
        wrong(method="put", arguments=1): "y_pred.calls.method PUT is not in allowed_methods for /a",
        wrong(arguments=[]): "y_pred.calls.arguments must be an object", wrong(arguments=None): "y_pred.calls.arguments must be an object",
        wrong(method="Get"): "read-only y_pred.calls.arguments must be empty", wrong(method="GET", arguments={}): None,
    }
    frame = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("p", contracts.parse_calls(F.col("raw")))
    got = {r.raw: r.p for r in frame.collect()}
    assert {t: p.error for t, p in got.items()} == texts
    assert all((p.calls is None) == (p.error is not None) for p in got.values())
    first = got[wrong()].calls[0]
    assert (first.rest_api, first.allowed_methods, first.method) == ("/a", ["GET", "PATCH"], "PATCH")
    assert first.arguments == json.dumps(call["arguments"], sort_keys=True, separators=(",", ":"))
    lists = {'{"rest_api_list": ["/a", "/b"]}': None, '{"rest_api_list": []}': None, '{"rest_api_list": ["/a", 1]}': "each y_pred.rest_api_list item must be a string",
             '{"y_pred": {"rest_api_list": {}}}': "y_pred.rest_api_list must be a list", "x": "invalid_json"}
    rows = spark.createDataFrame([(t,) for t in lists], "raw string").withColumn("p", contracts.parse_list(F.col("raw"))).collect()
    assert {r.raw: r.p.error for r in rows} == lists and [r.p.rest_api_list for r in rows] == [["/a", "/b"], [], None, None, None]


def test_both_empty_calls_agree(spark):
    expected = spark.createDataFrame([], "row_id long, pos int, rest_api string, allowed_methods array<string>, method string, arguments string")
    predicted = spark.createDataFrame([(1, '{"calls": []}')], "row_id long, raw string")
    row = contracts.evaluate_calls(expected, predicted).head()
    assert all(row[c] == 1.0 for c in contracts.RATES if c != "invalid_method_rate") and row["invalid_method_rate"] == 0.0


def test_judge_never_raises(spark):
    texts = ['{"rest_api_list": ["/a"], "accepted": true, "nonsense": false}', "", "null", '"x"', '{"y_pred": 3}',
             '{"rest_api_list": ["/a"], "accepted": 1, "nonsense": false}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    out = judge.parse_judge(frame).orderBy("i").collect()
    assert [r["invalid_json"] for r in out] == [False, True, True, True, True, True]
    assert out[0]["rest_api_list"] == ["/a"] and out[5]["reason"] == "accepted must be a boolean"


@pytest.mark.parametrize("name", ["d1_containment_parent", "d4_neighbors", "j14_build_surfaces", "g4_sample_contexts",
                                  "d10_her_future_relabel", "e1_mix_manifest", "f1_dedup_by_trust", "e12_top_k_hit_rate"])
def test_plans(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_windows_are_cut_before_the_shuffle(spark):
    plan = entry.queries()["f7_replay_last_n"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_exact_percentiles(spark):
    from treecorpus.operators.percentiles import exact_percentiles

    rng = random.Random(3)
    groups = {"hot": [rng.gauss(0, 1) ** 9 for _ in range(2000)], "ties": [1.0] * 50 + [2.0] * 3, "one": [7.0],
              "two": [1.0, 4.0], "wide": [1e-9, 1e9, 3.0, -1e12]}
    data = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    frame = spark.createDataFrame(data, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: [r[n] for n in shares] for r in exact_percentiles(frame, "k", "v", shares).collect()}
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        assert np.allclose(got[key], np.percentile(values, [0, 50, 95, 100]), rtol=1e-12)


def test_hit_rate_tells_hosts_apart(spark):
    """Two hosts that share a URL are two states."""
    states = spark.createDataFrame([("h1", "/a"), ("h2", "/a"), ("h2", "/b"), ("h3", "/c")], "host string, url string")
    truths = spark.createDataFrame([("h1", "/a", "/x"), ("h2", "/a", "/y"), ("h2", "/b", "/z"), ("h9", "/c", "/x")], "host string, url string, truth string")
    ranked = spark.createDataFrame([("h1", "/a", "/x", 1), ("h2", "/a", "/x", 1), ("h2", "/b", "/z", 3)], "host string, url string, candidate_url string, place int")
    assert tuple(ranking.hit_rate(ranked, truths, states, 2).head()) == (3, 1, 1 / 3, 2)
    assert tuple(ranking.hit_rate(ranked, truths, states, 3).head())[:2] == (3, 2)


def test_encoder_keeps_what_it_knows(spark, tmp_path):
    """Equal texts are encoded once, a second run encodes nothing, a changed row finds a new entry and the others keep theirs."""
    folder = str(tmp_path / "vectors")
    make = lambda: lambda texts: np.array([[len(t), t.count("a")] for t in texts], float)
    rows = [(i, t) for i, t in enumerate(["a", "bb", "a", "", None, "caa"])]
    frame = spark.createDataFrame(rows, "id int, said string")
    want = {0: [1.0, 1.0], 1: [2.0, 0.0], 2: [1.0, 1.0], 3: [0.0, 0.0], 4: None, 5: [3.0, 2.0]}
    for made in (4, 0):
        out, n = encoder.encoded(frame, "said", folder, make)
        assert n == made and {r.id: r.vector for r in out.collect()} == want
    changed = spark.createDataFrame([(0, "aaaa"), *rows[1:]], "id int, said string")
    out, n = encoder.encoded(changed, "said", folder, make)
    assert n == 1 and {r.id: r.vector for r in out.collect()} == {**want, 0: [4.0, 4.0]}
    assert sorted((r.version, r["count"]) for r in encoder.known_vectors(spark, folder).groupBy("version").count().collect()) == [(1, 4), (2, 1)]
