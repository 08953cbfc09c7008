"""The small-world graph against all products."""

import math

import numpy as np
import pytest

from treecorpus.llm import small_world
from treecorpus.llm.small_world import Graph, inner, lifted

SCHEMA = "vec_id long, embedding array<float>, label int"


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, queries, k):
    """[(query, rank, id, score)] by brute force."""
    there = {(2**63 - 1 if i is None else i, tuple(v)) for i, v in rows if good(v)}
    out = []
    for i, v in queries:
        if good(v):
            scored = []
            for j, w in there:
                if j != i:
                    score = 0.0
                    for x, y in zip(v, w):
                        score += x * y
                    scored.append((-score, j))
            out += [(i, rank, None if j == 2**63 - 1 else j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def result(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect())


def clustered(seed, n, dims, lengths=True):
    """A dense group, copies, and vectors of very different lengths."""
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, dims))
    rows[: n // 3] = rng.standard_normal(dims) + 0.05 * rows[: n // 3]
    if lengths:
        rows *= np.exp(rng.standard_normal(n))[:, None]
    rows[n // 2: n // 2 + 40] = rows[0]
    return [(int(i), np.float32(v).tolist()) for i, v in enumerate(rows)]


def test_small_table_is_exact(spark):
    rows = clustered(1, 300, 12)
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None], [float("inf")] + [1.0] * 11, [7.0, 8.0], [float(np.float32(3e38))] * 12]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [rows[5], rows[6], (None, rows[0][1])]
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as id", "2 as shard", "'x' as vec").repartition(4)
    asked = [(i, v) for i, v in rows if i is not None and (i % 20 == 0 or i > 999)]
    got = result(small_world.nearest(docs, docs.filter("vec_id % 20 = 0 or vec_id > 999"), 20))
    want = plain(rows, [x for x in asked], 20)
    assert got == want
    assert {r[0] for r in got} & set(range(1000, 1006)) == set()


@pytest.mark.parametrize("shard", [8192, 600])
def test_recall(spark, monkeypatch, shard):
    monkeypatch.setattr(small_world, "SHARD", shard)
    rows = clustered(2, 3000, 24)
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got = result(small_world.nearest(docs, docs.filter("vec_id % 50 = 0"), 20))
    want = plain(rows, [r for r in rows if r[0] % 50 == 0], 20)
    assert len(got) == len(want) and len({r[:2] for r in got}) == len(got)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.97 * len(want)
    exact = {(q, v): s for q, _, v, s in plain(rows, [r for r in rows if r[0] % 50 == 0], 3000)}
    assert all(exact[q, v] == s for q, _, v, s in got)


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert result(small_world.nearest(docs, docs.filter("vec_id = 0"), 20)) == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    one = docs.filter("vec_id = 0")
    assert result(small_world.nearest(one, one)) == []


def test_doubles_that_overflow(spark):
    rows = [(0, [1e306, 1.0]), (1, [1e306, -1.0]), (2, [-1e306, 0.0]), (3, [1e-300, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(small_world.nearest(docs, docs))
    assert got == plain(rows, rows, 20) and (0, 1, 1, math.inf) in got


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert small_world.nearest(none, none).collect() == []
    some = spark.createDataFrame([(0, None, 1), (20, [0.0], 1)], SCHEMA)
    assert small_world.nearest(some, some).collect() == []


def test_layers():
    """Every layer's lists hold nodes of the layer, none twice and none the node itself; flat arrays come back as they were."""
    rng = np.random.default_rng(3)
    vectors = lifted(rng.standard_normal((1500, 8)) * rng.random((1500, 1)))
    levels = np.sort(np.floor(-np.log(rng.random(1500)) / np.log(4)).astype(int))[::-1]
    graph = Graph.build(vectors, levels)
    assert list(graph.sizes) == [(levels >= x).sum() for x in range(levels.max() + 1)] and len(graph.sizes) > 3
    again = Graph.unpacked(vectors, graph.sizes, graph.packed())
    for n, links, same in zip(graph.sizes, graph.links, again.links):
        assert (links == same).all() and links.shape[0] == n and links.max(initial=-1) < n
        for node, own in enumerate(links):
            own = own[own >= 0]
            assert node not in own and len(set(own)) == len(own) and (len(own) or n == 1)


def test_lifted_keeps_the_order_of_products():
    rng = np.random.default_rng(4)
    vectors, query = rng.standard_normal((200, 6)) * np.exp(rng.standard_normal((200, 1))), rng.standard_normal(6)
    products = lifted(vectors).astype(float) @ np.r_[query, 0]
    assert np.allclose(np.linalg.norm(lifted(vectors), axis=1), 1, atol=1e-5)
    exact = inner(np.tile(query, (200, 1)), vectors)
    assert np.allclose(products / products.max(), exact / exact.max(), atol=1e-4)


def test_shards_stay_and_queries_come_in_turns(spark, monkeypatch):
    """However many queries are broadcast at a time and shards are in a task, the result is the same."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(900, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    queries = frame.filter("vec_id % 30 = 0")
    monkeypatch.setattr(small_world, "SHARD", 128)
    monkeypatch.setattr(small_world, "FIRST", 32)
    want = sorted(map(tuple, small_world.nearest(frame, queries, 5).collect()))
    assert len(want) == 150
    written = []
    monkeypatch.setattr(small_world, "cut", lambda frame, name, whole=small_world.cut: written.append(name) or whole(frame, name))
    monkeypatch.setattr(small_world, "QUERIES", 4)
    monkeypatch.setattr(small_world, "ASKED", 1)
    monkeypatch.setattr(small_world, "MOST", 2)
    assert sorted(map(tuple, small_world.nearest(frame, queries, 5).collect())) == want
    assert written.count("found") > 1
