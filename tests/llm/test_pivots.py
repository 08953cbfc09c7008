"""The pivot index against all pairs."""

import numpy as np
import pytest

from treecorpus.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.95):
    """{position: (n_links, component)} by brute force; rows are (id, vector)."""
    width = max((len(v) for _, v in rows if v), default=0)
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array([*rows[i][1], *[0.0] * (width - len(rows[i][1]))], np.float32).astype(float) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: {j for j in good if j != i and unit[i] @ unit[j] >= least} for i in good}
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [2**63 - 1 if rows[j][0] is None else rows[j][0] for j in seen]
        out[i] = (rows[i][0], len(links.get(i, ())), min(ids))
    return sorted(out.values(), key=repr)


def clusters(seed, dims=24):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dims) for _ in range(200)]
    for size, spread in ((120, 0.02), (60, 0.04), (5, 0.03), (5, 0.05)):
        centre = rng.standard_normal(dims)
        rows += [centre + spread * np.linalg.norm(centre) / dims**0.5 * rng.standard_normal(dims) * 3 for _ in range(size)]
    rows += [rows[3]] * 7 + [rows[210]] * 4
    return [(int(i), np.float32(v).tolist()) for i, v in enumerate(rows)]


def result(frame):
    return sorted(((r.vec_id, r.n_links, 2**63 - 1 if r.component_id is None else r.component_id) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = clusters(1)
    rng = np.random.default_rng(9)
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [float("inf"), 1.0], [1.0], [2.0], [3e38] * 24]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), rows[5]]
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as node", "2 as first").repartition(3)
    got, want = result(pivots.near_vectors(docs)), plain(rows)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert there > 5000 and found >= 0.9 * there  # the recall the index must have
    assert got == want  # and on this fixture it misses nothing


def test_few_and_no_rows(spark):
    assert pivots.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(3, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    assert sorted(tuple(r) for r in pivots.near_vectors(one).collect()) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_pivots_are_apart():
    sample = np.random.default_rng(2).standard_normal((300, 3))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    chosen = pivots.choose_pivots(sample, 50)
    cosines = chosen @ chosen.T - 2 * np.eye(len(chosen))
    assert cosines.max() < pivots.APART
