"""SimHash against a brute-force comparison of all pairs."""

import random

import xxhash
from hypothesis import given, settings, strategies as st
import numpy as np

from llm_docs import make_docs
from treecorpus.llm import components, simhash
from treecorpus.llm.common import BROADCAST, cut, small_broadcasts


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def near_texts():
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(60, 500))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rnd.randint(0, 2)):
                c[rnd.randrange(len(c))] = "Otherİ"
            texts.append("\n".join(c).upper())
    return texts + [None, "", " \t", "one", "One two", "x " * 5000, "x " * 5000, "  \x85y"]


def test_components_against_brute_force(spark):
    texts = near_texts()
    ids = [None, *range(len(texts) - 2), 3]
    got = {}
    docs = make_docs(spark, texts, ids).selectExpr("*", "1 as print", "2 as component").repartition(3)
    rows = simhash.report(docs).collect()
    assert len(rows) == len(texts)
    prints = [plain_fingerprint(t) for t in texts]
    found = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in zip(ids, prints):
        least[found[p]] = min(least.get(found[p], 2**63), 2**63 - 1 if i is None else i)
    want = sorted(((i if i is not None else -1), f"{p:016x}", least[found[p]]) for i, p in zip(ids, prints))
    got = sorted(((r[0] if r[0] is not None else -1), r[1], 2**63 - 1 if r[2] is None else r[2]) for r in rows)
    assert got == want
    assert len(set(found.values())) < len(found)  # some fingerprints do link


def test_blocks_of_a_hot_segment(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rnd = random.Random(2)
    prints = sorted({rnd.getrandbits(6) << 40 | 12345 for _ in range(40)} | {rnd.getrandbits(63) for _ in range(40)})
    found = components.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "print long"), 3))
    got = {r.node: r.root for r in found.collect()}
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {p: got.get(p, p) for p in prints} == want


def test_every_distance_finds_its_links():
    for distance in range(0, 9):
        cuts = simhash.segments(distance)
        assert sum(b for _, b in cuts) == 64 and len(cuts) * 2 > distance


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 300)], "src long, dst long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 2**49 - 1))
def test_spanning_edges_join_what_links_join(rows, columns, bits):
    links = np.array([bits >> i & 1 for i in range(rows * columns)], bool).reshape(rows, columns)
    a, b = components.spanning(links)
    pairs = {(int(i), rows + int(j)) for i, j in zip(*np.nonzero(links))}
    edges = {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b)}
    nodes = list(range(rows + columns))
    assert plain_components(nodes, lambda x, y: (x, y) in pairs) == plain_components(nodes, lambda x, y: (x, y) in edges)


def test_one_of_each_group_stays(spark):
    docs = make_docs(spark, ["a b c d", "a b c d", "", None, "q r s t u"], [4, 2, 9, None, 5])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [2, 5, 9]
    assert simhash.report(make_docs(spark, [])).collect() == []


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """A table of some kilobytes has 64 times the rows after the explode; Spark, which sizes it without them, must not broadcast it."""
    plans, key = {}, "spark.sql.autoBroadcastJoinThreshold"

    def recorded(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return cut(frame, name)

    monkeypatch.setattr(simhash, "cut", recorded)
    before = spark.conf.get(key)
    spark.conf.set(key, "10m")
    try:
        prints = spark.createDataFrame([(random.Random(5).getrandbits(63) ^ 1 << i,) for i in range(40)], "print long")
        assert simhash.links(prints, 3).count() > 0
        assert "BroadcastHashJoin" not in plans["segment-pairs"] and "SortMergeJoin" in plans["segment-pairs"]
        assert int(spark.conf.get(key)) == BROADCAST
        spark.conf.set(key, "1000")
        small_broadcasts(spark)
        assert spark.conf.get(key) == "1000"  # a lower limit stays
    finally:
        spark.conf.set(key, before)
