"""Near copies by shingles against all pairs."""

import random

import corpus_pipeline
import numpy as np
from llm_docs import DOCS, make_docs
from test_simhash import plain_components
from treecorpus.llm import shingles


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    """Chains of copies with swapped, inserted and dropped words, passages in many texts, and short texts."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    passage = [rnd.choice(words) for _ in range(40)]
    texts = []
    for i in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice((20, 90, 300)))]
        base = base + passage if i % 3 == 0 else base
        for k in range(6):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(max(1, round(len(base) * rnd.choice((0.005, 0.02, 0.03, 0.05))))):
                at = rnd.randrange(len(base))
                rnd.choice((lambda: base.__setitem__(at, rnd.choice(words)), lambda: base.insert(at, rnd.choice(words)), lambda: base.pop(at)))()
    hub = [rnd.choice(words) for _ in range(200)]
    for _ in range(40):
        copy = list(hub)
        for at in rnd.sample(range(200), 5):
            copy[at] = rnd.choice(words)
        texts.append(" ".join(copy))
    texts += ["", None, " \n", "one two", "ONE  two", "one two three", texts[0].upper(), texts[0]]
    rnd.shuffle(texts)
    return [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[5], None, None, None)]


def wanted(rows):
    sets = [plain_shingles(r[1]) for r in rows]
    places = {s: i for i, s in enumerate(sets)}
    names = list(places.values())
    root = plain_components(names, lambda a, b: plain_linked(sets[a], sets[b]))
    key = lambda i: 2**63 - 1 if i is None else i
    least = {}
    for r, s in zip(rows, sets):
        least[root[places[s]]] = min(least.get(root[places[s]], 2**63), key(r[0]))
    return [(key(r[0]), least[root[places[s]]]) for r, s in zip(rows, sets)]


def test_all_pairs(spark, monkeypatch):
    rows = corpus()
    want = sorted(wanted(rows))
    assert 40 < len({c for _, c in want}) < len(rows) - 100
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    get = lambda: sorted((r.doc, r.component) for r in shingles.near_duplicates(docs).collect())
    assert get() == want
    # Blocks of few nodes, and no shingle known to be common.
    monkeypatch.setattr(shingles, "BLOCK", 3)
    monkeypatch.setattr(shingles, "AT_ONCE", 5)
    monkeypatch.setattr(shingles, "WORDS", 7)
    monkeypatch.setattr(shingles, "FULL", 500)
    monkeypatch.setattr(shingles, "COMMON", 0)
    assert get() == want


def test_stage(spark):
    """The stage of the pipeline drops copies with swapped words."""
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in kept) == sorted(i for i, c in wanted(rows) if i == c)


def test_prefixes_and_parity():
    """Every linked pair shares a shingle of its prefixes and passes the fingerprints."""
    sets = [shingles.shingles((r[1] or "").encode()) for r in corpus()]
    common = np.unique(np.concatenate(sets))[::3]
    ranks = np.arange(len(common)) % 7 + 1
    seen = 0
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(np.intersect1d(a, b))
            if both and 5 * both >= 4 * (len(a) + len(b) - both):
                seen += 1
                assert len(np.intersect1d(shingles.prefix(a, common, ranks), shingles.prefix(b, common, ranks)))
                for bits in (shingles.BITS, shingles.WIDE):
                    x, y = (np.frombuffer(shingles.parity(s, bits), np.uint64) for s in (a, b))
                    assert shingles._may_link(int(np.bitwise_count(x ^ y).sum()), len(a), len(b))
    assert seen > 50


def test_empty(spark):
    assert shingles.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def template(n):
    """Texts of one template with a few words changed: most pairs are just under or over the least similarity."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rnd.sample(range(200), rnd.randint(1, 4)):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "src", 0))
    return rows


def test_a_cluster_gives_edges_not_pairs(spark, monkeypatch):
    """What the comparison of lists hands on grows with the texts, not with their pairs."""
    made = {}
    across, spanned = shingles._across, shingles._spanned
    seen = lambda name, frame: made.setdefault(name, []).append(frame.count()) or frame
    monkeypatch.setattr(shingles, "_across", lambda *a: seen("asked", across(*a)))
    monkeypatch.setattr(shingles, "_spanned", lambda *a: seen("edges", spanned(*a)))
    for n in (100, 200):
        rows = template(n)
        got = sorted((r.doc, r.component) for r in shingles.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
        assert got == sorted(wanted(rows))
    assert made["edges"][1] <= 3 * made["edges"][0] + 50 and made["asked"][1] <= 3 * made["asked"][0] + 100, made


def test_simhashes_make_candidates(spark, monkeypatch):
    """Nodes whose SimHashes differ in three or fewer bits are brought together, and the links come by way of them."""
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    nodes = shingles._rows(docs, 5, "doc_id", "text").dropDuplicates(["node"])
    prints = {r.node: r.print % 2**64 for r in nodes.select("node", "print").collect()}
    for text in (rows[0][1], "a b c d e f g", ""):
        found = shingles.shingles((text or "").encode())
        votes = [sum(int(h) >> bit & 1 for h in found) for bit in range(64)]
        assert shingles.simhash(found) % 2**64 == sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(found))
    edges = [(r.a, r.b) for r in shingles._alike(nodes).collect()]
    close = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= shingles.DISTANCE
    want = plain_components(list(prints), close)
    given = set(edges) | {(b, a) for a, b in edges}
    assert plain_components(list(prints), lambda a, b: (a, b) in given) == want and len(set(want.values())) < len(prints)
    used, real = [], shingles._alike
    monkeypatch.setattr(shingles, "_alike", lambda frame: used.append(real(frame)) or used[-1])
    assert sorted((r.doc, r.component) for r in shingles.near_duplicates(docs).collect()) == sorted(wanted(rows)) and len(used) == 1


def test_wide_fingerprints_lose_no_link():
    rng = np.random.default_rng(3)
    found = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    wide = shingles.wide_parity(found)
    assert len(wide) * 8 == 16384 and shingles.wide_parity(found[:1000]) is None and shingles.wide_parity(found[:0]) is None
    for bits in (2048, 8192):
        assert shingles.folded(np.frombuffer(wide, np.uint64)[None, :], bits // 64)[0].tobytes() == shingles.parity(found, bits)
    for n in (1, 9, 900, 1000, 1100, 4000):  # of sets of every width some link, and are kept
        a = found[:n]
        b = np.unique(np.r_[a[: n - n // 12], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        prints = [shingles.wide_parity(x) or shingles.parity(x) for x in (a, b)]
        assert shingles._links_possible(np.array([1, 2]), np.array([len(a), len(b)]), prints).all()
        assert not shingles._links_possible(np.array([1, 1]), np.array([len(a), len(b)]), prints).any()


def test_long_texts_go_before_their_sets_travel(spark):
    """The short fingerprints let any two long texts pass; the sets of texts that cannot link must not meet."""
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 5000))) for _ in range(4)]
    texts.append(texts[0] + " and one word more")
    nodes = shingles._rows(make_docs(spark, texts), 5, "doc_id", "text")
    kept = {r.doc: r for r in nodes.collect()}
    short = [np.frombuffer(kept[d].parity, np.uint64) for d in (1, 2)]
    assert shingles._may_link(np.bitwise_count(short[0] ^ short[1]).sum(dtype=np.int64), kept[1].n, kept[2].n)
    asked = nodes.selectExpr("7L as key", "0L as i", "0L as j", "node", "node as component")
    left = {r.node for r in shingles._still_possible(asked, nodes).collect()}
    assert left == {kept[d].node for d in (min(kept), max(kept))}


def test_prefix_rows_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the table of nodes without the rows that its prefixes explode into."""
    plans, key, cut = {}, "spark.sql.autoBroadcastJoinThreshold", shingles.cut

    def recorded(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return cut(frame, name)

    monkeypatch.setattr(shingles, "cut", recorded)
    before = spark.conf.get(key)
    spark.conf.set(key, "10m")
    try:
        docs = make_docs(spark, ["a b c d e f g h i j", "b c d e f g h i j", "x y z"])
        assert {r.doc: r.component for r in shingles.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 2}
        assert "BroadcastHashJoin" not in plans["near-hits"] and "SortMergeJoin" in plans["near-hits"]
        assert int(spark.conf.get(key)) == 256 << 10
    finally:
        spark.conf.set(key, before)
