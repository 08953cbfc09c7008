"""Suffix-array dedup against a dictionary of all windows."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from llm_docs import make_docs
from treecorpus.llm import repeats, suffix_dedup
from treecorpus.llm.common import NO_ID


def plain(docs, length=100):
    """{(doc, text): (n_bytes, n_removed, n_spans, kept)} for distinct (doc, text) in order."""
    seen, out = set(), {}
    for doc, text in docs:
        data = text.encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = [True] * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc, text] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return out


def awkward_docs():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(40)
    texts = [None, "", "short", "a" * 700, "ab" * 400, prose(200)]
    texts += [prose(rnd.randint(1, 40)) + passage[rnd.randint(0, 30):rnd.randint(120, 300)] + prose(rnd.randint(1, 40)) for _ in range(60)]
    texts += [other + other, other + "x" + other, passage * 3, texts[5], texts[5][:-1], texts[5][1:], texts[5].replace("a", "b", 3)]
    texts += [texts[8], "x" * 100, "x" * 99, "é" * 50, "é" * 51]
    return texts


@pytest.mark.parametrize("group", [16_384, 8])
def test_every_byte_against_all_windows(spark, group):
    texts = awkward_docs()
    ids = [None, *range(len(texts) - 1)]
    ids[7] = 100  # out of order
    docs = make_docs(spark, [*texts, texts[20]], [*ids, ids[20]]).selectExpr("*", "1 as gram", "'x' as digest").repartition(4)
    got = sorted((r.doc, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, group).collect())
    ordered = sorted((NO_ID if i is None else i, t or "") for i, t in zip(ids, texts))
    want = [(doc, *x) for (doc, _), x in plain(ordered).items()]
    want.append(next(w for w in want if w[0] == ids[20]))
    assert got == sorted(want)
    assert sum(w[2] for w in want) > 5000


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 600)
    rnd = random.Random(1)
    part = "".join(rnd.choice("abcd ") for _ in range(900))
    texts = [part + "".join(rnd.choice("xyz ") for _ in range(3000)) + part, part[:500], "".join(rnd.choice("ab") for _ in range(5000))]
    got = sorted((r.doc, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(make_docs(spark, texts)).collect())
    assert got == sorted((d, *x) for (d, _), x in plain(list(enumerate(texts))).items())


def test_empty(spark):
    assert suffix_dedup.remove_repeats(make_docs(spark, [])).collect() == []
    assert suffix_dedup.remove_repeats(make_docs(spark, ["", None, "x"])).count() == 3


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0", max_size=5), st.text("ab\0", max_size=6)), min_size=2, max_size=9), st.integers(1, 6))
def test_maximal_repeats_have_all_occurrences(places, least):
    before, after = [a.encode() for a, _ in places], [b.encode() for _, b in places]
    groups = {(x, y, tuple(sorted(g))) for x, y, g in repeats.maximal_repeats(before, after, least)}
    want = set()
    for i in range(len(places)):
        for j in range(i):
            x, y = common(before[i], before[j]), common(after[i], after[j])
            if x + y >= least:
                all_of = tuple(k for k in range(len(places)) if before[k][:x] == before[i][:x] and len(before[k]) >= x
                               and after[k][:y] == after[i][:y] and len(after[k]) >= y)
                want.add((x, y, all_of))
    # Each pair's longest repeat is a group, or one with the same places that reaches further.
    for x, y, g in want:
        assert any(set(h) >= set(g) and a >= x and b >= y or (a, b, h) == (x, y, g) for a, b, h in groups)
    for x, y, g in groups:
        assert len({before[k][:x] for k in g}) == 1 and len({after[k][:y] for k in g}) == 1
        assert len(before[g[0]]) >= x and len(after[g[0]]) >= y
    spans = repeats.covered_by_earlier(before, after, least)
    for i in range(len(places)):
        pairs = [(common(before[i], before[j]), common(after[i], after[j])) for j in range(i)]
        pairs = [p for p in pairs if sum(p) >= least]
        assert spans.get(i) == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else None)
