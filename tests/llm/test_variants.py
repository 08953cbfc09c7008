"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_docs import make_docs

from treecorpus.llm import variants

WORDS = "word string, n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(docs, slip):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return out


def plain_groups(counts, least=6, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= least}
    form, degree = {}, {}
    for w in words:
        around = [x for x in words if near(w, x)]
        degree[w] = len(around)
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], degree[w], words.get(form[w])))
    return sorted(out)


def vocabulary(seed):
    """Clusters of words one and two edits apart, runs of one letter, words that share long heads and tails."""
    rnd = random.Random(seed)
    words = set()
    for _ in range(60):
        word = "".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 9)))
        words.add(word)
        for _ in range(6):
            at, letter = rnd.randrange(len(word) + 1), rnd.choice("abzÿ")
            other = rnd.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1:], word[:at] + letter + word[at + 1:]])
            words.add(other)
            word = rnd.choice([word, other])
    words |= {"a" * k for k in range(4, 30)} | {"stem" * 4 + x for x in ("", "a", "b", "ab", "ba")} | {x + "stem" * 4 for x in "abc"}
    return {w: 5 ** rnd.randint(0, 6) + rnd.randint(0, 3) for w in sorted(words)}


def result(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "AT_ONCE", 5 if block == 7 else 2048)
    counts = vocabulary(block)
    want = plain_groups(counts)
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] and r[1] for r in want)
    rows = [(w, n, 1, "x") for w, n in counts.items()]
    words = spark.createDataFrame(rows, WORDS + ", n_near long, root string").repartition(3)
    assert result(variants.group_variants(words)) == want


@pytest.mark.parametrize("least", [2, 5, 7])
def test_least_and_repeated_rows(spark, least):
    counts = vocabulary(3)
    rows = [(w, n - 1) for w, n in counts.items()] + [(w, 1) for w in counts] + [(None, 9)]
    assert result(variants.group_variants(spark.createDataFrame(rows, WORDS), least, 3)) == plain_groups(counts, least, 3)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 50)
    monkeypatch.setattr(variants, "LONG", 3000)
    rnd = random.Random(4)
    words = [w for w in vocabulary(5) if len(w) > 5]
    texts = [rnd.choice(" -.\n1×").join(rnd.choice([w, w, w.upper(), w.title()]) for w in rnd.choices(words[:90], k=rnd.randint(0, 60))) for _ in range(120)]
    texts += ["", None, "....", "Àÿ_ab×cd÷ef", " ".join(words * 20), texts[0], "a" * 50_000 + " " + "a" * 49_999]
    ids = [*range(len(texts) - 1), None]
    docs = make_docs(spark, texts, ids).selectExpr("*", "1 as n", "'w' as word").repartition(4)
    for slip in (None, 7):
        counts = plain_counts(zip(ids, texts), slip)
        assert dict(map(tuple, variants.word_counts(docs, slip).collect())) == {w: n for w, n in counts.items() if w}
        got = result(variants.spelling_variants(docs, slip, often=2))
        assert got == plain_groups({w: n for w, n in counts.items() if n >= 2})
        assert len(got) > 50


def test_very_long_words(spark):
    counts = {"b" * 40_000: 10, "b" * 39_999 + "c": 1, "b" * 20_000 + "c" + "b" * 20_000: 2, "x" * 30_000: 1}
    assert result(variants.group_variants(spark.createDataFrame(list(counts.items()), WORDS))) == plain_groups(counts)


def test_empty(spark):
    assert variants.spelling_variants(make_docs(spark, [])).collect() == []
    assert variants.spelling_variants(make_docs(spark, [None, "", "short"])).collect() == []
