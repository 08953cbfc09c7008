"""The classifiers: identities, the automaton against edit distance, held-out accuracy, odd inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm_docs import make_docs
from treecorpus.llm import quality, toxicity
from treecorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_margin_is_the_sum_over_pairs():
    machine = quality.Machine(np.zeros((quality.STATISTICS, quality.CELLS - 1)))
    rng = np.random.default_rng(1)
    machine.weights[:] = rng.standard_normal(len(machine.weights))
    machine.factors[:] = rng.standard_normal(machine.factors.shape)
    numbers, values = np.array([3, 9, 70, 5, 9]), np.array([0.5, 1.0, 2.0, 0.1, 0.7], np.float32)
    got, _ = machine.margin(numbers, values, np.array([0, 3]))
    for k, part in enumerate(([0, 1, 2], [3, 4])):
        want = sum(machine.weights[numbers[i]] * values[i] for i in part)
        want += sum(machine.factors[numbers[i]] @ machine.factors[numbers[j]] * values[i] * values[j] for i, j in itertools.combinations(part, 2))
        assert abs(got[k] - want) < 1e-4


def edits(a, b):
    """Edit distance with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=6, unique=True), st.text("abc", max_size=9))
def test_automaton_finds_terms_one_edit_away(terms, word):
    weights = {t: 1.0 + i for i, t in enumerate(terms)}
    lexicon = toxicity.Lexicon(weights.items())
    near = [w for t, w in weights.items() if len(t) >= toxicity.FUZZY_FROM and edits(t, word) == 1]
    want = (weights[word], 0) if word in weights else (max(near), 1) if near and len(word) >= toxicity.FUZZY_FROM - 1 else None
    assert lexicon.find(word) == want


def test_context_tells_quotation_from_abuse():
    lexicon = toxicity.Lexicon([("idiot", 3.0), ("lowe*", 2.0)], ["idiom"])
    assert lexicon.find("idiom") is None and lexicon.find("idioot") == (3.0, 1) and lexicon.find("lowest") == (2.0, 0)
    abuse, quoted = (toxicity.evidence(t, lexicon) for t in ("you are an idiot now", 'they wrote "an idiot" now'))
    assert abuse[0] > quoted[0] and abuse[5] == 0 and quoted[5] == 1
    assert (toxicity.evidence("nothing here", lexicon) == 0).all()


@pytest.mark.parametrize("name,label,least", [("op8_quality", "quality", 0.99), ("op4_toxicity", "toxic", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    threshold = 0.3 if label == "quality" else 0.5
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= threshold)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 500 and sum(held) / len(held) >= least


ODD = [None, "", " ", "!!!", "x" * 5000, "word " * 3000, "été ñ 漢字", "\n\n\n", "you idiot"]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_texts_and_labels(spark, module):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rnd.choice(words) for _ in range(30)) + (" moron scum loser" if i % 2 else "") for i in range(80)]
    docs = make_docs(spark, [*ODD, *texts, texts[3]], [None, *range(len(ODD) + len(texts) - 1), 4]).selectExpr("*", "1 as score", "2 as digest")
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, (i + 1) % 2, i % 2) for i in range(len(ODD), 80)] + [(None, 1, 1), (5, None, None)], schema)
    label = "quality" if module is quality else "toxic"
    for given in (labels, labels.filter("doc_id < 0"), labels.filter(f"{label} = 1")):
        rows = quality.report(docs, module.train(docs, given, label), 0.5).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    model = module.train(docs, labels, label)
    assert quality.report(make_docs(spark, []), model, 0.5).collect() == []
    again = module.train(docs.repartition(5), labels.repartition(3), label)
    assert np.allclose(model.scores([t.encode() for t in texts]), again.scores([t.encode() for t in texts]))


def test_rejected_rows_go_and_columns_stay(spark):
    docs = make_docs(spark, ["keep", None, "drop"])

    class Model:
        def scores(self, texts):
            return np.array([0.0 if t == b"drop" else 1.0 for t in texts])

    kept = quality.keep_good(docs, Model(), 0.3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]
