"""The pipeline stage by stage against the plain versions."""

import random

import corpus_pipeline
from llm_docs import DOCS
from test_shingles import wanted
from test_suffix_dedup import plain
from test_url_line_topk import plain_lines
from treecorpus.llm import quality


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    shared, line = prose(70), prose(12)
    texts = []
    for i in range(160):
        if i % 4 == 3:
            texts.append(" ".join(w.upper() + "!!" for w in prose(40).split()))
        else:
            texts.append("\n".join([prose(30), *([line] if i % 3 == 0 else []), *([prose(3) + shared] if i % 7 == 0 else []), prose(60)]))
    texts += [texts[0], texts[1], texts[1] + " x", "", None, "short"]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[2], None, None, None)]
    return rows, [(i, int(i % 4 != 3), 0) for i in range(120)]


def plain_near(rows):
    key = lambda i: 2**63 - 1 if i is None else i
    return [r for r, (i, component) in zip(rows, wanted(rows)) if key(r[0]) == component]


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    sf = write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = dict(corpus_pipeline.STAGES)
    order = lambda pairs: sorted(((-1 if i is None else i), t) for i, t in pairs)

    good = corpus_pipeline.cut(names["quality"](spark, docs, sf), "t")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = model.scores([(r[1] or "").encode() for r in rows])
    want = [(r[0], r[1]) for r, s in zip(rows, scores) if s >= 0.3]
    assert order((r.doc_id, r.text or "") for r in good.collect()) == order((i, t or "") for i, t in want)
    kept = {i for i, _ in want}
    assert all(i in kept for i in range(160) if i % 4 != 3) and not any(i in kept for i in range(160) if i % 4 == 3)

    lines = corpus_pipeline.cut(names["line_dedup"](spark, good, sf), "t")
    want = [(None if i == -1 else i, t) for i, t, _, _ in plain_lines(want)]
    assert order((r.doc_id, r.text) for r in lines.collect()) == order(want)

    near = corpus_pipeline.cut(names["near_dedup"](spark, lines, sf), "t")
    want = plain_near(want)
    assert order((r.doc_id, r.text) for r in near.collect()) == order(want)

    cut = corpus_pipeline.cut(names["repeat_dedup"](spark, near, sf), "t")
    key = lambda i: 2**63 - 1 if i is None else i
    found = plain(sorted((key(i), t) for i, t in want))
    want = [(i, found[key(i), t][3].decode(errors="ignore")) for i, t in want]
    assert order((r.doc_id, r.text) for r in cut.collect()) == order(want)
    assert sum(x[1] for x in found.values()) > 1000
    for frame in (good, lines, near, cut):
        assert frame.columns == docs.columns and frame.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    pieces = names["packing"](spark, cut, sf).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in want}
    assert all(sum(r.length for r in pieces if r.doc_id == i) == next(r.doc_tokens for r in pieces if r.doc_id == i) for i, _ in want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr) == sorted(map(tuple, pieces), key=repr)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).collect() == []


def test_columns_with_the_names_of_the_stages(spark, tmp_path):
    """Columns that clash with what stages add inside come out as they went in."""
    rows, labels = corpus()
    sf = write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "*", "doc_id + 7 as n_lines", "9 as n_dropped", "1 as gone", "2 as wanted", "3 as _doc", "4 as node", "5 as doc", "6 as component", "'k' as key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, sf), "t")
        assert out.columns == docs.columns, name
        assert out.filter("n_lines <> doc_id + 7 or n_dropped <> 9 or gone <> 1 or wanted <> 2 or _doc <> 3 or node <> 4 or doc <> 5 or component <> 6").isEmpty(), name
        docs = out
