"""URL filter, line dedup and exact top-k against plain Python, on odd rows."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from llm_docs import make_docs
from treecorpus.llm import line_dedup, topk, url_filter
from treecorpus.llm.queries import URL_RULES


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for h, p, v in rules
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/en", "http://example.com",
    "http://example.com?x=/en/", "http://notexample.com/en/a", "http://a.b.net/es/x#f", "http://net/fr/", "http://x.net/FR/", "http://x.net/fr",
    "http://İ.com/en/?", "a://b://c.com/", "http://x.org/en/a.b*c(d", "http://com/", "http://.com/", "http://u:p@example.com:80/en/", "http://example.com/en/\nx",
    "http://w.example.com/a/b/c", "http://w.example.com/a/bc", "http://any/private/x",
]


@pytest.mark.parametrize("rules", [URL_RULES, [], [*URL_RULES, ("", "/private/", "block"), ("example.com", "/a/b", "block"), ("w.example.com", "", "allow"),
                                               ("", "/", "allow"), ("w.example.com", "/a/b/", "allow"), ("org", "/en/a.b*c(", "block"), ("net", "/es/", "allow")]])
def test_urls(spark, rules):
    urls = URLS + ["http://example.com/en/"] * 30
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, token string").withColumn("rule", F.lit("clash"))
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.token) for r in got) == [(i, *plain_judge(u, rules), "x") for i, u in enumerate(urls)]
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).collect() == []


def plain_lines(rows, min_docs=2):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == (2**63 - 1 if i is None else i)]
        out.append((-1 if i is None else i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_lines(spark, min_docs):
    rnd = random.Random(min_docs)
    pool = ["A common LINE here", " a common line HERE\r", "ÉTÉ long enough line", "été long enough line", "short", "", "\x0b\x0cexactly10!", "exactly10!", "漢字漢字漢字漢字漢字",
            "nine char", "\x85 not stripped \x85", "tab\tinside the line", "x" * 3000]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 8)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, "a common line here\nonly without id"), (None, "exactly10!\nonly without id"), rows[3], (4, "A common LINE here\nother text"), (60, "\n".join(["A common LINE here"] * 2000))]
    docs = make_docs(spark, [t for _, t in rows], [i for i, _ in rows]).selectExpr("*", "'c' as _key", "5 as n_lines").repartition(3)
    got = line_dedup.dedup_lines(docs, min_docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == plain_lines(rows, min_docs)
    assert {r._key for r in got} == {"c"}
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_the_main_path_runs_no_python(spark):
    plan = line_dedup.dedup_lines(make_docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_top(rows, queries, k, scale=1024):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    queries = [(i, [math.floor(scale * x) for x in v]) for i, v in queries if i is not None and ok(v)]
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("k,big", [(1, 1), (10, 1), (10, 2.0**14), (400, 1)])
def test_top_k(spark, monkeypatch, k, big):
    monkeypatch.setattr(topk, "ROW_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "CELLS", 64)
    rnd = random.Random(k)
    as_float = lambda x: round(x * 256) / 256  # exact as a float
    rows = [(i, [as_float(rnd.uniform(-1, 1)) * big for _ in range(5)]) for i in range(200)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(None, rows[0][1]), (400, None), (401, [None, 1.0]), (402, [float("nan")]), (500, []), (600, [1.0, 2.0]), rows[10], (0, rows[3][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 as block", "2 as place").repartition(4)
    asked = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    got = topk.top_k(frame, frame.filter("vec_id % 100 = 0"), k).collect()
    assert sorted(tuple(r) for r in got) == plain_top(rows, asked, k)


def test_top_k_of_nothing(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(100, [1.0], 0)], SCHEMA)
    assert topk.top_k(empty, empty).collect() == [] and topk.top_k(one, one).collect() == [] and topk.top_k(one, empty).collect() == []


def test_top_k_beyond_the_doubles(spark):
    """Finite components whose floor(1024 x) is no double, and sums in which they cancel out."""
    rows = [(0, [1e306, 1.0]), (100, [-1e306, 0.5]), (1, [1e-310, 3.0]), (2, [0.0, -2.0]), (3, [1.7e308, 1.0]), (4, [1e306, -1e306]), (200, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    clip = lambda s: max(-2**62, min(2**62, s))
    cells = {i: [math.floor(Fraction(x) * 1024) if abs(x) > 1e300 else math.floor(x * 1024) for x in v] for i, v in rows}
    want = []
    for q in (0, 100, 200):
        scored = sorted((-clip(sum(a * b for a, b in zip(cells[q], cells[i]))), i) for i in cells if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    got = topk.top_k(frame, frame.filter("vec_id % 100 = 0"), 10).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {s for q, _, i, s in want if i == 4 and q == 200} == {0}


def test_top_k_asks_in_turns(spark, monkeypatch):
    """Queries are broadcast so many at a time; however they are dealt, the result is the same."""
    rnd = random.Random(8)
    frame = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)], "vec_id long, embedding array<float>")
    queries = frame.filter("vec_id % 10 = 0")
    want = sorted(map(tuple, topk.top_k(frame, queries, 5).collect()))
    assert len(want) == 150
    turns = []
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    monkeypatch.setattr(topk, "ASKED", 1)
    monkeypatch.setattr(topk, "ranges", lambda *args, whole=topk.ranges: turns.append(whole(*args)) or turns[-1])
    assert sorted(map(tuple, topk.top_k(frame, queries, 5).collect())) == want
    assert len(turns[0]) > 1
    sizes = spark.createDataFrame([(7, 4), (1, 5), (9, 20), (3, 5)], "block long, n int")
    assert topk.ranges(sizes, 10) == [(1, 3), (7, 7), (9, 9)] and topk.ranges(sizes.limit(0), 10) == [(0, 0)]
