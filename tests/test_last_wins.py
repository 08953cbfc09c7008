"""The last capture per URL: bodies that a reader leaves out are not carried."""

from pyspark.sql import functions as F

from treecorpus.operators import json_walk as walk, tree
from treecorpus.plans import goal_queries, inputs, tree_queries
from treecorpus.session import already_staged

SF = "/root/testdata/sf0.001"


def test_bodies_that_do_not_pass_still_win(spark):
    data = [("/a", 1, '{"x": 1}'), ("/a/", 2, "{}"), ("/b", 1, "{}"), ("/b", 2, '{"x": 2}'), ("/c", 1, '{"\\u0078": 3}'), ("/d", 1, None)]
    records = spark.createDataFrame(data, "url string, seq long, body string")
    last = tree.last_wins(records, body_where=walk.mentions('"x"'))
    assert sorted((r.url, r.first_seq, r.seq, r.body) for r in last.collect()) == [
        ("/a", 1, 2, None), ("/b", 1, 2, '{"x": 2}'), ("/c", 1, 1, '{"\\u0078": 3}'), ("/d", 1, 1, None)]


def test_selective_readers_stage_neither_the_tree_nor_all_bodies(spark, tmp_path):
    for path in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{path}.parquet").write.parquet(f"{tmp_path}/{path}.parquet")
    sf = str(tmp_path)
    rows = goal_queries.annotated(spark, sf)
    assert already_staged(spark, "tree", sf) is None and already_staged(spark, "full", sf) is None
    want = tree_queries.full(spark, sf).filter(F.col("body").contains(walk.ALLOWABLE))
    assert already_staged(spark, "tree", sf) is None
    assert rows.count() > 0 and rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    urls = tree_queries.crawled_urls(spark, sf)
    assert urls.columns == ["url"] and urls.exceptAll(tree_queries.crawled(spark, sf).select("url")).isEmpty()
    assert inputs.captures(spark, sf).count() == inputs.tree(spark, sf).count()


def test_folders_are_cut_off_without_lists_of_prefixes(spark):
    """Parents as by all prefixes, for any slashes; the prefixes are listed per folder, not per URL."""
    import io
    from contextlib import redirect_stdout
    from itertools import product

    urls = sorted({"".join(t) for n in range(1, 6) for t in product("/ab", repeat=n)})
    nodes = spark.createDataFrame([(u,) for u in urls if len(u) % 2 or u.endswith("a")], "url string")
    known = {r.url for r in nodes.collect()}

    def plain(url):
        parts = url.split("/")
        return max((p for p in ("/".join(parts[:i]) for i in range(1, len(parts))) if p and p != url and p in known), default=None)

    parents = tree.containment_parent(nodes)
    assert {r.url: r.parent for r in parents.collect()} == {u: plain(u) for u in known}
    shown = io.StringIO()
    with redirect_stdout(shown):
        parents.explain("extended")
    # The lambda that lists prefixes stands once in the optimized plan, behind the distinct folders.
    assert shown.getvalue().split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].count("array_join") <= 1
