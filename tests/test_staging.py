"""Staged tables: small tasks while they are written, folders by value."""

from treecorpus import session


def test_staging_takes_small_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    key = next(iter(session.STAGING_CONF))
    before, seen = spark.conf.get(key), []

    def build():
        seen.append(spark.conf.get(key))
        return spark.range(4).selectExpr("id", "cast(id % 2 as int) as part")

    made = session.staged(spark, "t", str(tmp_path / "in"), build, by=["part"])
    assert seen == [session.STAGING_CONF[key]] and spark.conf.get(key) == before
    assert made.filter("part = 1").count() == 2 and len(made.filter("part = 1").inputFiles()) <= len(made.inputFiles())
    try:
        session.staged_path(spark, "broken", str(tmp_path / "in"), lambda path: 1 / 0)
    except ZeroDivisionError:
        assert spark.conf.get(key) == before


def test_staging_cuts_shuffles_by_the_bytes_of_the_input(spark, tmp_path, monkeypatch):
    """Larger inputs give more parts, so a task's rows and memory don't grow; the setting is as before afterwards."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"x" * 5000)
    before, seen = spark.conf.get(session.PARTS, None), []
    for i, (size, most) in enumerate([(100, 2000), (100, 30), (1 << 20, 2000)]):
        monkeypatch.setattr(session, "PART_BYTES", size)
        monkeypatch.setattr(session, "MOST_PARTS", most)
        session.staged(spark, f"parts-{i}", str(tmp_path / "in"), lambda: seen.append(int(spark.conf.get(session.PARTS))) or spark.range(1))
    assert seen == [50, 30, int(spark.conf.get("spark.sql.shuffle.partitions"))] and spark.conf.get(session.PARTS, None) == before
