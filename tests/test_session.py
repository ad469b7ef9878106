"""The shared folder: staged tables of an application, and their deletion."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchloom import session


def test_staged_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    held = session.staged(spark.range(5), "five")
    assert held.count() == 5 and [p.name for p in tmp_path.iterdir()] == [f"matchloom-{spark.sparkContext.applicationId}"]
    assert list(Path(session.own_dir(spark)).iterdir())
    (tmp_path / "other").mkdir()
    assert session.clear(spark) and [p.name for p in tmp_path.iterdir()] == ["other"]
    assert not session.clear(spark)


def test_a_cluster_needs_a_named_folder():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_only_counted_sides_are_broadcast_within(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    with session.counted_broadcasts(spark):
        a, b = spark.range(10), spark.range(10)
        assert "Broadcast" not in a.join(b, "id")._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in a.join(F.broadcast(b), "id")._jdf.queryExecution().toString()
    assert spark.conf.get(name) == before
