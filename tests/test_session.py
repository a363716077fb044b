"""The shared folder: required off a local master, and emptied on request."""

import os
from types import SimpleNamespace

import pytest

from adyield import session


def _fake(master):
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: default))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_fake(master))


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert session.fingerprint(spark, [path]) == ""
    spark.range(3).write.parquet(path)
    first = session.fingerprint(spark, [path])
    spark.range(4).write.mode("overwrite").parquet(path)
    assert first and session.fingerprint(spark, [path]) != first


def test_broadcast_bound_counts_bytes(spark):
    from adyield.operators.common import broadcast_if_small, row_bytes
    df = session.cut_lineage(spark.range(1000).selectExpr("id", "cast(id as string) as name"), "t")
    assert row_bytes(df) == 16 + 256
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, max_bytes=1000))


def test_intermediates_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "TABLES", "adyield-drop-test")
    df = session.cut_lineage(spark.range(5), "t")
    local = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(local)
    session.drop_intermediates(spark)
    assert not os.path.exists(local)
