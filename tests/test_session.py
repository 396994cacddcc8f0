"""The shared folder: read from the session, made up for local masters only."""

from types import SimpleNamespace

import pytest

from verdikt.session import SCAN_PARTITIONS, child_folders, delete_path, ensure_checkpoint_dir, path_exists
from verdikt.sources.tables import spread


def test_a_cluster_must_name_the_shared_folder():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)


def test_the_named_folder_is_used(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "file").touch()
    assert child_folders(spark, str(tmp_path)) == ["a", "b"] and path_exists(spark, f"file://{tmp_path}/a")
    delete_path(spark, str(tmp_path / "a"))
    assert not path_exists(spark, str(tmp_path / "a"))


def test_scans_are_spread_only_when_asked_for(spark):
    df = spark.range(10).coalesce(1)
    old = spark.conf.get(SCAN_PARTITIONS)
    try:
        spark.conf.unset(SCAN_PARTITIONS)
        assert spread(df) is df and spread(df, 3).rdd.getNumPartitions() == 3
        spark.conf.set(SCAN_PARTITIONS, "5")
        assert spread(df).rdd.getNumPartitions() == 5
    finally:
        spark.conf.set(SCAN_PARTITIONS, old)
