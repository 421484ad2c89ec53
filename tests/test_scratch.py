"""Where intermediate tables may lie."""

from types import SimpleNamespace

import pytest

from tessera.scratch import Workspace, shared_folder


def session(master, named=None):
    conf = SimpleNamespace(get=lambda *_: named)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_needs_a_named_folder():
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]", "k8s://h"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(session("local[4]")) == shared_folder(session("local"))


def test_tables_come_back_and_go(spark):
    w = Workspace(spark, "t")
    assert w.keep(spark.range(5), "a").count() == 5
    w.drop("a")
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.parquet(f"{w.root}/a").count()
