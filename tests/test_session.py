"""Shared folders: the cluster's setting, never a machine-local folder there."""

from types import SimpleNamespace

import pytest

from kairos import session
from kairos.sources import writers as wr


def _session(master, configured=None):
    conf = SimpleNamespace(get=lambda key, default=None: configured or default)
    made = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, getConf=lambda: conf, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc, conf=conf), made


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_without_the_setting_fails_clearly(master):
    spark, made = _session(master)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)
    assert not made


def test_the_setting_is_used(master="yarn"):
    spark, _ = _session(master, "hdfs:///shared/ckpt")
    assert session.ensure_checkpoint_dir(spark) == "hdfs:///shared/ckpt"


def test_tables_can_be_dropped(spark):
    df = wr.persist_table(spark.range(5).toDF("x"), "t")
    assert df.count() == 5
    path = df.inputFiles()[0]
    wr.drop_tables(spark)
    import os
    assert not os.path.exists(path.replace("file://", ""))
