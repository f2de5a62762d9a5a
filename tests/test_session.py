from types import SimpleNamespace

import pytest

from quern.session import ensure_checkpoint_dir


def session(master, named=""):
    chosen = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: chosen[-1] if chosen else None, setCheckpointDir=chosen.append,
        getConf=lambda: SimpleNamespace(get=lambda key, default: default),
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named)), chosen


def test_the_named_folder_is_taken_and_a_cluster_needs_one():
    spark, chosen = session("spark://host:7077", "file:///shared")
    ensure_checkpoint_dir(spark)
    assert chosen == ["file:///shared"]
    spark, chosen = session("local[4]")
    ensure_checkpoint_dir(spark)
    assert len(chosen) == 1
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master)[0])
