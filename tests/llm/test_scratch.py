import os

import pytest

from sieveline.llm import scratch


def test_saved_tables_are_read_back_and_cleared(spark):
    df = scratch.save(spark.range(5).selectExpr("id", "cast(null as string) as s"), "numbers")
    assert sorted(r.id for r in df.collect()) == list(range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and "localCheckpoint" not in path
    assert scratch.clear(spark) >= 1 and not os.path.exists(path) and scratch.clear(spark) == 0


def test_the_clusters_folder_is_used():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: "hdfs://cluster/shared/")

    assert scratch.new_path(Session, "x").startswith("hdfs://cluster/shared/x-")


def test_a_cluster_without_a_folder_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)
