from types import SimpleNamespace

import pytest

from costloom import session


def test_scratch_paths_differ(spark):
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert one != two and "/x-" in one


def test_a_settled_frame_has_no_lineage_left(spark):
    frame = session.settle(spark.range(10).selectExpr("id * 2 as v").where("v > 4"))
    assert frame.count() == 7
    text = frame._jdf.queryExecution().toString()
    assert "ExistingRDD" in text and "Range" not in text


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_the_named_folder_is_used_on_a_cluster():
    named = []
    context = SimpleNamespace(
        master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=named.append
    )
    cluster = SimpleNamespace(
        sparkContext=context, conf=SimpleNamespace(get=lambda key, default: "hdfs://shared/checkpoints")
    )
    assert session.shared_dir(cluster) == "hdfs://shared/checkpoints" and named == ["hdfs://shared/checkpoints"]
