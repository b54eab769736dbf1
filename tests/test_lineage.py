import os
from types import SimpleNamespace

import pytest

from weftgraph.functions import lineage


def test_written_tables_live_in_the_shared_folder(spark):
    folder = lineage.shared_dir(spark)
    assert folder == lineage.shared_dir(spark)
    one, two = lineage.cut(spark.range(5).toDF("id")), lineage.cut(spark.range(3).toDF("id"), "named")
    path = one._weft_path.removeprefix("file://")
    assert path.startswith(folder.removeprefix("file://")) and os.path.isdir(path) and "named" in two._weft_path
    lineage.release(one, two, spark.range(1))
    assert not os.path.exists(path)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError):
        lineage.shared_dir(fake)
