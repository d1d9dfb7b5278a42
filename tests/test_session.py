import types

import pytest

from oriel import session


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda key, default: default)
    spark = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)
    spark.conf.get = lambda key, default: "hdfs://shared/"
    assert session.shared_dir(spark) == "hdfs://shared"
