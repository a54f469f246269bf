"""What operators write: under the application's own folder, and cleared without touching others."""

import os

import pytest

from docketlake.llm import common


def test_only_this_run_is_cleared(spark):
    kept = common.written(spark.range(3), "kept")
    root = common.shared_dir(spark).removeprefix("file://")
    other = os.path.join(root, "docketlake", "app-of-another-job")
    os.makedirs(other)
    assert kept.count() == 3 and spark.sparkContext.applicationId in kept.inputFiles()[0]
    common.clear_written(spark)
    assert not os.path.exists(common.run_dir(spark).removeprefix("file://")) and os.path.exists(other)
    assert common.written(spark.range(2), "again").count() == 2


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
