"""The shared folder, and stored stages that are removed again."""

import os

from tramline.plans import stages


def test_folders_have_their_scheme(spark):
    for given in ("/some/where", "file:/some/where/", "file:///some/where"):
        assert stages.qualified(spark, given) == "file:///some/where"
    assert stages.qualified(spark, "hdfs://name/some/where/") == "hdfs://name/some/where"
    assert stages.folder(spark).endswith("/stages") and "://" in stages.folder(spark)


def test_released_stages_are_gone(spark):
    a, b = (stages.stored(spark.range(n)) for n in (3, 5))
    assert a.count() == 3 and os.path.isdir(a._stored_at.removeprefix("file://"))
    stages.release(a, None, spark.range(1))
    assert not os.path.exists(a._stored_at.removeprefix("file://")) and b.count() == 5
