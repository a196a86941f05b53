import os

from lectern import sharedfs


def test_written_and_cleared(spark):
    df = sharedfs.written(spark.range(5), "numbers")
    folder = sharedfs.shared_dir(spark).removeprefix("file://")
    assert df.count() == 5 and folder in df.inputFiles()[0] and os.listdir(folder)
    sharedfs.clear(spark)
    assert not os.path.exists(folder)
    # the next table makes the folder again
    assert sharedfs.written(spark.range(3), "numbers").count() == 3


def test_the_clusters_folder_is_read_from_the_session():
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "file:///shared/"}.get(key, default)

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            applicationId = "app-1"

    assert sharedfs.shared_dir(Session) == "file:///shared/lectern-app-1"
