"""The shared folder is found as Spark's own checkpoints find theirs."""

import pytest

from nearfold.sources import store


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    """A session with settings of its own over the real JVM."""

    def __init__(self, spark, conf, checkpoint=None, master="local[4]"):
        self.conf = Conf(conf)
        real = spark.sparkContext

        class Context:
            _jvm, _jsc = real._jvm, real._jsc

            def __init__(self):
                self.master, self.folder = master, checkpoint

            def getCheckpointDir(self):
                return self.folder

            def setCheckpointDir(self, uri):
                self.folder = uri

        self.sparkContext = Context()


def test_shared_folder(spark):
    assert store.shared_dir(Session(spark, {"spark.checkpoint.dir": "s3a://bucket/a/"})) == "s3a://bucket/a"
    assert store.shared_dir(Session(spark, {"spark.checkpoint.dir": "file:/x/y"}, "file:/other")) == "file:///x/y"
    assert store.shared_dir(Session(spark, {}, "hdfs://name/c", "spark://name:7077")) == "hdfs://name/c"
    assert store.shared_dir(Session(spark, {"spark.checkpoint.dir": "/plain/path"}, master="yarn")) == "file:///plain/path"  # the default file system here
    session = Session(spark, {})
    assert store.shared_dir(session) == store.FALLBACK_DIR == session.sparkContext.folder
    for master in ("yarn", "spark://name:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            store.shared_dir(Session(spark, {}, master=master))
    assert store.new_folder(session, "x") != store.new_folder(session, "x")


def test_a_path_without_scheme_lies_on_the_default_file_system(spark):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://cluster/")
    hadoop.set("fs.viewfs.mounttable.cluster.link./data", "file:///tmp")
    try:
        assert store.shared_dir(Session(spark, {"spark.checkpoint.dir": "/data/c"})) == "viewfs://cluster/data/c"
    finally:
        hadoop.set("fs.defaultFS", before or "file:///")
