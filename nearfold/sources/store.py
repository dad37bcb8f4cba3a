"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Used only where nothing names a shared folder and all tasks run on this machine, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/nearfold"


def shared_dir(spark: SparkSession) -> str:
    """Its URI: ``spark.checkpoint.dir``, else the folder set by ``setCheckpointDir``.

    A path without a scheme is one of Hadoop's default file system, as for Spark's own checkpoints. Where neither is set, a
    local session uses a folder of this machine and a cluster is an error.
    """
    context = spark.sparkContext
    uri = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not uri:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        uri = FALLBACK_DIR
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(uri)
    return qualified(spark, uri)


def qualified(spark: SparkSession, uri: str) -> str:
    """The URI with its scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    if not path.toUri().getScheme():
        path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    return re.sub("^file:/*", "file:///", path.toString().rstrip("/"))


def new_folder(spark: SparkSession, kind: str) -> str:
    """The URI of a folder there that nothing else uses; it doesn't exist yet."""
    return f"{shared_dir(spark)}/nearfold-{kind}-{uuid.uuid4().hex}"
